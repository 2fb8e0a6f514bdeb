"""Toxicity scores from a lexicon that tolerates misspelling and knows quotation.

The lexicon is learned: whole words and word stems that labelled toxic texts
hold far more often than clean ones.  Whole words are matched within one
edit by a Levenshtein automaton intersected with the trie of the lexicon;
the states of the intersection are made deterministic as they are met, so a
word is read once and most words die after a few letters.  A misspelled hit
counts as its term's weight at a discount, unless the labelled rows show the
word to be an ordinary one.  Around every hit a context window is scored,
which tells quotation and report from abuse: its words and quotation marks
have log odds, learned from the windows of hits in clean and in toxic labelled
texts where these differ beyond chance, and known beforehand for quotation
marks and a few words of report and of address.  A logistic model over the
hits in either context, fitted on labelled rows the lexicon was not learned
from, gives the score.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, documents, id_remainder, written

#: Labelled rows of either class that the model is fitted on (those with the smallest id hashes).
SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 6000
#: Terms at most, least share of toxic texts with a term, least ratio of its shares in toxic and clean texts.
MAX_TERMS, MIN_SHARE, MIN_RATIO = 400, 0.01, 50.0
#: Least likelihood ratio (G) of a term's counts against equal shares in both classes.
MIN_EVIDENCE = 15.0
#: Letters of a stem; a stem must be found in this many times more texts than any of its words.
STEM, STEM_GAIN = range(3, 9), 1.3
#: Whole words from this length on are matched within one edit.
FUZZY_LENGTH = 5
#: Whole words from this length on are matched within one edit where a digit or a mark stands for a letter (``sc*m``);
#: by letters alone too many ordinary words of four letters are an edit apart.
MASKED_LENGTH = 4
#: Share of its term's weight that a misspelled hit has.
NEAR = 0.8
#: A word within one edit of a term is an ordinary word, unless its share in toxic texts is this many times that in clean ones.
NEAR_RATIO = 5.0
#: Words on either side of a hit that are its context.
CONTEXT = 6
#: Log odds of quotation that a window has by itself, and that its words and marks have beforehand.
WINDOW_ODDS, QUOTED, REPORT, ADDRESS = -2.0, 3.0, 1.5, -1.5
#: Hits with a word in their window that weigh as much as what is known of the word beforehand; learned words at most.
PRIOR_HITS, MAX_CONTEXT = 5, 2000
#: Words added to every text's length, so that one hit does not decide on a text of a few words.
SMALL_TEXT = 30
CACHE_WORDS, CACHE_STATES = 400_000, 50_000

_WORD = re.compile(r"[^\W\d_]+")
# two runs of letters with one digit or mark between them, and one run after or before such a mark that ends a chunk
_MASKED = re.compile(r"(?<![^\W\d_])(?=([^\W\d_]++(?:[^\w\s]|[\d_])[^\W\d_]++))"
                     r"|(?<!\S)(?=([\d@$*#][^\W\d_]++))|(?<![^\W\d_])(?=([^\W\d_]++[\d@$*#](?!\S)))")
_QUOTES = re.compile("[\"“”„«»‹›‘]")
# fixed values: words of report and of address in the four languages
_REPORT = frozenset("said says called calls quote quoted quotes term terms word words wrote cited sagte nannte zitat wort "
                    "dit disait cite mot dijo llama cita palabra".split())
_ADDRESS = frozenset("you your youre u du dein deine ihr tu ton vous votre eres su usted".split())


class Term(NamedTuple):
    text: str
    stem: bool
    weight: float


class Automaton:
    """Product of the lexicon's trie and the Levenshtein automata of its whole words."""

    def __init__(self, terms: list[Term], ordinary: Iterable[str] = ()) -> None:
        # trie nodes: children, weight of a whole word that ends here, weight of a stem, word may be misspelled
        self.children: list[dict[str, int]] = [{}]
        self.whole: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.fuzzy: list[bool] = [False]
        self.long: list[bool] = [False]  # ... by letters alone
        for t in terms:
            at = 0
            for c in t.text:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.whole.append(0.0)
                    self.stem.append(0.0)
                    self.fuzzy.append(False)
                    self.long.append(False)
                at = self.children[at][c]
            if t.stem:
                self.stem[at] = max(self.stem[at], t.weight)
            else:
                self.whole[at] = max(self.whole[at], t.weight)
                self.fuzzy[at] = len(t.text) >= MASKED_LENGTH
                self.long[at] = len(t.text) >= FUZZY_LENGTH
        #: nodes on the way to a word that may be misspelled: others need no edits
        self.leads = [False] * len(self.children)
        for n in range(len(self.children) - 1, -1, -1):
            self.leads[n] = self.fuzzy[n] or any(self.leads[m] for m in self.children[n].values())
        self.start = self._close({(0, 0)})
        self.moves: dict[tuple[frozenset, str], frozenset] = {}
        self.ordinary = frozenset(ordinary)
        self.known: dict[str, tuple[float, float] | None] = {}

    def _close(self, states: set[tuple[int, int]]) -> frozenset:
        """Add the states reached by leaving out a letter of the term; drop edited twins of exact states."""
        for node, edits in list(states):
            if not edits:
                states.update((m, 1) for m in self.children[node].values() if self.leads[m])
        return frozenset(s for s in states if not s[1] or (s[0], 0) not in states)

    def _step(self, state: frozenset, letter: str) -> frozenset:
        key = (state, letter)
        found = self.moves.get(key)
        if found is None:
            out: set[tuple[int, int]] = set()
            for node, edits in state:
                child = self.children[node].get(letter)
                if child is not None:
                    out.add((child, edits))
                if not edits:
                    if self.leads[node]:
                        out.add((node, 1))  # a letter too many
                    out.update((m, 1) for m in self.children[node].values() if m != child and self.leads[m])
            if len(self.moves) > CACHE_STATES:
                self.moves.clear()
            found = self.moves[key] = self._close(out)
        return found

    def match(self, word: str) -> tuple[float, float] | None:
        """(weight of an exact hit or stem, weight of a hit within one edit), None if neither."""
        if word in self.known:
            return self.known[word]
        state, stem = self.start, 0.0
        for letter in word:
            state = self._step(state, letter)
            if not state:
                break
            for node, edits in state:
                if not edits and self.stem[node] > stem:
                    stem = self.stem[node]
        exact = max([stem, *(self.whole[n] for n, e in state if not e)], default=0.0)
        fuzzy = self.long if word.isalpha() else self.fuzzy
        near = 0.0 if word in self.ordinary else max((self.whole[n] for n, e in state if e and fuzzy[n]), default=0.0)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        found = self.known[word] = (exact, 0.0 if exact else near) if exact or near else None
        return found


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def masked_of(low: str) -> list[tuple[int, str]]:
    """(place, word) of words in which one digit or mark may stand for a letter or have been put between letters."""
    return [(m.start(), m.group(m.lastindex)) for m in _MASKED.finditer(low)]


def hits_of(automaton: Automaton, low: str, words: list[str]) -> list[tuple[int, float, float]]:
    """(word, weight of an exact hit, weight of a near one) in a lower-case text with these words.

    A masked word counts where none of the words in it is a hit by itself.
    """
    found = {i: hit for i, w in enumerate(words) if (hit := automaton.match(w))}
    masked = [(at, w, hit) for at, w in masked_of(low) if (hit := automaton.match(w)) and not hit[0]]
    if masked:
        spans = [m.span() for m in _WORD.finditer(low)]
        for at, w, hit in masked:
            own = range(bisect_left(spans, (at,)), bisect_left(spans, (at + len(w),)))
            if not any(i in found for i in own):
                found[own[0]] = hit
    return [(i, *found[i]) for i in sorted(found)]


#: Stands for quotation marks on both sides among the words of a window.
QUOTATION = '"'


def prior_odds(word: str) -> float:
    return QUOTED if word == QUOTATION else REPORT if word in _REPORT else ADDRESS if word in _ADDRESS else 0.0


def window(words: list[str], gaps: list[str], at: int) -> set[str]:
    """The words around a hit, and ``QUOTATION`` if there are quotation marks on both sides of it."""
    near = {*words[max(0, at - CONTEXT):at], *words[at + 1:at + 1 + CONTEXT]}
    before = "".join(gaps[max(0, at - CONTEXT):at + 1])
    after = "".join(gaps[at + 1:at + 2 + CONTEXT])
    return near | {QUOTATION} if _QUOTES.search(before) and _QUOTES.search(after) else near


def context_score(near: set[str], context: Mapping[str, float]) -> float:
    """Log odds of a window: above 0 the hit is quoted or reported.

    What is known beforehand counts once for all words of report and once for
    all of address; learned odds count for every word.
    """
    learned = sum(context[w] for w in near if w in context)
    known = {prior_odds(w) for w in near if w not in context}
    return WINDOW_ODDS + learned + sum(known)


def _gaps(low: str) -> list[str]:
    spans = [m.span() for m in _WORD.finditer(low)]
    return [low[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(low)])]


def windows_of(automaton: Automaton, text: str | None) -> list[set[str]]:
    """The windows of all hits of a text."""
    low = (text or "").lower()
    words = _WORD.findall(low)
    hits = hits_of(automaton, low, words)
    gaps = _gaps(low) if hits else []
    return [window(words, gaps, i) for i, _, _ in hits]


def learn_context(counts: Iterable[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """word -> log odds of quotation, from (word, hits in toxic texts with it near, hits in clean texts) of so many hits."""
    told = [(evidence(t, c, toxic, clean), w, t, c) for w, t, c in counts] if toxic and clean else []
    out = {}
    for g, w, t, c in sorted(told, reverse=True)[:MAX_CONTEXT]:
        if g >= MIN_EVIDENCE:
            odds = math.log((c + 0.5) / (clean + 1)) - math.log((t + 0.5) / (toxic + 1))
            out[w] = (PRIOR_HITS * prior_odds(w) + (t + c) * odds) / (PRIOR_HITS + t + c)
    return out


def features(automaton: Automaton, text: str | None, context: Mapping[str, float] | None = None) -> list[float]:
    """log(1 + weight) of the hits in abuse, the hits' share of words, and log(1 + weight) of the hits in quotation."""
    low = (text or "").lower()
    words = _WORD.findall(low)
    hits = hits_of(automaton, low, words)
    sums, n = [0.0] * 2, 0.0
    if hits:
        gaps = _gaps(low)
        for i, exact, near in hits:
            sums[context_score(window(words, gaps, i), context or {}) > 0] += exact or NEAR * near
            n += 1.0 if exact else NEAR
    return [math.log1p(sums[0]), math.sqrt(n / (len(words) + SMALL_TEXT)), math.log1p(sums[1])]


class Model(NamedTuple):
    terms: list[Term]
    weights: list[float]  # of the features, and the intercept; none: nothing was learned
    ordinary: tuple[str, ...] = ()  # words within one edit of a term that are none
    context: Mapping[str, float] = {}  # learned odds of words around a hit

    def scorer(self):
        automaton = Automaton(self.terms, self.ordinary)

        def score(text: str | None) -> float:
            if not self.weights:
                return 0.0
            z = self.weights[-1] + sum(w * x for w, x in zip(self.weights, features(automaton, text, self.context)))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        return score


def term_ratio(share, clean_share):
    """Ratio of the shares, smoothed so that a term without a clean text passes from MIN_SHARE on, whatever the sample's size."""
    return share / (clean_share + MIN_SHARE / MIN_RATIO)


def evidence(with_toxic: int, with_clean: int, toxic: int, clean: int) -> float:
    """G statistic of the 2 x 2 table of texts with and without a term."""
    both = with_toxic + with_clean
    cells = ((with_toxic, toxic, both), (with_clean, clean, both), (toxic - with_toxic, toxic, toxic + clean - both),
             (clean - with_clean, clean, toxic + clean - both))
    return 2 * sum(n * math.log(n * (toxic + clean) / (row * column)) for n, row, column in cells if n > 0)


def select_terms(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> list[Term]:
    """The lexicon from (word or stem*, toxic texts, clean texts) of candidates.

    A stem must gain on every candidate word under it; the words stay beside
    it, for their misspellings.
    """
    chosen: dict[str, Term] = {}
    best: Counter = Counter()  # texts of the most frequent word that starts so
    for name, with_toxic, _ in counts:
        if not name.endswith("*"):
            for k in range(1, len(name) + 1):
                best[name[:k]] = max(best[name[:k]], with_toxic)
    for name, with_toxic, with_clean in sorted(counts, key=lambda c: (-c[1], c[0].endswith("*"), -len(c[0]), c[0])):
        ratio = term_ratio(with_toxic / toxic, with_clean / max(1, clean))
        if ratio < MIN_RATIO or evidence(with_toxic, with_clean, toxic, clean) < MIN_EVIDENCE or len(chosen) >= MAX_TERMS:
            continue
        stem = name.endswith("*")
        text = name.rstrip("*")
        if stem and (best[text] * STEM_GAIN > with_toxic or any(text[:k] + "*" in chosen for k in range(1, len(text)))):
            continue
        chosen[name] = Term(text, stem, math.log(ratio))
    return list(chosen.values())


def _candidates(text: str | None) -> set[str]:
    words = set(words_of(text))
    return words | {w[:k] + "*" for w in words for k in STEM if len(w) > k}


def _count_features(docs: DataFrame, make: Callable[[], Callable[[str | None], set[str]]] = lambda: _candidates) -> DataFrame:
    """(name, toxic, clean): texts of either class that hold a word or a stem, summed in every task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_of = make()
        for batch in batches:
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[0 if toxic else 1].update(names_of(text))
            names = list(found[0])  # a term must occur in toxic texts
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in found)],
                names=["name", "toxic", "clean"])
            rest = [n for n in found[1] if n not in found[0]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()),
                 pa.array([found[1][n] for n in rest], pa.int64())], names=["name", "toxic", "clean"])

    counted = docs.select("text", "toxic").mapInArrow(run, "name string, toxic long, clean long")
    return counted.groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _ordinary(docs: DataFrame, terms: list[Term], toxic: int, clean: int) -> tuple[str, ...]:
    """Words of labelled texts within one edit of a term that clean texts hold about as often as toxic ones."""

    def make():
        automaton = Automaton(terms)
        return lambda text: {w for w in [*words_of(text), *(w for _, w in masked_of((text or "").lower()))]
                             if (hit := automaton.match(w)) and not hit[0]}

    near = _count_features(docs, make).where((F.col("clean") > 0) & (F.col("toxic") / toxic < NEAR_RATIO * F.col("clean") / clean))
    return tuple(sorted(r["name"] for r in near.select("name").collect()))  # some words of a bounded sample


def _context(docs: DataFrame, terms: list[Term], ordinary: tuple[str, ...]) -> dict[str, float]:
    """Learned odds of the words around hits in labelled texts; the empty name counts the hits themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(terms, ordinary)
        for batch in batches:
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for near in windows_of(automaton, text):
                    found[0 if toxic else 1].update([*near, ""])
            names = list({**found[0], **found[1]})
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in found)], names=["name", "toxic", "clean"])

    counted = docs.select("text", "toxic").mapInArrow(run, "name string, toxic long, clean long").groupBy("name").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = {r["name"]: (r["toxic"], r["clean"]) for r in counted.where("name = '' or toxic + clean >= 3").collect()}  # words of a bounded sample
    toxic, clean = counts.pop("", (0, 0))
    return learn_context(((w, t, c) for w, (t, c) in counts.items()), toxic, clean)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Logistic regression by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (5, 0), id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit lexicon and model on at most SAMPLE_TOXIC + SAMPLE_CLEAN labelled rows outside the held-out remainder.

    Equal texts count once.  Rows without id, text or label, and labels other
    than 0 and 1, are left out.  Without rows of both classes nothing is
    learned and every score is 0.
    """
    own = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("toxic"))
    own = own.where("doc_id is not null and toxic in (0, 1)").where(
        id_remainder(F.col("doc_id"), held_out[0]) != held_out[1])
    order = F.xxhash64("doc_id")
    sample = (own.where("toxic = 1").orderBy(order, "doc_id").limit(SAMPLE_TOXIC)
              .unionByName(own.where("toxic = 0").orderBy(order, "doc_id").limit(SAMPLE_CLEAN))).distinct()
    rows = documents(docs, id_col, text_col).where("text is not null").join(F.broadcast(sample), "doc_id")  # bounded above
    rows = written(rows.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.max("toxic").alias("toxic")), "toxic-sample")
    first, second = rows.where("h % 2 = 0"), rows.where("h % 2 != 0")
    sizes = {r["toxic"]: r["n"] for r in first.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model([], [])
    least = max(3, math.ceil(MIN_SHARE * toxic))
    ratio = term_ratio(F.col("toxic") / toxic, F.col("clean") / clean)
    top = (_count_features(first).where(F.col("toxic") >= least).where(ratio >= MIN_RATIO)
           .orderBy(F.desc("toxic"), "name").limit(20 * MAX_TERMS).collect())
    terms = select_terms([(r["name"], r["toxic"], r["clean"]) for r in top], toxic, clean)

    ordinary = _ordinary(first, terms, toxic, clean)
    context = _context(first, terms, ordinary)

    def make():
        automaton = Automaton(terms, ordinary)
        return lambda text: (features(automaton, text, context),)

    fitted = annotate(second.select("text", "toxic"), "text", [("x", "array<double>", pa.list_(pa.float64()))], make)
    table = fitted.select("toxic", "x").collect()  # three numbers for each row of the sample
    y = np.array([r["toxic"] for r in table], float)
    if not 0 < y.sum() < len(y):
        return Model(terms, [], ordinary, context)
    return Model(terms, _fit(np.array([r["x"] for r in table]), y), ordinary, context)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every column of ``df`` and ``toxic_score`` (0 to 1); a null or empty text has the score of no hits."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most MAX_TERMS terms

    def make():
        of = shared.value.scorer()
        return lambda text: (of(text),)

    return annotate(df, text_col, [("toxic_score", "double", pa.float64())], make)
