"""Secret scan: fixed patterns, and guess costs of values in credential context.

A value that follows a credential word (``pwd = ...``, ``dbPassword: "..."``,
``Authorization: Bearer ...``) is split into words, dates, repeats, keyboard
walks, addresses and paths, runs of letters as words have them and brute-force
spans so that the number of guesses an attacker needs is least (dynamic
programming over its places).  A brute-force character is one of the character
classes that the value has.  Values that even then need ``10 ** MIN_GUESSES``
guesses are secrets; placeholders such as ``password1`` or ``xxxxxxxx``,
ordinary words and addresses are not.

What words are comes from the vocabulary of a public tokenizer (a parameter;
nothing is trained on the texts, so no secret can become a word): its pieces
of three letters and more are words in falling frequency, and their letter
triples tell how much a run of letters looks like a word of its languages.  A
run that does is one of a large dictionary's words, however long it is.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log10

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import annotate, documents, keep, span_text
from .pieces import SPACE, default_model

KINDS = ("assign", "access", "hex", "guess")
#: Guesses (as a power of ten) from which a value counts as a secret.
MIN_GUESSES = 10.0
#: Shortest value that is judged.
MIN_VALUE = 8

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                     re.ASCII | re.IGNORECASE)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that have 16 characters
_CONTEXT = re.compile(r"(?:password|passwd|passphrase|passcode|pwd|pass|secret|token|api[_-]?key|access[_-]?key|"
                      r"authorization|auth|credentials?|private[_-]?key)[\"']?[ \t]*(?:=>|:=|[:=])[ \t]*"
                      r"(?:(?:bearer|basic|digest|token)[ \t]+(?=[^\s\"']))?"
                      r"(?:\"([^\"\r\n]+)\"|'([^'\r\n]+)'|[\"']?([^\s\"']+))", re.ASCII | re.IGNORECASE)
#: A scheme that stands before the value inside its quotes.
_SCHEME = re.compile(r"(?:bearer|basic|digest|token)[ \t]+", re.IGNORECASE)
_CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "auth", "credential")

# fixed values: frequent passwords and their parts, most frequent first
_WORDS = (
    "password 123456 qwerty admin welcome letmein login monkey dragon master hello freedom whatever shadow sunshine "
    "princess football baseball superman batman trustno1 iloveyou abc123 secret test guest user root default changeme "
    "change pass passwd temp demo sample example none null true false your here token key api value string my the this "
    "is not for and with insert replace enter put redacted hidden removed todo fixme placeholder xxx summer winter spring "
    "autumn january february march april may june july august september october november december monday tuesday "
    "wednesday thursday friday saturday sunday love lucky happy ninja jordan michael jennifer hunter soccer killer "
    "charlie thomas robert daniel george computer internet server database system service account manager office "
    "company local host dev prod stage live data cloud access public private code blue red green black white gold silver"
).split()
_LEET = str.maketrans("@4831!0$57", "aabeiiosst")
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {(a, b) for row in _ROWS for a, b in zip(row, row[1:])}
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
                   r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")
_YEAR = re.compile(r"(?:19|20)\d\d")
#: Address of a host, and a part of a path behind it or of a path in a file system.
_HOST = re.compile(r"(?:https?|ftp|wss?)://[A-Za-z0-9.-]+(?::\d{1,5})?", re.ASCII | re.IGNORECASE)
_PART = re.compile(r"[/\\](?:([A-Za-z]{1,24})|v?\d{1,4})?(?=[/\\.?#:_-]|$)|[._-](?:([A-Za-z]{1,12})|\d{1,4})(?=[/\\.?#:_-]|$)", re.ASCII)
_HOST_COST, _PART_COST = 4.0, 0.6
#: A word of a large dictionary, and the mean surprise of a letter (log10) up to which a run of letters is one.
_ANY_WORD, _WORDLIKE = 6.5, 1.4
_SEGMENT = log10(2)  # a new span
_CHARACTER = 1.0  # a character found by brute force, if its classes are not known
_CLASSES = (("abcdefghijklmnopqrstuvwxyz", 26), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26), ("0123456789", 10))
_MARKS, _BEYOND_ASCII = 33, 100  # other ASCII characters; a beginning for all others


class Words:
    """Ranks of known words, and the surprise of letters by the two before them."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank = {w: i + 1 for i, w in enumerate(dict.fromkeys(_WORDS))}
        self.triples: Counter = Counter()
        self.pairs: Counter = Counter()
        self.letters: Counter = Counter()
        self.after: Counter = Counter()
        for i in range(model.vocab_size()):  # in the order of merges: frequent ones first
            if model.is_byte(i) or model.is_control(i):
                continue
            piece = model.id_to_piece(i).lower()
            word = piece.replace(SPACE, "")
            if len(word) < 2 or not word.isalpha():
                continue
            if len(word) > 2:
                self.rank.setdefault(word, len(self.rank) + 1)
            text = "^" + word if piece.startswith(SPACE) else word
            self.letters.update(word)
            self.pairs.update(map("".join, zip(text, text[1:])))
            self.triples.update(map("".join, zip(text, text[1:], text[2:])))
            self.after.update(text[:-1])
            self.after.update(map("".join, zip(text[:-1], text[1:-1])))
        self.longest = max(map(len, self.rank))
        self.n_letters = sum(self.letters.values())
        self.known: dict[str, float] = {}

    def surprise(self, letter: str, before: str) -> float:
        """-log10 of the chance of a letter after up to two others (``^``: a word begins)."""
        key = before[-2:] + letter
        cost = self.known.get(key)
        if cost is None:
            chance = 0.0001 + 0.1 * self.letters[letter] / self.n_letters
            if before and self.after[before[-1:]]:
                chance += 0.35 * self.pairs[key[-2:]] / self.after[before[-1:]]
            if len(before) > 1 and self.after[before[-2:]]:
                chance += 0.5 * self.triples[key] / self.after[before[-2:]]
            cost = self.known[key] = -log10(chance)
        return cost

    def wordlike(self, run: str) -> bool:
        run = "^" + run.lower()
        return sum(self.surprise(run[i], run[max(0, i - 2):i]) for i in range(1, len(run))) <= _WORDLIKE * (len(run) - 1)


_VOCABULARIES: dict[str, Words] = {}


def words_of(path: str | None = None) -> Words:
    path = path or default_model()
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Words(path)
        keep("secrets", _VOCABULARIES.clear)
    return _VOCABULARIES[path]


def character_cost(value: str) -> float:
    """log10 of the number of characters in the classes that the value has."""
    size = sum(n for letters, n in _CLASSES if any(c in letters for c in value))
    other = [c for c in value if not (c.isascii() and c.isalnum())]
    return log10(size + _MARKS * any(c.isascii() for c in other) + _BEYOND_ASCII * any(not c.isascii() for c in other))


def _walk_ends(value: str) -> list[int]:
    """For every place the end of the longest keyboard walk or sequence that starts there."""
    n = len(value)
    up, down = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        up[i] = up[i + 1] if i + 1 < n and (value[i], value[i + 1]) in _NEXT else i + 1
        down[i] = down[i + 1] if i + 1 < n and (value[i + 1], value[i]) in _NEXT else i + 1
    return [max(a, b) for a, b in zip(up, down)]


def _repeat_ends(value: str, unit: int) -> list[int]:
    """For every place the end of the text that repeats its first ``unit`` characters."""
    n = len(value)
    run = [0] * (n + 1)
    for i in range(n - unit - 1, -1, -1):
        run[i] = run[i + 1] + 1 if value[i] == value[i + unit] else 0
    return [min(n, i + unit + run[i]) for i in range(n)]


def _runs(value: str) -> dict[int, int]:
    """start -> end of the runs of letters; a capital after a small letter begins another."""
    out, start = {}, None
    for i, c in enumerate(value):
        if start is not None and (not c.isalpha() or (c.isupper() and value[i - 1].islower())):
            out[start], start = i, None
        if start is None and c.isalpha():
            start = i
    if start is not None:
        out[start] = len(value)
    return out


def _location_ends(value: str, words: Words) -> dict[int, list[tuple[int, float]]]:
    """Spans of an address or a path: the host, and the parts behind it that are words or short numbers."""
    out: dict[int, list[tuple[int, float]]] = {}
    at = 0
    if m := _HOST.match(value):
        out[0] = [(m.end(), _HOST_COST)]
        at = m.end()
    elif value[:1] not in "/\\~." and value[1:3] not in (":\\", ":/"):
        return out
    elif value[:1] not in "/\\":
        at = next((i for i, c in enumerate(value[:4]) if c in "/\\"), len(value))
    while m := _PART.match(value, at):
        part = m.group(1) or m.group(2) or ""
        if len(part) > 4 and not words.wordlike(part):
            break
        out.setdefault(at, []).append((m.end(), _PART_COST))
        at = m.end()
    return out


def guess_cost(value: str, character: float = _CHARACTER, words: Words | None = None) -> float:
    """log10 of the guesses of the cheapest segmentation (linear in the length of the value)."""
    words = words or words_of()
    rank, longest = words.rank, words.longest
    n, low = len(value), value.lower()
    if len(low) != n:  # a letter whose small form is longer
        low = "".join(c.lower()[:1] for c in value)
    runs, places = _runs(value), _location_ends(value, words)
    plain = low.translate(_LEET)
    walks = _walk_ends(low)
    repeats = [(u, _repeat_ends(value, u)) for u in range(1, min(8, n // 2) + 1)]
    best = [0.0] + [float("inf")] * n  # cheapest cost of the first i characters
    open_ = [float("inf")] * (n + 1)  # ... that end in a brute-force span
    letters = [float("inf")] * (n + 1)  # ... that end in a run of letters as words have them
    mixed = value[1:] != low[1:] and not value.isupper()
    for i in range(n):
        at = best[i]
        spans: list[tuple[int, float]] = []
        for j in range(i + 3, min(n, i + longest) + 1):
            for word, extra in ((low[i:j], 0.0), (plain[i:j], log10(2))):
                if word in rank:
                    case = 0.0 if value[i:j] == low[i:j] else log10(2)
                    spans.append((j, log10(rank[word] + 1) + extra + case))
                    break
        spans += places.get(i, ())
        if (j := runs.get(i, i)) - i >= 5 and words.wordlike(low[i:j]):
            spans.append((j, _ANY_WORD))
        if m := _DATE.match(value, i):
            spans.append((m.end(), log10(365 * 120)))
        if m := _YEAR.match(value, i):
            spans.append((m.end(), log10(120)))
        if (j := walks[i]) - i >= 3:
            spans += [(k, log10(40 * 2 * (k - i))) for k in range(i + 3, j + 1)]
        for unit, ends in repeats:
            if (times := (ends[i] - i) // unit) >= (3 if unit == 1 else 2):
                spans += [(i + unit * t, unit * character + log10(t)) for t in {times, max(2, times - 1)}]
        for j, cost in spans:
            if at + _SEGMENT + cost < best[j]:
                best[j] = at + _SEGMENT + cost
        open_[i + 1] = min(open_[i], at + _SEGMENT) + character
        if low[i].isalpha():
            after = letters[i] + words.surprise(low[i], low[max(0, i - 2):i] if i > 1 and low[i - 2].isalpha() else low[i - 1:i]) if i else float("inf")
            letters[i + 1] = min(after, at + _SEGMENT + words.surprise(low[i], "^")) + mixed * _SEGMENT
        best[i + 1] = min(best[i + 1], open_[i + 1], letters[i + 1])
    return best[n]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    found = []
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return found


def guess_spans(text: str, known: list[tuple[int, str, int]], words: Words | None = None) -> list[tuple[int, str, int]]:
    """Values in credential context that no base span covers and that are hard to guess."""
    low = text.lower()
    if not any(w in low for w in _CONTEXT_WORDS):
        return []
    found = []
    for m in _CONTEXT.finditer(text):
        group = m.lastindex
        a, b = m.span(group)
        value = m.group(group)
        if group == 3:
            value = value.rstrip(".,;:!?)]}>")
            b = a + len(value)
        elif scheme := _SCHEME.match(value):
            a, value = a + scheme.end(), value[scheme.end():]
        if len(value) < MIN_VALUE or any(s <= a and b <= e for s, _, e in known):
            continue
        if guess_cost(value, character_cost(value), words) >= MIN_GUESSES:
            found.append((a, "guess", b))
    return found


def find_secrets(text: str | None, words: Words | None = None) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start and then by kind."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + guess_spans(text, base, words), key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def redact(text: str | None, spans: list[tuple[int, str, int]], mark: str = "[SECRET]") -> str | None:
    """The text with every run of overlapping spans replaced by one mark."""
    if not text or not spans:
        return text
    out, at, end = [], 0, -1
    for start, _, stop in spans:
        if start >= end:
            out += [text[at:start], mark]
        at = end = max(end, stop)
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _as_structs(spans: list[tuple[int, str, int]]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for a, k, b in spans]


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, spans ARRAY<STRUCT<kind, start, end>>) for every row; a null or empty text has none."""
    fields = [("spans", "array<struct<kind:string,start:int,end:int>>", _SPANS)]

    def make():
        words = words_of(vocabulary)
        return lambda t: (_as_structs(find_secrets(t, words)),)

    return annotate(documents(df, id_col, text_col), "text", fields, make, "secrets").select("doc_id", "spans")


def redacted(df: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Every column of ``df``, with the secrets of its text replaced; no row is added or lost."""
    def make():
        words = words_of(vocabulary)

        def of(text):
            spans = find_secrets(text, words)
            return redact(text, spans), len(spans)
        return of

    out = annotate(df, text_col, [("_lw_text", "string", pa.string()), ("_lw_secrets", "int", pa.int32())], make, "secrets")
    return out.withColumn(text_col, F.col("_lw_text")).drop("_lw_text").select(*[f"`{c}`" for c in df.columns], "_lw_secrets")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: span_text(s["kind"], s["start"], s["end"])), ",")
