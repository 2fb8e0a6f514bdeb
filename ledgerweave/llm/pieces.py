"""SentencePiece encoding and decoding: N best segmentations over the piece lattice.

The pieces come from a public model file; nothing is trained.  A
segmentation's score is the sum of its pieces' log-probabilities.  A unigram
model has these; a BPE model has merge ranks instead, which stand for falling
frequencies and are turned into log-probabilities by Zipf's rule, p in
proportion to 1 / (1 + rank).  So the best segmentation is the likeliest one
under that rule; the order of a BPE model's merges is not reproduced.  Scores
are rounded to 1 / 65,536, which makes every sum of them exact, in whatever
order it is added up.

A forward Viterbi pass gives every place of the lattice the best score of any
path that leads to it; these are exact heuristics for an A* search that runs
backwards from the end, so paths leave its queue in order of their full score.

Between two characters that never stand side by side in a piece every path
has a boundary.  The lattice of a text is therefore a chain of independent
small lattices: each distinct one is searched once, and the N best of the
text are the N best sums of their alternatives.  An alternative is returned
as its edits of the best segmentation, which loses nothing and stays small
for long texts.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from array import array
from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, in_parts, keep, let_go, modest_batches, named_back, plainly_named

SPACE = "▁"
#: Stands for a SPACE character of the text itself; lone surrogates do not occur in Spark's texts.
_OWN_SPACE = "\udc81"
#: Segmentations per text.
N_BEST = 3
#: Words a Python worker remembers, the older half given up when full; results do not depend on it.
CACHE_WORDS = 600_000
#: Words up to this length are searched without cutting them first.
SHORT_WORD = 40
#: What an unknown character costs below the least piece score, as in the library.
UNKNOWN_PENALTY = 10.0
#: Scores are whole multiples of one part in so many.
GRAIN = 1 << 16

#: White space stays at the head of the word that follows; a line feed is a word of its own.
_WORD = re.compile(r" +[^ \n]*|\n|[^ \n]+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_NONE, _LEAST = float("inf"), float("-inf")
_GAP, _UNGAP = struct.Struct("<d").pack, struct.Struct("<d").unpack


def log_probabilities(scores: dict[str, float]) -> dict[str, float]:
    """Piece scores as log-probabilities: whole numbers are merge ranks (0, -1, -2, ...), others are taken as they are."""
    if all(s <= 0 and s == int(s) for s in scores.values()):
        total = math.log(sum(1 / (1 - s) for s in scores.values()))
        scores = {p: -math.log(1 - s) - total for p, s in scores.items()}
    return {p: round(s * GRAIN) / GRAIN for p, s in scores.items()}


class Lattice:
    """Vocabulary of a model file and the searches over its piece lattices."""

    def __init__(self, path: str, n_best: int = N_BEST) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_best = n_best
        ids: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.raw: list[bytes] = []  # what an id decodes to
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                ids[piece] = i
                self.raw.append(piece.replace(SPACE, " ").encode())
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte pieces, so unknown characters would be lost")
        scores = log_probabilities({p: model.get_score(i) for p, i in ids.items()})
        self.pieces: dict[str, tuple[int, float]] = {p: (i, scores[p]) for p, i in ids.items()}
        self.pairs = {p[k:k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("pieces run across words")
        #: score of every id; of a character without a piece its first byte has the whole score
        self.score = np.zeros(model.vocab_size())
        for i, score in self.pieces.values():
            self.score[i] = score
        for byte, i in self.byte_id.items():
            self.score[i] = 0.0 if 0x80 <= byte < 0xC0 else self.unknown
        #: finds all pieces of a word in one pass, by the place where they end
        self.finder = ahocorasick.Automaton()
        for piece, (i, score) in self.pieces.items():
            self.finder.add_word(piece, (len(piece), score, i))
        self.finder.make_automaton()
        self.singles = frozenset(p for p in self.pieces if len(p) == 1)
        #: word -> gap between its best and second score (8 bytes), ids of its best segmentation (4 bytes each)
        self.known: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}
        self.small: dict[str, bytes] = {}
        self.ranked: dict[str, list[tuple[float, tuple[int, ...]]]] = {}

    def forward(self, text: str) -> tuple[list[float], list[list[tuple[int, float, tuple[int, ...]]]]]:
        """Best score of any path to every place, and the (start, score, ids) of the pieces that end there, longest first."""
        n, singles = len(text), self.singles
        arcs: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for end, (size, score, i) in self.finder.iter(text):
            arcs[end + 1].append((end + 1 - size, score, (i,)))
        for at in range(n):
            if text[at] not in singles:  # a character without a piece: its UTF-8 bytes
                char = SPACE if text[at] == _OWN_SPACE else text[at]
                arcs[at + 1].append((at, self.unknown, tuple(self.byte_id[b] for b in char.encode("utf-8", "surrogatepass"))))
        best = [0.0] + [_LEAST] * n
        for end in range(1, n + 1):
            best[end] = max(best[start] + gain for start, gain, _ in arcs[end])
        return best, arcs

    def best_and_gap(self, text: str) -> tuple[list[int], float]:
        """The first path of the backward search, and how far the next in its queue is behind.

        With exact heuristics the search goes straight along the best path
        (of equal arcs the one met last); all it leaves in the queue are the
        other arcs into that path's places, and the best of them is second.
        So the forward pass keeps two scores and one arc for every place.
        """
        if not self.singles.issuperset(text):
            return self._best_and_gap_of_any(text)
        n = len(text)
        best, second = [0.0] + [_LEAST] * n, [_LEAST] * (n + 1)
        start, piece = [0] * (n + 1), [0] * (n + 1)
        for end, (size, score, i) in self.finder.iter(text):
            end += 1
            at = end - size
            score += best[at]
            if score >= best[end]:
                second[end], best[end], start[end], piece[end] = best[end], score, at, i
            elif score > second[end]:
                second[end] = score
        at, path, gap = n, [], _NONE
        while at:
            if best[at] - second[at] < gap:
                gap = best[at] - second[at]
            path.append(piece[at])
            at = start[at]
        path.reverse()
        return path, gap

    def _best_and_gap_of_any(self, text: str) -> tuple[list[int], float]:
        """The same where characters have no piece of their own."""
        best, arcs = self.forward(text)
        at, path, gap = len(text), [], _NONE
        while at:
            ranked = sorted(((best[start] + gain, k) for k, (start, gain, _) in enumerate(arcs[at])), reverse=True)
            top = ranked[0]
            if len(ranked) > 1:
                gap = min(gap, top[0] - ranked[1][0])
            at, _, ids = arcs[at][top[1]]
            path.append(ids)
        return [i for ids in reversed(path) for i in ids], gap

    def search(self, text: str) -> list[tuple[float, tuple[int, ...]]]:
        """The N best (score, ids), best first; equal scores in the order of the search."""
        best, arcs = self.forward(text)
        n = len(text)
        found: list[tuple[float, tuple[int, ...]]] = []
        queue: list[tuple] = [(-best[n], 0, n, 0.0, None)]
        serial, push, pop = 0, heapq.heappush, heapq.heappop
        while queue:
            cost, _, at, score, path = pop(queue)
            if not at:
                ids_: list[int] = []
                while path is not None:
                    ids_ += path[0]
                    path = path[1]
                found.append((-cost, tuple(ids_)))
                if len(found) == self.n_best:
                    break
                continue
            for start, gain, ids in arcs[at]:
                serial -= 1
                gain += score
                push(queue, (-gain - best[start], serial, start, gain, (ids, path)))
        return found

    def merge(self, gaps: Sequence[float], choices: Callable[[int], Sequence[tuple[float, object]]]) -> list[tuple[float, dict[int, int]]]:
        """The N best choices over a chain of parts, as (total gap, {place: alternative}).

        ``gaps`` has the cost of each part's second choice (infinite if it has
        none), ``choices`` gives the (gap, ...) of its alternatives, the best first.
        Equal totals are ordered by the vector of alternatives, the first
        part first.  Only the N - 1 parts whose second choice costs least (the
        last ones among equals) can take part.
        """
        most = self.n_best - 1
        near: Sequence[int] = range(len(gaps))
        if 0 < most < len(gaps) > 64:
            cost = np.asarray(gaps)
            near = np.flatnonzero(cost <= np.partition(cost, most - 1)[most - 1]).tolist()
        ranked = sorted([(gaps[i], -i) for i in near if gaps[i] < _NONE])[:most]
        chosen = sorted(-i for _, i in ranked)
        top: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for i in chosen:
            top = heapq.nsmallest(self.n_best, ((g + c[0], (*v, k)) for g, v in top for k, c in enumerate(choices(i))))
        return [(g, {i: k for i, k in zip(chosen, v) if k}) for g, v in top]

    def parts(self, word: str) -> list[str]:
        """The word's independent lattices."""
        text = word.replace(SPACE, _OWN_SPACE).replace(" ", SPACE)
        pairs = self.pairs
        cuts = [i for i in range(1, len(text)) if text[i - 1:i + 1] not in pairs]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])] if cuts else [text]

    def word(self, word: str) -> bytes:
        """Gap to the second choice and ids of the best segmentation, packed."""
        if len(word) <= SHORT_WORD:  # its lattice as a whole: no arc crosses a cut, so the paths are the same
            ids, gap = self.best_and_gap(word.replace(SPACE, _OWN_SPACE).replace(" ", SPACE))
            return _GAP(gap) + array("i", ids).tobytes()
        parts = self.parts(word)
        gaps, codes = [], []
        for part in parts:
            found = self.small.get(part)
            if found is None:
                if len(self.small) > CACHE_WORDS // 4:
                    self.small.clear()
                ids, gap = self.best_and_gap(part)
                found = self.small[part] = _GAP(gap) + array("i", ids).tobytes()
            gaps.append(found[:8])
            codes.append(found[8:])
        return min(gaps, key=lambda g: _UNGAP(g)[0]) + b"".join(codes)

    def choices(self, word: str) -> list[tuple[float, tuple[int, ...]]]:
        """(gap, ids) of the N best segmentations of a word."""
        found = self.ranked.get(word)
        if found is None:
            if len(self.ranked) > CACHE_WORDS // 40:
                self.ranked.clear()
            parts = [self.search(p) for p in self.parts(word)]
            gaps = [p[0][0] - p[1][0] if len(p) > 1 else _NONE for p in parts]
            ranked = self.merge(gaps, lambda i: [(parts[i][0][0] - s, None) for s, _ in parts[i]])
            found = self.ranked[word] = [(gap, tuple(x for i, p in enumerate(parts) for x in p[change.get(i, 0)][1]))
                                         for gap, change in ranked]
        return found

    def encode(self, text: str | None) -> tuple[np.ndarray, float, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]:
        """(ids of the best segmentation, its score, the others as (score, [(at, drop, ids)]))."""
        if not text:
            return np.empty(0, np.int32), 0.0, []
        words, known = _WORD.findall(" " + text), self.known
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > CACHE_WORDS // 2:  # start anew, but keep the last half to look up
                self.former, known = known, {}
                self.known, new = known, set(words)
            former = self.former
            for w in new:
                known[w] = former.get(w) or self.word(w)
        found = list(map(known.__getitem__, words))
        packed = np.frombuffer(b"".join(found), np.int32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        is_id = np.ones(len(packed), bool)
        is_id[starts] = is_id[starts + 1] = False
        ids = packed[is_id]
        score = float(self.score[ids].sum())
        if self.n_best == 1:
            return ids, score, []
        gaps = np.stack([packed[starts], packed[starts + 1]], axis=1).reshape(-1).view(np.float64)
        others = []
        for gap, change in self.merge(gaps, lambda i: self.choices(words[i]))[1:]:
            edits = [(int(starts[i]) - 2 * i, int(sizes[i]) - 2, self.choices(words[i])[k][1]) for i, k in change.items()]
            others.append((score - gap, edits))
        return ids, score, others

    def decode(self, ids: Sequence[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw[1:].decode("utf-8", "replace")  # without the space put before every text


_LATTICES: dict[tuple[str, int], Lattice] = {}


def lattice(path: str, n_best: int = N_BEST) -> Lattice:
    if (path, n_best) not in _LATTICES:
        _LATTICES[path, n_best] = Lattice(path, n_best)
        keep("pieces", _LATTICES.clear)
    return _LATTICES[path, n_best]


_EDITS = pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))]))
_OTHERS = pa.list_(pa.struct([("score", pa.float64()), ("edits", _EDITS)]))
SCHEMA = ("doc_id long, n_pieces long, score double, ids array<int>, "
          "alternatives array<struct<score:double,edits:array<struct<at:int,drop:int,ids:array<int>>>>>, round_trip boolean")


def encode_pieces(df: DataFrame, model_path: str | None = None, n_best: int = N_BEST, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, score, ids, alternatives, round_trip) for every row.

    ``alternatives`` are the next ``n_best - 1`` segmentations (fewer if the
    text has no more), best first, each as edits of ``ids``: ``drop`` ids at
    place ``at`` give way to others (:func:`apply_edits`).  ``round_trip``
    tells whether the decoded ids give the text back; it is false only for
    text that is not valid Unicode.  A null or empty text has no pieces, the
    score 0 and no alternative.  Texts are encoded whole; repeated rows give
    repeated results.
    """
    path = model_path or default_model()
    modest_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("pieces")
        own = lattice(path, n_best)
        for batch in in_parts(batches):
            texts, codes, scores, others, same = batch.column(1), [], [], [], []
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                ids, score, more = own.encode(text)
                codes.append(ids)
                scores.append(score)
                others.append([{"score": s, "edits": [{"at": a, "drop": d, "ids": x} for a, d, x in e]} for s, e in more])
                same.append(own.decode(ids.tolist()) == (text or ""))
            lens = np.array([len(c) for c in codes], np.int64)
            places = np.concatenate(([0], np.cumsum(lens))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate([np.empty(0, np.int32), *codes])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lens), pa.array(scores, pa.float64()), ids, pa.array(others, _OTHERS),
                 pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "score", "ids", "alternatives", "round_trip"])

    return documents(df, id_col, text_col).mapInArrow(run, SCHEMA)


def apply_edits(ids: Sequence[int], edits: Sequence[tuple[int, int, Sequence[int]]]) -> list[int]:
    """The ids of an alternative."""
    out, at = [], 0
    for place, drop, new in sorted(edits, key=lambda e: e[0]):
        out += [*ids[at:place], *new]
        at = place + drop
    return [*out, *ids[at:]]


def decode_pieces(df: DataFrame, model_path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """Every column of ``df`` and ``decoded``: the text of the ids (null ids: null)."""
    path = model_path or default_model()
    names = [c for c in df.columns if c != "decoded"]
    plain = plainly_named(df, names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("pieces")
        own = lattice(path)
        for batch in batches:
            ids = batch.column(names.index(ids_col)).to_pylist()
            text = pa.array([None if x is None else own.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "decoded"])

    return named_back(plain.mapInArrow(run, schema), names)
