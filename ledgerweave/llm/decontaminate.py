"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark questions and answers are cut into windows of ``window`` words;
every distinct window becomes a pattern of one automaton.  Words are written
as codes: a word of the benchmark's vocabulary is its number in digits to base
``BASE``, every digit from an alphabet of its place, so that a match cannot
begin inside a word.  A document is normalised to its words, written in these
codes and scanned once, and the hits are mapped back to words and to
code-point offsets of the original text.

With codes of two or three digits the automaton has less than half the nodes
of one over letters, a node has ``BASE`` children at most, and a pattern holds
a number instead of item ids.  A worker keeps the automaton it has built for
the tasks that follow.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, documents, in_parts, keep, let_go, written

#: Window length in words.
WINDOW = 10
#: Benchmark text that one automaton is built from; a larger set is scanned in blocks of this size.
BLOCK_CHARS = 2_000_000
#: Base of the words' codes.
BASE = 64

#: Bytes of words: digits, ASCII letters, and everything beyond ASCII.
_IS_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_TO_WORD = bytes(c if _IS_WORD[c] else 32 for c in range(256))

SCHEMA = ("doc_id long, n_words long, n_hit long, n_items long, items array<string>, "
          "words array<struct<first:int,last:int>>, spans array<struct<start:int,end:int>>")


def words_of(text: str | None) -> list[bytes]:
    """Words in lower-case ASCII (other scripts unchanged)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TO_WORD).split()


class Benchmark:
    """The automaton of a block of items: vocabulary, patterns, and the items that hold each pattern."""

    def __init__(self, items: list[tuple[int, str]], size: int = WINDOW) -> None:
        texts = [(item_id, words_of(text)) for item_id, text in items]
        vocabulary = dict.fromkeys(w for _, words in texts for w in words)
        self.digits = 1
        while BASE ** self.digits < len(vocabulary):
            self.digits += 1
        self.code = {w: "".join(chr(1 + d * BASE + n // BASE ** d % BASE) for d in range(self.digits)) for n, w in enumerate(vocabulary)}
        self.other = "\0" * self.digits
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        length, pairs = [], set()
        for item_id, words in texts:
            coded = "".join([self.code[w] for w in words])
            for i in range(max(1, len(words) - size + 1) if words else 0):
                window = coded[i * self.digits:(i + size) * self.digits]
                place = self.automaton.get(window, len(length))
                if place == len(length):
                    length.append(len(window) // self.digits)
                    self.automaton.add_word(window, place)
                pairs.add((place, item_id))
        if length:
            self.automaton.make_automaton()
        self.length = np.array(length, np.int32)
        held = sorted(pairs)
        self.items = np.array([i for _, i in held], np.int64)
        self.start = np.searchsorted(np.array([p for p, _ in held], np.int64), np.arange(len(length) + 1))

    def scan(self, text: str | None, before: list[tuple[int, int]] = ()) -> tuple[int, list[tuple[int, int]], set[int]]:
        """(words of the text, hit runs [first, last) in words, items found); ``before``: runs known already."""
        words = words_of(text)
        n = len(words)
        if not n:
            return 0, [], set()
        get, other = self.code.get, self.other
        found = list(self.automaton.iter("".join([get(w, other) for w in words]))) if len(self.length) else []
        if not found:
            return n, list(before), set()
        last, patterns = np.array(found, np.int64).T
        last //= self.digits
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, last + 1 - self.length[patterns], 1)
        np.add.at(change, last + 1, -1)
        for first, end in before:
            change[first] += 1
            change[end] -= 1
        edge = np.diff(np.concatenate(([0], np.cumsum(change)[:n] > 0, [0])).astype(np.int8))
        items = {int(i) for p in np.unique(patterns) for i in self.items[self.start[p]:self.start[p + 1]]}
        return n, list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())), items


#: The automaton a worker built last: (name of the block, automaton).
_KEPT: list[tuple[str, Benchmark]] = []


def kept(name: str, items: list[tuple[int, str]], size: int) -> Benchmark:
    if not _KEPT or _KEPT[0][0] != name:
        _KEPT.clear()  # the former one goes before the next is built
        _KEPT.append((name, Benchmark(items, size)))
        keep("decontaminate", _KEPT.clear)
    return _KEPT[0][1]


def original_spans(text: str | None, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets [start, end) in the original text of runs of words."""
    if not runs:
        return []
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    edge = np.diff(np.concatenate(([0], _IS_WORD[raw].astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [(int(point[starts[a]]), int(point[ends[b - 1]])) for a, b in runs]


def benchmark_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``block_chars`` characters (an item longer than that is a block).

    ``toLocalIterator`` holds one partition at a time and a block is dropped
    after its scan, so the driver never holds more than one block.
    """
    block: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.toLocalIterator():
        n = len(row["text"] or "")
        if block and size + n > block_chars:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += n
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: words, hit words, item ids found, hit runs in words and in code points.

    A null or empty text has no words and no hits; a null or empty item has
    no window; items without an id are left out, as in the SQL twin
    (``uncontaminated`` reads them); items with equal ids count once; an empty benchmark leaves
    every document clean; repeated rows give repeated results.  Long texts
    are scanned whole.  The usual benchmark is one block and needs no
    shuffle; more blocks are scanned one after another, each written, and
    merged per row.
    """
    spark = docs.sparkSession
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"),
                             benchmark[item_text_col].cast("string").alias("text")).where("item_id is not null")
    blocks = benchmark_blocks(items, block_chars)
    block, state, last = next(blocks), None, False
    while not last:
        following = next(blocks, None)
        last = following is None
        shared = spark.sparkContext.broadcast(block)  # at most block_chars of text
        if state is None:
            state = documents(docs, id_col, text_col).select("doc_id", "text", F.lit(None).cast(_ITEMS).alias("items"),
                                                             F.lit(None).cast(_RUNS).alias("words"))
        state = state.mapInArrow(_scanner(shared, uuid.uuid4().hex, window, last), SCHEMA if last else _STATE)
        if not last:
            state = written(state, "contamination")
            shared.unpersist()
        block = following
    return state


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS,
                   text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit, with every column.

    No result names an item here, so items without an id count too.
    """
    items = benchmark.select(F.coalesce(benchmark[item_col].cast("long"), F.lit(-1)).alias("item_id"),
                             benchmark[item_text_col].cast("string").alias("text"))
    out, blocks = docs, benchmark_blocks(items, block_chars)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most block_chars of text

        def make(shared=shared, name=uuid.uuid4().hex):
            bench = kept(name, shared.value, window)
            return lambda text: (bool(bench.scan(text)[1]),)

        out = annotate(out, text_col, [("_lw_hit", "boolean", pa.bool_())], make, "decontaminate").where("not _lw_hit").select(
            *[f"`{c}`" for c in docs.columns])
        if following is not None:
            out = written(out, "uncontaminated")
            shared.unpersist()
        block = following
    return out


_ITEMS = "array<string>"
_RUNS = "array<struct<first:int,last:int>>"
_STATE = f"doc_id long, text string, items {_ITEMS}, words {_RUNS}"


def _scanner(shared, name: str, window: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("decontaminate")
        bench = kept(name, shared.value, window)
        for batch in in_parts(batches):
            out: list[list] = [[] for _ in range(7)]
            texts, known, runs_before = batch.column(1), batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                n, runs, found = bench.scan(text, [(r["first"], r["last"]) for r in runs_before[i].as_py() or ()])
                names = sorted({*(known[i].as_py() or ()), *map(str, found)})
                values = (n, sum(b - a for a, b in runs), len(names), names, runs,
                          original_spans(text, runs) if last else None)
                for column, value in zip(out, values):
                    column.append(value)
            runs = pa.array([[{"first": a, "last": b} for a, b in x] for x in out[4]], _PA_RUNS)
            names = pa.array(out[3], pa.list_(pa.string()))
            if not last:
                yield pa.RecordBatch.from_arrays([batch.column(0), texts, names, runs],
                                                 names=["doc_id", "text", "items", "words"])
                continue
            spans = pa.array([[{"start": a, "end": b} for a, b in x] for x in out[5]], _PA_SPANS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), names, runs, spans],
                names=["doc_id", "n_words", "n_hit", "n_items", "items", "words", "spans"])
    return run


_PA_RUNS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_PA_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def oracle_sql() -> str:
    """DuckDB twin of the query's columns."""
    words = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    return f"""
WITH i AS (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[k:k + {WINDOW - 1}], ' ') AS gram
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
dw AS (SELECT rid, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw))),
h AS (SELECT dw.rid, dw.k, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.gram = iw.gram),
p AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM h) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(s.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.rid = d.rid LEFT JOIN s ON s.rid = d.rid"""
