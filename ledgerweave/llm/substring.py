"""Substring dedup with fixed-block anchors.

Every document is cut into non-overlapping blocks of ``BLOCK`` words; these
are the index.  Every rolling window of ``BLOCK`` words of every document
probes it.  A repeat of ``WINDOW = 2 * BLOCK - 1`` words holds a whole indexed
block wherever it starts, so a document's windows that touch no shared block
are done.  The others are extended: their ``WINDOW`` words are compared, and
runs of repeated windows are the maximal exact repeats.

Blocks, probes and windows travel as 32- or 64-bit hashes grouped into one
row per (bucket, group of documents); a bucket is read as a stream whose
state is one entry per distinct block or window of the bucket, so a passage
that a third of all documents share needs no more memory than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import documents, partitions, written

BLOCK = 7
WINDOW = 2 * BLOCK - 1
#: Bytes of text that are hashed together; a longer text is hashed in pieces cut at white space.
GROUP_BYTES = 1 << 21

#: Hits gathered before they are sent on, and windows before they are merged with those seen so far.
_MERGE = 1 << 19

_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MULT = np.uint64(0xD6E8FEB86659FD93)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, GROUP_BYTES + (1 << 16))
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(size - 1, b, np.uint64))))
                          for b in (_BASE, _BACK)]
    return _POWERS[0], _POWERS[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MULT
    return h ^ (h >> np.uint64(29))


def _piece(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of every word; a word's hash depends on its bytes alone."""
    data = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate(([True], _SEP[data], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, back = _powers(len(raw))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[:len(raw)], dtype=np.uint64)))
    return starts, _mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, number of words of each text)."""
    raw = b"\n".join(texts)
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[:-1]
    starts, hashes, at = [], [], 0
    while at < len(raw):
        end = at + GROUP_BYTES
        while end < len(raw) and not _SEP[raw[end]]:
            end += 1
        s, h = _piece(raw[at:end]) if end - at < 2 * GROUP_BYTES else _long(raw[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.concatenate(starts)
    return np.concatenate(hashes), np.diff(np.concatenate((np.searchsorted(first, begins), [len(first)])))


def _long(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A piece that ends in a word of over GROUP_BYTES: the powers would be too many, so that word is hashed apart."""
    body = raw.rstrip()
    cut = max(body.rfind(bytes([c])) for c in (32, 9, 10, 11, 12, 13)) + 1
    s, h = _piece(raw[:cut]) if cut else (np.empty(0, np.int64), np.empty(0, np.uint64))
    last = np.array([xxhash.xxh64_intdigest(body[cut:])], np.uint64)
    return np.append(s, cut), np.concatenate((h, last))


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words."""
    n = max(0, len(words) - size + 1)
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h ^= words[j:j + n]
        h *= _MULT
        h ^= h >> np.uint64(29)
    return h


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of at most GROUP_BYTES or one text."""
    texts = batch.column(1).cast(pa.binary())
    first, held, size = 0, [], 0
    for i in range(batch.num_rows):
        raw = texts[i].as_py() or b""
        if held and size + len(raw) > GROUP_BYTES:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


_ROW = "bucket int, kind int, keys binary, docs binary, counts binary"
_PA_ROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()),
                     ("counts", pa.binary())])


def _spread(bucket: np.ndarray, kind: int, keys: np.ndarray, doc: np.ndarray, ids: np.ndarray) -> list[dict]:
    """One row per bucket: its keys in document order, and how many of them each document has."""
    order = np.argsort(bucket, kind="stable")
    bucket, keys, doc = bucket[order], keys[order], doc[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    rows = []
    for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(bucket)]))):
        if a == b:
            continue
        row = {"bucket": int(bucket[a]), "kind": kind, "keys": keys[a:b].tobytes(), "docs": None, "counts": None}
        if kind:
            change = np.concatenate(([0], np.flatnonzero(np.diff(doc[a:b])) + 1))
            row["docs"] = ids[doc[a:b][change]].astype("<i8").tobytes()
            row["counts"] = np.diff(np.append(change, b - a)).astype("<u4").tobytes()
        rows.append(row)
    return rows


def _blocks(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rolling blocks of texts long enough for a window: (hash, text, place in the text, place among all words)."""
    text = np.repeat(np.arange(len(counts)), counts)
    h = rolling(words, BLOCK)
    at = np.arange(len(h))
    ok = (text[at] == text[at + BLOCK - 1]) & (counts[text[at]] >= WINDOW) if len(h) else np.zeros(0, bool)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    at = at[ok]
    return h[ok], text[at], at - first[text[at]], at


def _codes(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int32), h.astype(np.uint32)


def anchors(docs: DataFrame, n: int) -> DataFrame:
    """Index (kind 0) and probe (kind 1) rows of ``n`` buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, texts in _groups(batch):
                words, counts = word_hashes(texts)
                h, text, place, _ = _blocks(words, counts)
                if not len(h):
                    continue
                bucket, key = _codes(h, n)
                fixed = place % BLOCK == 0
                rows = _spread(bucket[fixed], 0, key[fixed], text[fixed], ids)
                rows += _spread(bucket, 1, key, text, ids[first:first + len(texts)])
                yield pa.RecordBatch.from_pylist(rows, schema=_PA_ROW)

    return docs.mapInArrow(run, _ROW)


class _Hits:
    """(document, code) hits of a task, sent on as one row for each group of documents."""

    def __init__(self, n: int) -> None:
        self.n, self.docs, self.codes, self.size = n, [], [], 0

    def add(self, docs: np.ndarray, codes: np.ndarray) -> None:
        self.docs.append(docs)
        self.codes.append(codes)
        self.size += len(docs)

    def rows(self) -> pa.RecordBatch:
        docs, codes = np.concatenate(self.docs), np.concatenate(self.codes)
        self.docs, self.codes, self.size = [], [], 0
        ids, doc = np.unique(docs, return_inverse=True)
        order = np.argsort(doc, kind="stable")
        group = (_mix(ids.astype(np.uint64)) % np.uint64(self.n)).astype(np.int32)
        return pa.RecordBatch.from_pylist(_spread(group[doc[order]], 1, codes[order], doc[order], ids), schema=_PA_ROW)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (doc_id, codes) per document; a group of documents is a share of a partition."""

    def merged(docs: list[np.ndarray], codes: list[np.ndarray]) -> pa.RecordBatch:
        doc, code = np.concatenate(docs), np.concatenate(codes)
        order = np.argsort(doc, kind="stable")
        doc, code = doc[order], code[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[cuts[:-1]], pa.int64()),
             pa.array([np.unique(code[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
            names=["doc_id", "codes"])

    group, docs, codes = -1, [], []
    for at, _, keys, doc in _stream(batches, "<i8"):
        if at != group and docs:
            yield merged(docs, codes)
            docs, codes = [], []
        group = at
        docs.append(doc)
        codes.append(keys)
    if docs:
        yield merged(docs, codes)


def _per_document(hits: DataFrame, n: int) -> DataFrame:
    dealt = hits.repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_gather, "doc_id long, codes binary")


def _stream(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
    for batch in batches:
        for i in range(batch.num_rows):
            bucket, kind, keys, docs, counts = (batch.column(c)[i].as_py() for c in range(5))
            doc = np.repeat(np.frombuffer(docs, "<i8"), np.frombuffer(counts, "<u4")) if kind else None
            yield bucket, kind, np.frombuffer(keys, dtype), doc


def _shared_blocks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Probes of indexed blocks that more than one document has, as hits with block codes.

    Per indexed block the state is the first document seen and whether
    another one came; until then there is nothing to tell, after that every
    probe is passed on at once.
    """
    hits = _Hits(n)
    bucket, index, parts = -1, np.empty(0, np.uint32), []
    first, seen, shared = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool)
    for at, kind, keys, doc in _stream(batches, "<u4"):
        if at != bucket:
            bucket, index, parts = at, np.empty(0, np.uint32), []
            first, seen, shared = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool)
        if not kind:
            parts.append(np.unique(keys))
            if sum(map(len, parts[1:])) > len(parts[0]):
                parts = [np.unique(np.concatenate(parts))]
            continue
        if parts:
            index, parts = np.unique(np.concatenate(parts)), []
            first, seen, shared = np.zeros(len(index), np.int64), np.zeros(len(index), bool), np.zeros(len(index), bool)
        if not len(index):
            continue
        k = np.minimum(np.searchsorted(index, keys), len(index) - 1)
        hit = index[k] == keys
        k, doc = k[hit], doc[hit]
        new, where = np.unique(k, return_index=True)
        unseen = ~seen[new]
        first[new[unseen]], seen[new[unseen]] = doc[where[unseen]], True
        now = np.unique(k[(doc != first[k]) & ~shared[k]])
        shared[now] = True
        out = shared[k]
        docs = np.concatenate((doc[out], first[now]))
        if len(docs):
            hits.add(docs, np.concatenate((index[k[out]], index[now])).astype(np.int64) | (np.int64(bucket) << 32))
            if hits.size > _MERGE:
                yield hits.rows()
    if hits.size:
        yield hits.rows()


def _codes_of(cell: bytes | None) -> np.ndarray:
    return np.frombuffer(cell or b"", "<i8")


def candidate_windows(hits: DataFrame, n: int) -> DataFrame:
    """Windows that touch a shared block, from (doc_id, text, codes): rows like the probes' with 64-bit keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, texts in _groups(batch):
                words, counts = word_hashes(texts)
                h, text, _, at = _blocks(words, counts)
                bucket, key = _codes(h, n)
                code = key.astype(np.int64) | (bucket.astype(np.int64) << 32)
                touched = np.zeros(len(words) + 1, np.int64)
                cuts = np.searchsorted(text, np.arange(len(texts) + 1))
                for t in range(len(texts)):
                    own = slice(cuts[t], cuts[t + 1])
                    touched[1 + at[own][np.isin(code[own], _codes_of(batch.column(2)[first + t].as_py()))]] = 1
                touched = np.cumsum(touched)
                w = rolling(words, WINDOW)
                place = np.arange(len(w))
                of = np.repeat(np.arange(len(counts)), counts)
                place = place[(of[place] == of[place + WINDOW - 1]) & (touched[place + BLOCK] > touched[place])] \
                    if len(w) else place
                if len(place):
                    keys = w[place]
                    yield pa.RecordBatch.from_pylist(
                        _spread(((keys >> np.uint64(40)) % np.uint64(n)).astype(np.int32), 1, keys, of[place],
                                ids[first:first + len(texts)]), schema=_PA_ROW)

    return hits.mapInArrow(run, _ROW)


def _repeated_windows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Windows that also start in a document with a smaller doc_id, as hits with window codes.

    Per window the state is the smallest doc_id so far: a larger one is
    passed on at once, a smaller one takes its place and the former is
    passed on.
    """
    hits = _Hits(n)
    bucket, known, least = -1, np.empty(0, np.uint64), np.empty(0, np.int64)
    keys_held: list[np.ndarray] = []
    docs_held: list[np.ndarray] = []

    def merge() -> None:
        nonlocal known, least
        keys = np.concatenate([known, *keys_held])
        docs = np.concatenate([least, *docs_held])
        keys_held.clear()
        docs_held.clear()
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        start = np.concatenate(([True], keys[1:] != keys[:-1]))
        known, least = keys[start], docs[start]
        over = docs > least[np.cumsum(start) - 1]
        if over.any():
            hits.add(docs[over], keys[over].view(np.int64))

    for at, _, keys, doc in _stream(batches, "<u8"):
        if at != bucket:
            if keys_held:
                merge()
            bucket, known, least = at, np.empty(0, np.uint64), np.empty(0, np.int64)
        keys_held.append(keys)
        docs_held.append(doc)
        if sum(map(len, keys_held)) > max(_MERGE, len(known)):
            merge()
        if hits.size > _MERGE:
            yield hits.rows()
    if keys_held:
        merge()
    if hits.size:
        yield hits.rows()


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, codes): the hashes of a document's windows that start in a document with a smaller id."""
    n = partitions(docs.sparkSession)
    known = docs.where("doc_id is not null")
    dealt = anchors(known, n).repartition(n, "bucket").sortWithinPartitions("bucket", "kind")
    hits = written(dealt.mapInArrow(lambda rows: _shared_blocks(rows, n), _ROW), "anchors")
    texts = known.join(_per_document(hits, n).hint("shuffle_hash"), "doc_id").select("doc_id", "text", "codes")
    dealt = candidate_windows(texts, n).repartition(n, "bucket").sortWithinPartitions("bucket")
    hits = written(dealt.mapInArrow(lambda rows: _repeated_windows(rows, n), _ROW), "windows")
    return _per_document(hits, n)


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, removed): words left after taking out repeated passages.

    ``removed`` lists the maximal runs [first, last) of removed words.  A null
    text has no words; texts of fewer than ``WINDOW`` words lose none.  Rows
    without a doc_id are neither compared nor changed.  Rows with equal
    doc_id are one document of several texts: none is smaller than another.
    Two windows count as equal when their 64-bit hashes do.
    """
    docs = documents(df, id_col, text_col)
    joined = docs.join(repeated_windows(docs).hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept, runs = [], [], [], []
            texts = batch.column(1).cast(pa.binary())
            for i in range(batch.num_rows):
                raw = texts[i].as_py() or b""
                words, codes, gone = raw.split(), batch.column(2)[i].as_py(), []
                if codes:
                    hit = np.isin(rolling(word_hashes([raw])[0], WINDOW).view(np.int64), _codes_of(codes))
                    change = np.zeros(len(words) + 1, np.int64)
                    starts = np.flatnonzero(hit)
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + WINDOW, -1)
                    edge = np.diff(np.concatenate(([0], np.cumsum(change[:-1]) > 0, [0])).astype(np.int8))
                    gone = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
                left, at = [], 0
                for a, b in gone:
                    left += words[at:a]
                    at = b
                left += words[at:]
                total.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
                runs.append([{"first": a, "last": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string()),
                 pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))],
                names=["doc_id", "n_words", "n_removed", "kept_text", "removed"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string, "
                                  "removed array<struct<first:int,last:int>>")


def oracle_sql() -> str:
    """DuckDB twin of the query's columns."""
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id,
                  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT rid, doc_id, k, array_to_string(w[k:k + {WINDOW - 1}], ' ') AS gram
      FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS k FROM t WHERE doc_id IS NOT NULL)),
r AS (SELECT rid, k FROM (SELECT rid, k, doc_id, min(doc_id) OVER (PARTITION BY gram) AS first FROM g) WHERE first < doc_id),
c AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(k, k + {WINDOW})) AS p FROM r)),
x AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM t),
kept AS (SELECT x.rid, string_agg(word, ' ' ORDER BY x.p) AS text FROM x ANTI JOIN c ON c.rid = x.rid AND c.p = x.p GROUP BY x.rid),
n AS (SELECT rid, count(*) AS removed FROM c GROUP BY rid)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(n.removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN n ON n.rid = t.rid LEFT JOIN kept ON kept.rid = t.rid"""
