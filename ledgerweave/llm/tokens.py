"""Token ids in fixed-width bit-packed blocks.

File format: a Parquet table of blocks.  A block holds whole documents in
ascending ``doc_id`` order, its ids packed one after another in ``width``
bits each (little-endian bit order), ``width`` being the least number of bits
that holds the vocabulary.  Columns: ``shard`` (one per range of doc_id),
``block`` (position in the shard), ``first`` (ids of the shard before the
block), ``n_ids``, ``width``, ``doc_ids`` and ``doc_lens`` (ids of each
document in the block), ``payload``.  The id at place i of a block starts at
bit ``i * width``, so a reader unpacks a whole block with numpy or seeks one
document without the rest (:func:`read_document`).
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import documents, keep, let_go, partitions

BLOCK_SCHEMA = ("shard int, block int, first long, n_ids long, width int, first_doc long, last_doc long, doc_ids array<long>, "
                "doc_lens array<long>, payload binary")
#: A block is closed when it holds this many ids (a longer document makes a longer block).
BLOCK_IDS = 1 << 18
#: Words a Python worker remembers; the memory is emptied when full, results do not depend on it.
CACHE_WORDS = 1_200_000
_CHUNK = 1 << 16


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(ids: np.ndarray, width: int) -> bytes:
    """Pack ids into ``width`` bits each; chunks of a multiple of 8 ids end on a byte."""
    parts = []
    for at in range(0, len(ids), _CHUNK):
        part = np.ascontiguousarray(ids[at:at + _CHUNK], dtype="<u4")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        parts.append(np.packbits(bits, axis=None, bitorder="little").tobytes())
    return b"".join(parts)


def unpack(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from place ``start`` of a block, as little-endian unsigned 32-bit integers."""
    raw, out = np.frombuffer(payload, np.uint8), np.empty(count, "<u4")
    for at in range(0, count, _CHUNK):
        n = min(_CHUNK, count - at)
        first = (start + at) * width
        last = first + n * width
        bits = np.unpackbits(raw[first >> 3:(last + 7) >> 3], bitorder="little")[first & 7:(first & 7) + n * width]
        full = np.zeros((n, 32), np.uint8)
        full[:, :width] = bits.reshape(n, width)
        out[at:at + n] = np.packbits(full, axis=1, bitorder="little").view("<u4")[:, 0]
    return out


#: Letters followed by ASCII marks.
_MARKED = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)")


class WordEncoder:
    """A tokenizer applied word by word, with the ids of words seen before remembered.

    Exact for tokenizers whose pre-tokenizer never joins text across a space
    or a line feed and drops both, as the word-end BPE files do; the test
    compares it with encoding whole texts.  Where the tokenizer is of that
    kind, a word of plain letters goes to its BPE model directly, and ASCII
    marks after the letters are encoded apart, as its pre-tokenizer would do.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = max(1, int(self.tokenizer.get_vocab_size() - 1).bit_length())
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {"": b""}
        steps = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])]
        self.letters = kinds == ["NFC", "Replace", "Lowercase"] and "\\p{L}" in str(steps["pre_tokenizer"])

    def _letters(self, word: str) -> bytes | None:
        """Ids of a word that is one run of letters to the pre-tokenizer, else None."""
        if not word.isalpha():
            return None
        low = text = word.lower()
        if not word.isascii():
            if max(word) >= "\u0300" or not low.isalpha():
                return None
            text = "".join(map(_BYTE_CHARS.__getitem__, low.encode()))
        code = self.known.get(low)
        if code is None:
            code = self.known[low] = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        return code

    def _learn(self, words: set[str]) -> None:
        rest = []
        for word in words:
            code = None
            if self.letters:
                code = self._letters(word)
                if code is None and (parts := _MARKED.fullmatch(word)) and (head := self._letters(parts[1])) is not None:
                    if parts[2] not in self.known:
                        self.known[parts[2]] = self._whole([parts[2]])[0]
                    code = head + self.known[parts[2]]
            if code is None:
                rest.append(word)
            else:
                self.known[word] = code
        for word, code in zip(rest, self._whole(rest)):
            self.known[word] = code

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.asarray(c.ids, "<u4").tobytes() for c in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            words = text.replace("\n", " ").split(" ")
            new = set(words).difference(self.known)
            if new:
                if len(self.known) + len(new) > CACHE_WORDS:
                    self.known = {"": b""}
                    new = set(words) - {""}
                self._learn(new)
            out.append(b"".join(map(self.known.__getitem__, words)))
        return out


def _byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


_BYTE_CHARS = _byte_chars()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
        keep("tokens", _ENCODERS.clear)
    return _ENCODERS[path]


def write_tokens(df: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 1,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` to each and write the blocks in ascending doc_id order.

    A null text is empty (its end id alone is stored).  Rows with equal doc_id
    keep one entry each, ordered by a hash of the text and then by the text,
    however many partitions there are; rows without a doc_id come first.
    An empty table writes no block.
    """
    tok = tokenizer_path or default_tokenizer()
    docs = documents(df, id_col, text_col)
    n = partitions(df.sparkSession)
    docs = docs.withColumn("h", F.xxhash64("text"))  # texts themselves would make long range bounds
    ordered = docs.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("tokens")
        enc, shard, end = encoder(tok), TaskContext.get().partitionId(), np.asarray([end_id], "<u4").tobytes()
        state = {"block": 0, "first": 0}
        ids: list[int | None] = []
        codes: list[bytes] = []

        def close() -> pa.RecordBatch:
            lens = [len(c) // 4 for c in codes]
            known = [i for i in ids if i is not None]
            row = {"shard": shard, **state, "n_ids": sum(lens), "width": enc.width, "doc_ids": ids.copy(),
                   "first_doc": min(known, default=None), "last_doc": max(known, default=None), "doc_lens": lens, "payload": pack(np.frombuffer(b"".join(codes), "<u4"), enc.width)}
            state["block"] += 1
            state["first"] += row["n_ids"]
            ids.clear()
            codes.clear()
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        held = 0
        for batch in batches:
            texts = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                code = enc.encode([texts[i].as_py() or ""])[0] + end
                ids.append(doc_id)
                codes.append(code)
                held += len(code) // 4
                if held >= BLOCK_IDS:
                    yield close()
                    held = 0
        if ids:
            yield close()

    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.mode("errorifexists").parquet(path)


_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
                    ("width", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())),
                    ("payload", pa.binary())])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard with the number of ids before it (a few bytes per shard, never per document)."""
    sizes = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("shard", F.coalesce(before, F.lit(0)).alias("shard_start"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    index = token_index(spark, path)
    #: the index holds one row per written range partition, so its size is bounded by their number
    blocks = spark.read.parquet(path).join(F.broadcast(index), "shard")
    blocks = blocks.select("doc_ids", "doc_lens", "width", "payload", (F.col("shard_start") + F.col("first")).alias("start"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, lens, width, payload, start = (batch.column(c)[r].as_py() for c in range(5))
                data = unpack(payload, width, 0, sum(lens)).tobytes()
                ends = np.cumsum(lens)
                starts = ends - np.asarray(lens)
                crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(starts + start, pa.int64()), pa.array(lens, pa.int64()),
                     pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int]:
    """Random access: blocks are pruned by their first and last id, only the block's bits of the document are unpacked."""
    near = (F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)
    block = spark.read.parquet(path).where(near & F.array_contains("doc_ids", doc_id)).take(1)
    if not block:
        return []
    b = block[0]
    at = list(b["doc_ids"]).index(doc_id)
    return unpack(bytes(b["payload"]), b["width"], sum(b["doc_lens"][:at]), b["doc_lens"][at]).tolist()


def token_pack(df: DataFrame, path: str | None = None, tokenizer_path: str | None = None) -> DataFrame:
    """Write the files to a new folder under the shared one (or ``path``) and read them back."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "tokens", uuid.uuid4().hex)
    write_tokens(df, path, tokenizer_path)
    return read_tokens(spark, path)
