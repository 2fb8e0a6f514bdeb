"""SimHash near-dedup with pigeonring candidate search.

A fingerprint is cut into a ring of ``RING`` segments.  If two fingerprints
differ in at most ``distance`` bits, some segment starts a chain of
consecutive segments on the ring whose cumulative differences stay within
the proportional budgets ``floor(l * distance / RING)`` for every length l.
With five segments and four bits these are 0, 1, 2, 3, 4: the first segment
is equal, the second differs in one bit at most, so one of its halves is equal
too, and the third in two at most, so one of its thirds is.  First segment,
half and third form the join key of 23 to 25 bits; the rest of the chain is
checked inside the join, and its full length is the exact bit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, let_go, written

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: (lowest bit, bits) of the ring's segments.
RING = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Keys of a ring start: halves of the second segment, thirds of the third.
_KEYS = 6
#: Fingerprints under one key that one join task pairs; denser keys are cut into blocks of this size.
BLOCK = 1024
_CHUNK = 1 << 14


def simhash(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles, repeats included (no word: zero), as a signed integer."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    words = raw.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    starts, ends = starts[:n].tolist(), ends[k - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        parts = map(joined.__getitem__, map(slice, starts[at:at + _CHUNK], ends[at:at + _CHUNK]))
        h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), "<u8", min(_CHUNK, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, fp LONG) for every row, ``h`` being a hash of the text; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("simhash")
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = pa.array([simhash(texts[i].as_py(), shingle) for i in range(batch.num_rows)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), fps], names=["doc_id", "h", "fp"])

    docs = documents(df, id_col, text_col).withColumn("h", F.xxhash64("text"))
    return docs.mapInArrow(run, "doc_id long, h long, fp long")


def _part(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def postings(fps: DataFrame) -> DataFrame:
    """(key, fp): for each ring start the equal first segment with either half of the next one and each third of the one after."""
    fp, keys = F.col("fp"), []
    for i, (low, width) in enumerate(RING):
        low2, width2 = RING[(i + 1) % len(RING)]
        low3, width3 = RING[(i + 2) % len(RING)]
        halves = ((low2, 6), (low2 + 6, width2 - 6))
        thirds = ((low3, 4), (low3 + 4, 4), (low3 + 8, width3 - 8))
        for k, ((at, bits), (at3, bits3)) in enumerate(product(halves, thirds)):
            tag = F.lit((_KEYS * i + k) << 40).cast("long")
            keys.append(tag + F.shiftleft(_part(fp, low, width), 16) + F.shiftleft(_part(fp, at, bits), 8) + _part(fp, at3, bits3))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _chain(a: Column, b: Column, key: Column, distance: int) -> Column:
    """The chain from the key's ring start, shortest prefix first; its whole length is the bit distance."""
    diff = a.bitwiseXOR(b)
    start = F.floor(F.shiftright(key, 40) / _KEYS)
    whole = F.bit_count(diff) <= distance
    checks = F.lit(False)
    for i in range(len(RING)):
        ok, mask = F.lit(True), 0
        for length in range(1, len(RING)):
            low, width = RING[(i + length - 1) % len(RING)]
            mask |= ((1 << width) - 1) << low
            signed = mask - (1 << 64) if mask >> 63 else mask
            ok = ok & (F.bit_count(diff.bitwiseAND(F.lit(signed))) <= length * distance // len(RING))
        checks = checks | ((start == i) & ok)
    return checks & whole


def _forest(left: np.ndarray, right: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``left`` and ``right``: same components, at most one edge a node."""
    nodes = np.unique(np.concatenate((left, right)))
    fresh, edges = np.ones(len(nodes), bool), []
    for first in range(len(nodes)):
        if not fresh[first]:
            continue
        fresh[first] = False
        stack = [first]
        while stack:
            at = stack.pop()
            rest = np.flatnonzero(fresh)
            near = rest[np.bitwise_count((nodes[rest] ^ nodes[at]).view(np.uint64)) <= distance]  # of the absolute value, if signed
            fresh[near] = False
            edges += zip(repeat(int(nodes[at])), nodes[near].tolist())
            stack += near.tolist()
    return edges


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v), u > v: links that connect every two fingerprints at most ``distance`` bits apart.

    Keys shared by up to ``BLOCK`` fingerprints are joined.  A denser key (a
    large group of near copies) is cut into blocks by a hash; every two blocks
    meet in one task, which compares them whole and returns a spanning forest
    of their links, so nothing is lost and no group's pairs are all written.
    Spark sizes the postings as the fingerprints (an explode counts as one row
    each), so the join of the thin keys names its kind: neither side is
    broadcast, whatever the estimate.
    """
    post = postings(fps)
    dense = written(post.groupBy("key").count().where(F.col("count") > BLOCK), "simhash-dense")
    thin = post.join(dense, "key", "left_anti")
    a, b = thin.alias("a"), thin.alias("b")
    near = a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") > F.col("b.fp"))
                  & _chain(F.col("a.fp"), F.col("b.fp"), F.col("a.key"), distance))
    near = near.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))

    def block_links(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        edges = _forest(pdf["fp"][pdf["own"] == lo].to_numpy(), pdf["fp"][pdf["own"] == hi].to_numpy(), distance)
        return pd.DataFrame({"u": [max(e) for e in edges], "v": [min(e) for e in edges]}, dtype="int64")

    blocks = F.ceil(F.col("count") / BLOCK)
    rows = (post.join(dense, "key").withColumn("own", F.pmod(F.xxhash64("fp"), blocks))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            .select("key", "fp", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")))
    far = rows.groupBy("key", "lo", "hi").applyInPandas(block_links, "u long, v long")
    return near.unionByName(far).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge.

    Alternating large-star and small-star rounds, each a written table; the
    minimum of a node's neighbours is written before it is joined back, so a
    hub's edges are split over tasks by the skew join.
    """
    def star(table: DataFrame, large: bool) -> DataFrame:
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else table
        least = written(both.groupBy("u").agg(F.min("v").alias("m"))
                        .select("u", F.least("u", "m").alias("m")), f"{name}-least")
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select("u", F.col("m").alias("v")))
        return out.where("u > v").distinct()

    def mark(table: DataFrame):
        return table.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()

    edges = written(edges.select("u", "v"), name)
    before = mark(edges)
    while True:
        edges = written(star(written(star(edges, True), name), False), name)
        after = mark(edges)
        if after == before:
            break
        before = after
    # at the fixed point every edge leads from a node to its component's smallest
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(df: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, fp, component_id, root): component_id is the smallest doc_id linked through fingerprints.

    Null and empty texts share the fingerprint zero and are linked like any
    other.  Repeated rows stay repeated.  A component without any doc_id has
    a null component_id; ``root`` names the component in every case.  Exact
    copies meet in one aggregation (partial in every task) and are never
    paired.
    """
    rows = written(fingerprints(df, shingle, id_col, text_col), "simhash-rows")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-fps")
    roots = written(components(links(fps, distance), "simhash-links").select(F.col("node").alias("fp"), "root"),
                    "simhash-roots")
    least = (roots.join(fps, "fp").groupBy("root").agg(F.min("rep").alias("least")))
    linked = written(roots.join(written(least, "simhash-least"), "root"), "simhash-linked")
    of = written(fps.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id")), "simhash-of")
    return rows.join(of, "fp").select("doc_id", "h", "fp", "component_id", "root")


def one_of_each(df: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of each component the row with the smallest doc_id (rows without one last).

    Of rows that agree in doc_id and text one stays.
    """
    found = near_duplicates(df, shingle, distance, id_col, text_col)
    copies = found.groupBy("root", "doc_id", "h").agg(F.count("*").alias("n"))
    first = written(copies.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "n")).alias("first")).select(
        F.col("first.doc_id").alias("_lw_id"), F.col("first.h").alias("_lw_h"), F.col("first.n").alias("_lw_n")), "simhash-first")
    rows = df.withColumn("_lw_text", F.xxhash64(df[text_col].cast("string")))
    same = df[id_col].cast("long").eqNullSafe(F.col("_lw_id")) & (F.col("_lw_text") == F.col("_lw_h"))
    kept = rows.join(first, same)  # texts are shuffled here alone; both parts below read this shuffle
    once = kept.where("_lw_n = 1").unionByName(kept.where("_lw_n > 1").dropDuplicates([id_col, "_lw_text"]))
    return once.select(*[f"`{c}`" for c in df.columns])


def fingerprint_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
