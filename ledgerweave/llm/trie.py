"""Conversation prefix trie: minimal-perfect-hash node tables of sorted shards.

Every conversation is a path of turn digests; two prefixes are one node of the
trie if their digests are equal.  Spark sorts the paths over all partitions,
so a shard (a run of consecutive paths of a bounded number of turns) holds
whole subtrees, whatever share of the conversations begins alike: equal paths
are told apart by their ids and cut like any others.  A shard enumerates its
distinct prefix digests, gives each a slot of a minimal perfect hash table,
verifies the slots (digest, parent and a second checksum of every prefix that
meets in a slot must agree, else the job fails), scatters counts into flat
arrays by slot and adds them up through the array of parent slots, deepest
nodes first.

Only the prefixes of a shard's first and last path can go on in another shard
(its border, a few rows).  Their counts are summed by digest.  What lies below
them is added up along the border paths, deepest first too: every border node
belongs to the first border path that holds it, so that a running sum along
each path counts it once for each of its ancestors.  Conversations that end in
a border node come as short pieces of ids in order, hashed as a stream.

Defined results: turns are ordered by number (null first), equal numbers by
role, then by MD5 of role and text; a null role or text is empty; rows without
a conv_id take no part; no rows give no node.  A conversation's digests (not
its texts) are held by one task, 28 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Conversations are compared with the first of every so many ids, whose first turns they share.
FAMILY, SHARED_TURNS = 100, 6
#: Turns of a shard.
SHARD_TURNS = 200_000
#: Ids of one piece of a border node's ends.
PIECE_IDS = 500

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_NONE = hashlib.sha256(b"").hexdigest()
_SIZE = 1.5


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit word spread over all others."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0 to n - 1 of n distinct digests: a key goes to the first level where no other key falls on its bit."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # bits, slot of each set bit
        base, rest = 0, np.arange(len(hi))
        while len(rest):
            if len(self.levels) == 200:
                raise ValueError("two prefixes share a digest")
            at = self._place(hi[rest], lo[rest], len(self.levels), int(_SIZE * len(rest)) + 1)
            alone = np.bincount(at, minlength=int(_SIZE * len(rest)) + 1) == 1
            self.levels.append((alone, base + np.cumsum(alone) - 1))
            base += int(alone.sum())
            rest = rest[~alone[at]]

    @staticmethod
    def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(hi ^ mixed(lo + np.uint64(level))) % np.uint64(size)).astype(np.int64)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each digest; what no slot was made for gets any slot or -1."""
        out, rest = np.full(len(hi), -1), np.arange(len(hi))
        for level, (alone, slot) in enumerate(self.levels):
            at = self._place(hi[rest], lo[rest], level, len(alone))
            out[rest[alone[at]]] = slot[at[alone[at]]]
            rest = rest[~alone[at]]
        return out


def paths(df: DataFrame) -> DataFrame:
    """(conv_id, turns ARRAY<STRUCT<digest, chars, mark>>) of every conversation, in the order of its turns."""
    role, text = (F.coalesce(df[c].cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = df["turn"].cast("long")
    rows = df.select(df["conv_id"].cast("long").alias("conv_id"), F.struct(
        turn.isNotNull().alias("numbered"), F.coalesce(turn, F.lit(0)).alias("turn"), role.alias("role"),
        F.unhex(F.md5(whole)).alias("digest"), F.length(text).alias("chars"), F.crc32(whole.cast("binary")).alias("mark")).alias("t"))
    return rows.where("conv_id is not null").groupBy("conv_id").agg(F.expr(
        "transform(array_sort(collect_list(t)), t -> struct(t.digest as digest, t.chars as chars, t.mark as mark)) as turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Every conversation with the first turns of its family's first conversation in place of its own."""
    n = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(SHARED_TURNS)).cast("int")
    heads = convs.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("family"), F.slice("turns", 1, SHARED_TURNS - 1).alias("head"))
    own = convs.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("n", n)
    return own.join(heads, "family", "left").select("conv_id", F.expr(
        "concat(slice(coalesce(head, slice(turns, 1, 0)), 1, n), slice(turns, n + 1, size(turns))) as turns"))


class Shard:
    """The node table of consecutive paths."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, words: np.ndarray, chars: np.ndarray, marks: np.ndarray) -> None:
        start = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])  # of each path, its root included
        total = int((lengths + 1).sum())
        conv = np.repeat(np.arange(len(ids)), lengths + 1)
        depth = np.arange(total) - start[conv]
        turn = depth > 0
        lanes = []
        for lane in range(2):
            power = np.cumprod(np.full(int(lengths.max()) + 1, _ODD[lane], np.uint64))
            term = np.zeros(total, np.uint64)
            term[turn] = mixed(words[:, lane]) * power[depth[turn]]
            run = np.cumsum(term)
            lanes.append(mixed(run - run[start][conv] + power[depth]))
        hi, lo = lanes
        at = np.zeros((2, total), np.int64)
        at[0, turn], at[1, turn] = chars, marks
        before = start[conv - 1] + depth  # the same depth of the path before
        again = (conv > 0) & (depth <= lengths[conv - 1])
        again[again] = (hi[again] == hi[before[again]]) & (lo[again] == lo[before[again]])
        first = np.flatnonzero(~again)

        table = PerfectHash(hi[first], lo[first])
        slot = table.slots(hi, lo)
        n = len(first)
        own = slot[first]
        self.hi, self.lo = np.empty(n, np.uint64), np.empty(n, np.uint64)
        self.depth, self.parent, self.chars, self.mark = (np.empty(n, np.int64) for _ in range(4))
        self.hi[own], self.lo[own], self.depth[own] = hi[first], lo[first], depth[first]
        self.parent[own] = np.where(depth[first] > 0, slot[first - 1], -1)
        self.chars[own], self.mark[own] = at[0, first], at[1, first]
        same = (self.hi[slot] == hi) & (self.lo[slot] == lo) & (self.depth[slot] == depth) & (self.mark[slot] == at[1]) & (
            self.chars[slot] == at[0]) & (~turn | (self.parent[slot] == np.roll(slot, 1)))
        if not same.all() or np.bincount(own, minlength=n).max() > 1:
            raise ValueError("two prefixes share a digest")

        self.n_convs = np.bincount(slot, minlength=n)
        self.conv_id = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(self.conv_id, slot, ids[conv])
        self.first, self.last = np.zeros(n, bool), np.zeros(n, bool)
        self.first[slot[:lengths[0] + 1]] = True
        self.last[slot[start[-1]:]] = True
        self.border = self.first | self.last
        inner = ~self.border
        self.n_children = np.bincount(self.parent[inner & (self.parent >= 0)], minlength=n)
        self.n_leaves = (inner & (self.n_children == 0)).astype(np.int64)
        self.saved = np.where(inner, (self.n_convs - 1) * self.chars, 0)
        nodes = np.flatnonzero(inner)
        nodes = nodes[np.argsort(-self.depth[nodes], kind="stable")]
        for level in np.split(nodes, np.flatnonzero(np.diff(self.depth[nodes])) + 1):
            np.add.at(self.n_leaves, self.parent[level], self.n_leaves[level])
            np.add.at(self.saved, self.parent[level], self.saved[level])
        #: runs of paths that end in the same node: (slot, first path, path after the last)
        end = slot[start + lengths]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(end)) + 1, [len(ids)]])
        self.ends = list(zip(end[cut[:-1]], cut[:-1], cut[1:]))


_FIELDS = [("kind", pa.string()), ("shard", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("parent_hi", pa.int64()),
           ("parent_lo", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
           ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
           ("chars", pa.int64()), ("mark", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("ends", pa.string())]
_SCHEMA = ", ".join(f"{n} {'string' if t == pa.string() else 'boolean' if t == pa.bool_() else 'long'}" for n, t in _FIELDS)


def _rows_of(s: Shard, number: int, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Whole nodes, border nodes, and the ids that end in border nodes."""
    text, sha = ids.astype(str), {}
    pieces: dict[str, list] = {"hi": [], "lo": [], "conv_id": [], "ends": []}
    for slot, a, b in s.ends:
        if not s.border[slot]:
            sha[slot] = hashlib.sha256(",".join(text[a:b]).encode()).hexdigest()
            continue
        for i in range(a, b, PIECE_IDS):
            for name, value in (("hi", s.hi[slot].view(np.int64)), ("lo", s.lo[slot].view(np.int64)), ("conv_id", ids[i]),
                                ("ends", ",".join(text[i:min(b, i + PIECE_IDS)]))):
                pieces[name].append(value)
    up = s.parent
    columns = {"hi": s.hi.view(np.int64), "lo": s.lo.view(np.int64), "parent_hi": s.hi[up].view(np.int64),
               "parent_lo": s.lo[up].view(np.int64), "conv_id": s.conv_id, "depth": s.depth, "parent_conv_id": s.conv_id[up],
               "n_convs": s.n_convs, "n_children": s.n_children, "n_leaves": s.n_leaves, "saved_tokens": s.saved,
               "chars": s.chars, "mark": s.mark, "first": s.first, "last": s.last}
    for kind, nodes in (("node", np.flatnonzero(~s.border)), ("border", np.flatnonzero(s.border))):
        made = {name: pa.array(c[nodes]) for name, c in columns.items()}
        known = ~s.border[up[nodes]]  # the smallest id of a border node is told by the other shards too
        made["parent_conv_id"] = pa.array(s.conv_id[up][nodes], mask=~known | (up[nodes] < 0))
        if kind == "border":
            for name in ("parent_hi", "parent_lo"):
                made[name] = pa.array(columns[name][nodes], mask=up[nodes] < 0)
        else:
            made["ends"] = pa.array([sha.get(i, _NONE) for i in nodes], pa.string())
        yield _batch(kind, number, made, len(nodes))
    yield _batch("ends", number, {name: pa.array(c, pa.string() if name == "ends" else pa.int64()) for name, c in pieces.items()},
                 len(pieces["hi"]))


def _batch(kind: str, number: int, made: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    made |= {"kind": pa.array([kind] * n, pa.string()), "shard": pa.array(np.full(n, number, np.int64))}
    return pa.RecordBatch.from_arrays([made.get(name, pa.nulls(n, t)) for name, t in _FIELDS], names=[name for name, _ in _FIELDS])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, held, turns = TaskContext.get().partitionId() << 32, [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([h[0] for h in held])
        return _rows_of(Shard(ids, *(np.concatenate([h[k] for h in held]) for k in range(1, 5))), number, ids)

    for batch in batches:
        ids, lists = batch.column(0).to_numpy(), batch.column(1)
        ends = lists.offsets.to_numpy()
        words = np.frombuffer(bytearray(b"".join(lists.flatten().to_pylist())), ">u8").reshape(-1, 2).astype(np.uint64)
        chars, marks = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3))
        ends = ends - ends[0]
        row = 0
        while row < len(ids):
            upto = max(row + 1, int(np.searchsorted(ends, ends[row] + SHARD_TURNS - turns, "right")) - 1)
            upto = min(upto, row + max(1, SHARD_TURNS - turns))
            a, b = ends[row], ends[upto]
            held.append((ids[row:upto], np.diff(ends[row:upto + 1]), words[a:b], chars[a:b], marks[a:b]))
            turns += int(b - a) + upto - row
            row = upto
            if turns >= SHARD_TURNS:
                yield from flush()
                held, turns, number = [], 0, number + 1
    if held:
        yield from flush()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and first id -> the digest of each node's ids."""
    node, state = None, None
    out: list[tuple[int, int, str]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                                           pa.array([o[2] for o in out], pa.string())], names=["hi", "lo", "ends"])

    for b in batches:
        for hi, lo, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if (hi, lo) == node:
                state.update(b",")
            else:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (hi, lo), hashlib.sha256()
            state.update(text.encode())
        if len(out) > 10_000:
            yield batch()
            out = []
    if node:
        out.append((*node, state.hexdigest()))
    yield batch()


def prefix_trie(df: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    sorted_paths = rebuilt(paths(df)).select(
        "conv_id", *(F.expr(f"transform(turns, t -> t.{name}) as {name}") for name in ("digest", "chars", "mark")))
    shards = written(sorted_paths.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
                     .mapInArrow(_shards, _SCHEMA), "trie")

    border = shards.where("kind = 'border'")
    path = F.col("shard") * 2  # the first path of a shard; the last one is the next number
    same = F.struct("mark", "chars", "depth", "parent_hi", "parent_lo")
    nodes = border.groupBy("hi", "lo").agg(
        *(F.max(c).alias(c) for c in ("depth", "parent_hi", "parent_lo", "chars")), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.min(F.when(F.col("first"), path).otherwise(path + 1)).alias("owner"),
        (F.min(same) != F.max(same)).alias("clash"))
    nodes = nodes.withColumn("depth", F.when(F.col("clash"), F.raise_error(F.lit("two prefixes share a digest")).cast("long"))
                             .otherwise(F.col("depth")))
    more = nodes.where("parent_hi is not null").groupBy(F.col("parent_hi").alias("hi"), F.col("parent_lo").alias("lo")).agg(F.count("*").alias("more"))
    nodes = nodes.join(more, ["hi", "lo"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    nodes = written(nodes.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long"))
                    .withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).drop("more", "clash"), "trie-border")

    on_paths = border.select("hi", "lo", F.explode(F.filter(F.array(
        F.when(F.col("first"), path), F.when(F.col("last"), path + 1)), lambda p: p.isNotNull())).alias("path"))
    below = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    mine = F.col("owner") == F.col("path")
    sums = on_paths.join(nodes.select("hi", "lo", "depth", "owner", "n_leaves", "saved_tokens"), ["hi", "lo"]).select(
        "hi", "lo", *(F.sum(F.when(mine, F.col(c)).otherwise(0)).over(below).alias(c) for c in ("n_leaves", "saved_tokens")))
    sums = sums.groupBy("hi", "lo").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = (shards.where("kind = 'ends'").select("hi", "lo", "ends", "conv_id").repartition("hi", "lo")
            .sortWithinPartitions("hi", "lo", "conv_id").select("hi", "lo", "ends").mapInArrow(_hashed, "hi long, lo long, ends string"))
    parents = nodes.select(F.col("hi").alias("parent_hi"), F.col("lo").alias("parent_lo"), F.col("conv_id").alias("parent_conv_id"))

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    tops = (nodes.drop("n_leaves", "saved_tokens").join(sums, ["hi", "lo"]).join(ends, ["hi", "lo"], "left")
            .join(parents, ["parent_hi", "parent_lo"], "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(_NONE))).select(columns))
    whole = shards.where("kind = 'node'").withColumn("ends_sha256", F.col("ends"))
    known = whole.where("parent_conv_id is not null").select(columns)
    # a shard's own copy of the border: no parent has more children in this join than a shard has nodes
    of_shard = border.select("shard", "hi", "lo").join(nodes.select("hi", "lo", F.col("conv_id").alias("parent_conv_id")), ["hi", "lo"])
    told = whole.where("parent_conv_id is null").drop("parent_conv_id", "hi", "lo").join(
        of_shard.select("shard", F.col("hi").alias("parent_hi"), F.col("lo").alias("parent_lo"), "parent_conv_id"),
        ["shard", "parent_hi", "parent_lo"]).select(columns)
    return tops.unionByName(known).unionByName(told)


def oracle_sql() -> str:
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, md5(strlen(role)::VARCHAR || ':' || role || text) AS d, length(text) AS chars, turn, role FROM t),
own AS (SELECT conv_id, d, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, d) AS p FROM k),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS family, xor(4294967295, list_reduce(
        list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0,0,0,0,0,0,0,0]::BIGINT[]),
            lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)))  % {SHARED_TURNS} AS n
      FROM (SELECT DISTINCT conv_id FROM own)),
head AS (SELECT c.conv_id, o.d, o.chars, o.p AS i FROM c JOIN own o ON o.conv_id = c.family AND o.p <= c.n),
path AS (SELECT * FROM head UNION ALL
         SELECT c.conv_id, o.d, o.chars, o.p - c.n + (SELECT count(*) FROM head h WHERE h.conv_id = c.conv_id)
         FROM c JOIN own o ON o.conv_id = c.conv_id AND o.p > c.n),
occ AS (SELECT conv_id, i, chars, md5(string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY i)) AS node FROM path
        UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
full_occ AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY i) AS up, max(i) OVER (PARTITION BY conv_id) AS n FROM occ),
node AS (SELECT node, i AS depth, min(conv_id) AS conv_id, any_value(up) AS up, any_value(chars) AS chars, count(*) AS n_convs,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE i = n), '')) AS ends_sha256
         FROM full_occ GROUP BY ALL),
kids AS (SELECT up, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY up),
part AS (SELECT o.node, sum(CASE WHEN kids.up IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.chars) AS saved_tokens
         FROM node v JOIN occ o ON o.conv_id = v.conv_id AND o.i <= v.depth LEFT JOIN kids ON kids.up = v.node GROUP BY o.node)
SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs,
       coalesce(kids.n_children, 0)::BIGINT AS n_children, part.n_leaves::BIGINT AS n_leaves,
       part.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM node v LEFT JOIN node p ON p.node = v.up LEFT JOIN kids ON kids.up = v.node JOIN part ON part.node = v.node
"""
