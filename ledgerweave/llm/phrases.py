"""Phrase collocations by vertical partitioning of the text's suffixes.

Every place of the text starts a suffix of up to four words.  As in the
vertical partitioning of suffix trees, the first words of the suffixes are put
into groups by a memory budget: words that fit go into buckets by hash, a word
with more suffixes than half the budget is extended by its next word, and so
on, until every prefix fits.  Each group is then built on its own: its
distinct suffixes are the sorted leaves of a subtree cut at four words, and
the count of any phrase in it is the sum over its run of leaves.

Steps: (1) texts become blocks of word numbers with their own dictionaries,
which is the only look at the text; (2) dictionaries are summed and the words
of ``LEAST`` occurrences or more numbered in one order, an infrequent word
ends a suffix, as no candidate can hold it; (3) each block learns its words'
numbers by a join; (4) prefixes over the budget are counted and extended;
(5) blocks send their distinct suffixes with counts to the groups; (6) groups
build their subtrees; (7) cuts, scores, the rule about longer phrases and the
ranking are joins and aggregates of the phrases found.

Counts are exact: words are told apart by text, never by hash.  Defined
results: a null lang is ``und``, a null text is empty; rows need no id and
repeated rows count each; no rows give no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordinal import dense_ordinal, first_n_per_group
from .common import partitions, written
from .trie import mixed

#: Occurrences of a candidate, words of the longest one, rows for each language.
LEAST, LONGEST, TOP = 30, 4, 2000
#: A candidate goes if a longer one with this share (in hundredths) of its occurrences holds it.
COVERED = 80
SCALE = 2_000_000
#: Suffixes of a group, words of a block.
BUDGET = 1 << 21
BLOCK_WORDS = 1 << 19

_BREAK = b".,;:!?\x0b\x0c\r"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _BREAK + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(_BREAK) + b" ")
_PART = 1 << 20


class _Numbers(dict):
    """word -> number in the order met; 0 is no word, 1 the end of a piece."""

    def __init__(self) -> None:
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_numbers(text: bytes, numbers: _Numbers) -> np.ndarray:
    """The words of a text as numbers, a 1 at every end of a piece."""
    data, out, at = text.translate(_TABLE), [], 0
    while at < len(data):
        to = at + _PART  # parts of a long text end at a space or a line end
        if to < len(data):
            found = [i for i in (data.find(b" ", to), data.find(b"\n", to)) if i >= 0]
            to = min(found, default=len(data))
        words = data[at:to].replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
        out.append(ids[ids > 0])
        at = to
    return np.concatenate([*out, np.ones(1, np.int32)])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, held, n = TaskContext.get().partitionId() << 32, {}, 0
    pack = zstandard.ZstdCompressor(level=1).compress

    def flush() -> Iterator[pa.RecordBatch]:
        for i, (lang, (numbers, ids)) in enumerate(held.items()):
            ids = np.concatenate(ids)
            counts = np.bincount(ids, minlength=len(numbers))[2:]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number + i]), pa.array([lang], pa.string()), pa.array([pack(ids.tobytes())], pa.binary()),
                 pa.array([list(numbers)[2:]], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64()))],
                names=["block", "lang", "ids", "words", "counts"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            numbers, ids = held.setdefault(lang, (_Numbers(), []))
            ids.append(word_numbers(text.as_py(), numbers))
            n += len(ids[-1])
            if n >= BLOCK_WORDS:
                yield from flush()
                number, held, n = number + len(held), {}, 0
    yield from flush()


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The texts as global word numbers, 0 where no phrase goes on; some blocks at a time."""
    unpack, held, n = zstandard.ZstdDecompressor().decompress, [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            ids = np.frombuffer(unpack(batch.column("ids")[i].as_py()), np.int32)
            of = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
            known = batch.column("known")[i].values
            of[known.field("pos").to_numpy()] = known.field("gid").to_numpy()
            held.append(of[ids])
            n += len(ids)
            if n >= BLOCK_WORDS:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def _suffixes(stream: np.ndarray) -> np.ndarray:
    """(LONGEST, n): the suffixes of two words or more, zeros after their last word."""
    padded = np.concatenate([stream, np.zeros(LONGEST, np.uint32)])
    starts = np.flatnonzero((padded[:-1] > 0) & (padded[1:] > 0))
    out = np.stack([padded[starts + k] for k in range(LONGEST)])
    for k in range(2, LONGEST):
        out[k][out[k - 1] == 0] = 0
    return out


def _keys(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes' words as two 64-bit keys that sort alike."""
    return tuple(columns[k].astype(np.uint64) << np.uint64(32) | columns[k + 1] for k in (0, 2))


def leaves(columns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct suffixes in order, and the total of each."""
    first, second = _keys(columns)
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
    return columns[:, order[new]], np.add.reduceat(counts[order], new)


def phrase_counts(leaf: np.ndarray, total: np.ndarray, shortest: int, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, phrases, counts): the inner nodes of a subtree, read from the totals of their leaves."""
    changed = np.zeros(leaf.shape[1], bool)
    changed[:1] = True
    for k in range(LONGEST):
        changed[1:] |= leaf[k, 1:] != leaf[k, :-1]
        if k + 1 >= shortest:
            start = np.flatnonzero(changed)
            if not len(start):
                continue
            count = np.add.reduceat(total, start)
            keep = (count >= least) & (leaf[k, start] > 0)
            node = leaf[:, start[keep]].copy()
            node[k + 1:] = 0
            yield k + 1, node, count[keep]


class Groups:
    """Which group a suffix belongs to, and how long the prefix is that put it there."""

    def __init__(self, buckets: int, heavy: list[list[tuple[tuple[int, ...], int]]], most: int) -> None:
        self.buckets = buckets
        self.levels, base = [], buckets
        for words, prefixes in enumerate(heavy, 1):
            keys = np.zeros((LONGEST, len(prefixes)), np.uint32)
            for i, (prefix, _) in enumerate(prefixes):
                keys[:words, i] = prefix
            n = np.array([-(-count // most) for _, count in prefixes], np.int64)
            self.levels.append((words, *self._index(keys, n, base + np.cumsum(n) - n)))
            base += int(n.sum())

    @staticmethod
    def _index(keys: np.ndarray, n: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, ...]:
        first, second = _keys(keys)
        order = np.lexsort((second, first))
        return first[order], second[order], n[order], base[order]

    def of(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        group = (mixed(columns[0].astype(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)
        length = np.ones(columns.shape[1], np.int64)
        for words, first, second, n, base in self.levels:
            at = found(columns, words, first, second)
            rows = np.flatnonzero(at >= 0)
            at = at[rows]
            group[rows] = base[at] + (mixed(columns[words, rows].astype(np.uint64)) % n[at].astype(np.uint64)).astype(np.int64)
            length[rows] = words + 1
        return group, length


def found(columns: np.ndarray, words: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The place of each suffix' first ``words`` words among sorted keys, -1 where they are none."""
    if not len(first):
        return np.full(columns.shape[1], -1)
    head = columns.copy()
    head[words:] = 0
    a, b = _keys(head)
    if words <= 2:
        at = np.minimum(np.searchsorted(first, a), len(first) - 1)
    else:  # the keys that begin with the same two words are few: find the third among them
        kinds = np.unique(first)
        pair = np.minimum(np.searchsorted(kinds, a), len(kinds) - 1)
        third = np.unique(second)
        rank = np.searchsorted(third, second) + np.searchsorted(kinds, first) * (len(third) + 1)
        own = np.minimum(np.searchsorted(third, b), len(third) - 1)
        at = np.minimum(np.searchsorted(rank, own + pair * (len(third) + 1)), len(first) - 1)
    return np.where((first[at] == a) & (second[at] == b), at, -1)


def _extended(known: DataFrame, heavy: list[tuple[tuple[int, ...], int]], words: int) -> DataFrame:
    """Counts of the prefixes of ``words`` + 1 words that begin with a heavy one."""
    levels = Groups(1, [[]] * (words - 1) + [heavy], 1).levels[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stream in _streams(batches):
            columns = _suffixes(stream)
            columns = columns[:, (found(columns, words, *levels[1:3]) >= 0) & (columns[words] > 0)]
            columns[words + 1:] = 0
            if columns.shape[1]:
                columns, count = leaves(columns, np.ones(columns.shape[1], np.int64))
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), pa.array(count)], names=[*_WORDS, "a"])

    return known.mapInArrow(run, _NODE).groupBy(*_WORDS).agg(F.sum("a").alias("a"))


_WORDS = ["w1", "w2", "w3", "w4"]
_NODE = "w1 long, w2 long, w3 long, w4 long, a long"


def _scattered(known: DataFrame, groups: Groups) -> DataFrame:
    """(grp, length, suffixes): every block's distinct suffixes, one packed row for each group they go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for stream in _streams(batches):
            columns = _suffixes(stream)
            if not columns.shape[1]:
                continue
            columns, count = leaves(columns, np.ones(columns.shape[1], np.int64))
            group, length = groups.of(columns)
            order = np.argsort(group, kind="stable")
            cut = np.concatenate([[0], np.flatnonzero(np.diff(group[order])) + 1, [len(order)]])
            packed = np.vstack([columns, count[None]])[:, order].astype(np.uint32)
            rows = [(int(group[order[a]]), int(length[order[a]]), pack(packed[:, a:b].tobytes())) for a, b in zip(cut[:-1], cut[1:])]
            for i in range(0, len(rows), 64):
                part = list(zip(*rows[i:i + 64]))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.binary())],
                                                 names=["grp", "length", "suffixes"])

    return known.mapInArrow(run, "grp long, length long, suffixes binary")


def _subtree(least: int):
    def run(rows: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        parts = [np.frombuffer(unpack(x.as_py()), np.uint32).reshape(LONGEST + 1, -1) for x in rows.column("suffixes")]
        packed = np.concatenate(parts, axis=1)
        del parts
        leaf, total = leaves(packed[:LONGEST], packed[LONGEST].astype(np.int64))
        del packed
        found = list(phrase_counts(leaf, total, max(2, rows.column("length")[0].as_py()), least))
        nodes = [np.concatenate([node[k] for _, node, _ in found] or [np.empty(0, np.uint32)]).astype(np.int64) for k in range(LONGEST)]
        counts = np.concatenate([count for _, _, count in found] or [np.empty(0, np.int64)])
        return pa.Table.from_arrays([*map(pa.array, nodes), pa.array(counts)], names=[*_WORDS, "a"])

    return run


def _padded(words: list[str], to: int = LONGEST - 1) -> str:
    return ", ".join(f"{w} as p{i}" for i, w in enumerate([*words, *["0L"] * (to - len(words))], 1))


def _cuts() -> str:
    """SQL: the cuts of a phrase, as an array of (k, left words, right words)."""
    def of(m: int) -> str:
        return "array(" + ", ".join(f"struct({k} as k, struct({_padded(_WORDS[:k])}) as left_part, struct({_padded(_WORDS[k:m])}) as right_part)"
                                    for k in range(1, m)) + ")"
    return f"case when w4 > 0 then {of(4)} when w3 > 0 then {of(3)} else {of(2)} end"


def _inside() -> str:
    """SQL: the shorter phrases of two words or more that lie in a phrase."""
    def of(m: int) -> str:
        return "array(" + ", ".join(f"struct({_padded(_WORDS[i:i + n])})" for n in range(2, m) for i in range(m - n + 1)) + ")"
    return f"case when w4 > 0 then {of(4)} else {of(3)} end"


def collocations(df: DataFrame, least: int = LEAST, top: int = TOP, budget: int = BUDGET,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of every language."""
    spark = df.sparkSession
    texts = df.select(F.coalesce(df[lang_col].cast("string"), F.lit("und")).alias("lang"),
                      F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    blocks = written(texts.mapInArrow(_blocks, "block long, lang string, ids binary, words array<binary>, counts array<long>"), "phrase-blocks")
    n_words = written(blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")), "phrase-words")
    entry = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "entry"))
    frequent = written(dense_ordinal(entry.groupBy("lang", F.col("entry.words").alias("word")).agg(F.sum("entry.counts").alias("f"))
                                     .where(F.col("f") >= least), ["lang", "word"], name="gid", start=1), "phrase-vocabulary")
    total, words = frequent.agg(F.coalesce(F.sum("f"), F.lit(0)), F.count("*")).first()
    if words >= 1 << 32:
        raise ValueError("more frequent words than a suffix key can tell apart")

    known = (entry.select("block", "lang", F.col("entry.words").alias("word"), (F.col("pos") + 2).alias("pos"))
             .join(frequent.select("lang", "word", "gid"), ["lang", "word"]).groupBy("block")
             .agg(F.collect_list(F.struct("pos", "gid")).alias("known")))
    known = written(blocks.select("block", "ids").join(known, "block").select("ids", "known"), "phrase-streams")

    most = max(1, budget // 2)
    heavy: list[list[tuple[tuple[int, ...], int]]] = [[((r.gid,), r.f) for r in frequent.where(F.col("f") > most).select("gid", "f").collect()]]
    for size in range(2, LONGEST):
        more = _extended(known, heavy[-1], size - 1).where(F.col("a") > most).collect() if heavy[-1] else []
        heavy.append([(tuple(r)[:size], r.a) for r in more])
    groups = Groups(max(-(-total // most), partitions(spark)), heavy, most)
    counted = spark.createDataFrame([(*p, *[0] * (LONGEST - len(p)), a) for level in heavy[1:] for p, a in level], _NODE)
    built = _scattered(known, groups).groupBy("grp").applyInArrow(_subtree(least), _NODE)
    phrases = written(built.unionByName(counted), "phrases")
    return _ranked(phrases, frequent, n_words, top)


def _ranked(phrases: DataFrame, frequent: DataFrame, n_words: DataFrame, top: int) -> DataFrame:
    part = [f"p{i}" for i in range(1, LONGEST)]
    zero = F.lit(0).cast("long")
    counts = frequent.select(F.struct(F.col("gid").alias("p1"), zero.alias("p2"), zero.alias("p3")).alias("part"), "f").unionByName(
        phrases.where("w4 = 0").select(F.struct(*(F.col(w).alias(p) for w, p in zip(_WORDS, part))).alias("part"), F.col("a").alias("f")))
    cuts = phrases.select("*", F.expr(f"inline({_cuts()})"))
    for side, name in (("left_part", "l"), ("right_part", "r")):
        cuts = cuts.join(counts.select(F.col("part").alias(side), F.col("f").alias(name)), side)
    score = F.expr(f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = (cuts.select(*_WORDS, "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
              .groupBy(*_WORDS, "a").agg(F.min("cut").alias("cut")))
    longer = (phrases.where("w3 > 0").select(F.expr(f"explode({_inside()}) as part"), "a")
              .groupBy("part").agg(F.max("a").alias("longer")))
    own = F.struct(*(F.col(w).alias(p) for w, p in zip(_WORDS, part)))
    gone = F.expr(f"cast(100 as decimal(10,0)) * cast(longer as decimal(20,0)) >= cast({COVERED} as decimal(10,0)) * cast(a as decimal(20,0))")
    kept = (scored.withColumn("part", F.when(F.col("w4") == 0, own)).join(longer, "part", "left")
            .where(F.coalesce(~gone, F.lit(True)))
            .join(frequent.select(F.col("gid").alias("w1"), "lang"), "w1")
            .select("lang", *_WORDS, "a", "cut.score", "cut.l", "cut.r"))
    kept = written(kept, "phrases-kept")

    # only what can be among the first needs its text: all that ties with the last of them stays
    first = first_n_per_group(kept.select("lang", "score", "a", "w1", "w2", "w3", "w4"), ["lang"], [F.desc("score"), F.desc("a")], top, _WORDS)
    last = first.groupBy("lang").agg(F.min(F.struct("score", "a")).alias("last"))
    worth = kept.join(last, "lang").where(F.struct("score", "a") >= F.col("last")).drop("last")
    text = (worth.select("*", F.expr("posexplode(filter(array(w1, w2, w3, w4), w -> w > 0)) as (pos, gid)"))
            .join(frequent.select("gid", "word"), "gid")
            .groupBy("lang", *_WORDS, "a", "l", "r", "score").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("words"))
            .withColumn("phrase", F.expr("array_join(transform(words, x -> cast(x.word as string)), ' ')")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = first_n_per_group(text, ["lang"], order, top, _WORDS, name="rank")
    return ranked.join(n_words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql() -> str:
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
s AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM w WHERE len(ws) > 0),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM s CROSS JOIN (VALUES (1), (2), (3), (4)) AS v(m)
      WHERE i + m - 1 <= len(ws)),
f AS (SELECT lang, phrase, any_value(m) AS m, count(*) AS a FROM g GROUP BY lang, phrase HAVING count(*) >= {LEAST}),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2),
k AS (SELECT lang, phrase, ws, m, a, unnest(generate_series(1, m - 1)) AS k FROM c),
x AS (SELECT k.lang, k.phrase, k.a, k.k, l.a AS l, r.a AS r, ({SCALE}::HUGEINT * k.a) // (l.a + r.a) AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[1:k.k], ' ')
             JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[k.k + 1:], ' ')),
cut AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT c.lang, array_to_string(c.ws[i:i + z - 1], ' ') AS phrase, max(c.a) AS longer
        FROM c CROSS JOIN (VALUES (1), (2), (3)) AS v(i) CROSS JOIN (VALUES (2), (3)) AS u(z)
        WHERE z < c.m AND i + z - 1 <= c.m GROUP BY ALL),
kept AS (SELECT cut.* FROM cut LEFT JOIN sub USING (lang, phrase)
         WHERE sub.longer IS NULL OR 100::HUGEINT * sub.longer < {COVERED}::HUGEINT * cut.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a,
       l::BIGINT AS l, r::BIGINT AS r, n.n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= {TOP}
"""
