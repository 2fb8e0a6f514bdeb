"""Prefix trie, phrase collocations and nearest neighbours against brute force on small fixtures."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from ledgerweave.llm import neighbours, phrases, queries, trie

# -- 11 --------------------------------------------------------------------------------------------------------------

TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(rows):
    """Every node with its members, straight from the definition."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, role.encode(), tie), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    nodes = collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].append((c, d == len(path)))
    kids = collections.Counter(n[:-1] for n in nodes if n)
    saved = {n: (len(m) - 1) * len(n[-1][1]) if n else 0 for n, m in nodes.items()}
    below = collections.defaultdict(lambda: [0, 0])
    for n in nodes:
        for d in range(len(n) + 1):
            below[n[:d]][0] += not kids[n]
            below[n[:d]][1] += saved[n]
    return collections.Counter(
        (min(m)[0], len(n), min(nodes[n[:-1]])[0] if n else None, len(m), kids[n], *below[n],
         hashlib.sha256(",".join(str(c) for c, end in sorted(m) if end).encode()).hexdigest()) for n, m in nodes.items())


def conversations():
    rng = random.Random(7)
    rows = [(None, 0, "user", "no id"), (5, None, "user", "null turn first"), (5, 0, None, None), (5, 0, "user", "tie b"),
            (5, 0, "user", "tie a"), (5, 0, "user", "tie a"), (7, 1, "user", "x" * 300_000), (7, 2, "", ""), (103, 0, "user", "no family")]
    for conv in range(300, 420):  # copies, shared openings, a long one
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, "user" if turn % 2 else "assistant", rng.choice(["hi", "été 😀", "no", "hi"])))
    rows += [(300, t, "user", f"late {t}") for t in range(20, 160)]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1400) for t in range(3)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("turns", [200_000, 40, 1])
def test_trie_equals_brute_force(spark, monkeypatch, turns):
    monkeypatch.setattr(trie, "SHARD_TURNS", turns)
    rows = conversations()
    df = spark.createDataFrame([(t, c, x, r, "z", 1) for c, t, r, x in rows],
                               "turn long, conv_id long, text string, role string, `a.b` string, n_convs int")
    assert collections.Counter(tuple(r) for r in trie.prefix_trie(df).select(TRIE).collect()) == brute_trie(rows)


def test_trie_of_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(df).collect() == []


def test_perfect_hash_is_minimal_and_refuses_equal_digests():
    rng = np.random.default_rng(3)
    hi, lo = rng.integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
    assert sorted(trie.PerfectHash(hi, lo).slots(hi, lo)) == list(range(5000))
    with pytest.raises(ValueError, match="share a digest"):
        trie.PerfectHash(hi[[0, 0]], lo[[0, 0]])


def test_prefixes_that_share_a_digest_fail_the_job(spark):
    """Two turns of one digest: the second checksum tells them apart, in a shard and at its border."""
    digest = [b"0" * 16]
    shard = [np.frombuffer(digest[0], ">u8").astype(np.uint64)[None].repeat(2, 0)]
    with pytest.raises(ValueError, match="share a digest"):
        trie.Shard(np.array([1, 2]), np.array([1, 1]), shard[0], np.array([3, 3]), np.array([10, 11]))


# -- 12 --------------------------------------------------------------------------------------------------------------


def brute_phrases(rows, least, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, 5):
                    if i + m <= len(words):
                        f[lang][tuple(words[i:i + m])] += 1
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in cand.items():
            score, _, l, r = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            if not any(100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                       for q, b in cand.items() if len(q) > len(p)):
                best.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return collections.Counter(out)


def phrase_rows():
    rng = random.Random(11)
    words = ["the", "New", "york", "city", "été", "|", "a\x01", "x" * 40, "東京"]
    rows = [("en", None), ("en", ""), (None, "und words und words, und words"), ("xx", " \t\n"), ("en", "the new york city hall " * 3000)]
    rows += [(rng.choice(["en", "en", "de", None]), " ".join(
        rng.choice(["new york city hall", "big apple", *words]) + rng.choice(["", "", "", ",", ".\n", "\t"]) for _ in range(60))) for _ in range(60)]
    return rows * 2


@pytest.mark.parametrize("budget, least, top", [(1 << 22, 30, 2000), (400, 5, 2000), (40, 3, 7)])
def test_phrases_equal_brute_force(spark, monkeypatch, budget, least, top):
    """The small budgets extend prefixes to two, three and four words."""
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 1 << 19 if budget > 400 else 300)
    rows = phrase_rows()
    df = spark.createDataFrame([(t, l, 1, "q", 2) for l, t in rows], "text string, lang string, a int, `w.x` string, rank int")
    cols = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = collections.Counter(tuple(r) for r in phrases.collocations(df, least, top, budget).select(cols).collect())
    assert got == brute_phrases(rows, least, top)


def test_phrases_of_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_long_text_is_numbered_in_parts(monkeypatch):
    text = ("word one,two\tThree " * 2000 + "endless" * 500).encode()
    whole = phrases.word_numbers(text, phrases._Numbers())
    monkeypatch.setattr(phrases, "_PART", 100)
    assert (phrases.word_numbers(text, phrases._Numbers()) == whole).all()


# -- 13 --------------------------------------------------------------------------------------------------------------


def brute_neighbours(rows, k=5):
    out = {}
    for q, v in rows:
        if q % 50 == 0:
            best = {}
            for i, w in rows:
                if i != q and len(w) == len(v):
                    x, y = np.array(v), np.array(w)
                    s = float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())))
                    best[i] = max(s, best.get(i, -2))
            out[q] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def answers(df):
    got = collections.defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return got


def test_neighbours_recall_and_scores(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF_SMALL.replace('0.001', '0.01')}/embeddings.parquet'").fetchall()
    expected = brute_neighbours(rows)
    got = answers(queries.op13_neighbours(spark, SF_SMALL.replace("0.001", "0.01")))
    assert got.keys() == expected.keys()
    shared = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert shared >= 0.95 * sum(map(len, expected.values()))
    by = dict(rows)
    for q, found in got.items():
        x = np.array(by[q], float)
        for i, s in found:
            y = np.array(by[i], float)
            assert s == pytest.approx((x @ y) / np.sqrt((x @ x) * (y @ y)), abs=1e-12)


def test_neighbours_in_small_shards_and_query_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(2000)]
    expected = brute_neighbours(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "SHARD_NUMBERS", 2000)
    monkeypatch.setattr(neighbours, "BLOCK_NUMBERS", 80)
    monkeypatch.setattr(neighbours, "_ASKED", 3)
    got = answers(neighbours.nearest(df, df.vec_id % 50 == 0))
    shared = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert shared >= 0.9 * 5 * len(expected)


def test_neighbours_of_odd_rows(spark):
    """Copies, scaled copies, ties, unusable vectors, other lengths, repeated ids, extreme sizes."""
    nan, inf = float("nan"), float("inf")
    v = [0.3, -0.7, 0.2]
    rows = [(0, v), (3, v), (1, [2 * x for x in v]), (2, v), (9, v), (8, v), (7, v), (7, v), (4, [-x for x in v]),
            (50, [1e-300, 2e-300, 0.0]), (51, [1e300, 2e300, 0.0]), (100, [1.0, 2.0]), (101, [2.0, 1.0]), (150, [1.0])]
    odd = [(200, None), (250, []), (300, [0.0, 0.0, 0.0]), (350, [nan, 1.0, 1.0]), (400, [inf, 1.0, 1.0]), (450, [None, 1.0, 1.0]), (None, v)]
    df = spark.createDataFrame([(r[1], r[0], 1.0, "x") for r in rows + odd],
                               "embedding array<double>, vec_id long, score double, `query.id` string")
    got = answers(neighbours.nearest(df, df.vec_id % 50 == 0))
    assert [i for i, _ in got[0]] == [1, 2, 3, 7, 8]
    assert len({s for _, s in got[0]}) == 1 and got[0][0][1] == pytest.approx(1.0)
    assert got[50][0][0] == 51 and got[50][0][1] == pytest.approx(1.0) and len(got[50]) == 5
    assert got[100] == [(101, pytest.approx(0.8))]
    assert set(got) == {0, 50, 100}
    assert neighbours.nearest(df.where("1 = 0"), df.vec_id % 50 == 0).collect() == []


def test_a_vector_shared_by_most_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 else [float(x) for x in rng.normal(size=4)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = answers(neighbours.nearest(df, df.vec_id % 50 == 0))
    for q in range(0, 3000, 50):
        if q % 3:
            assert [i for i, _ in got[q]] == [i for i in range(1, 12) if i % 3 and i != q][:5]


# -- all -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_collocations"])
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_SMALL}/{table}.parquet'")
    cur = con.execute(E.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    got = collections.Counter(tuple(r) for r in E.queries()[name](spark, SF_SMALL).select(cols).collect())
    assert got == collections.Counter(cur.fetchall()) and got
