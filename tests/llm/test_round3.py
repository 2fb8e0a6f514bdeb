"""Long texts, odd columns, partition counts and brute-force scores of the earlier operators."""

import collections
import math
import random
import re
import zlib

import pytest
import zstandard

import corpus_pipeline
from ledgerweave.llm import decontaminate, langid, pii, secrets, tokens, toxicity

# -- 1 ---------------------------------------------------------------------------------------------------------------


def test_windows_of_many_items_equal_brute_force():
    rnd = random.Random(2)
    voc = ["a", "b", "c", "d7", "ß", "東"]
    items = [(i, " ".join(rnd.choice(voc) for _ in range(rnd.randrange(0, 9)))) for i in range(60)]
    bench = decontaminate.Benchmark(items, 4)
    for _ in range(200):
        text = ", ".join(rnd.choice(voc + ["zz"]) for _ in range(rnd.randrange(0, 25)))
        words, hit, found = text.split(", ") if text else [], set(), set()
        for i, item in items:
            own = item.split()
            for w in {tuple(own[k:k + 4]) for k in range(max(1, len(own) - 3))} - {()}:
                for k in range(len(words) - len(w) + 1):
                    if tuple(words[k:k + len(w)]) == w:
                        hit |= set(range(k, k + len(w)))
                        found.add(i)
        n, runs, got = bench.scan(text)
        assert n == len(words) and {p for a, b in runs for p in range(a, b)} == hit and got == found


def test_a_worker_keeps_one_automaton():
    one = decontaminate.kept("x", [(1, "a b c")], 2)
    assert decontaminate.kept("x", [], 2) is one
    assert decontaminate.kept("y", [(2, "d e")], 2) is not one and len(decontaminate._KEPT) == 1


# -- 5 ---------------------------------------------------------------------------------------------------------------

ORDINARY = ["internationalization", "straightforward", "notwithstanding", "Grundstücksverkehr", "wissenschaftlich",
            "Geschwindigkeitsbegrenzung", "Krankenversicherung", "mantenimiento", "desarrolladores", "responsabilidad",
            "malheureusement", "développement", "environnement", "https://example.org/a/b", "https://example.org/docs/api/v2/index.html",
            "/etc/app/credentials/main.yml", "C:\\Users\\name\\passwords.txt", "./config/secret_store.json", "~/keys/id_rsa"]


@pytest.mark.parametrize("value", ORDINARY)
def test_ordinary_words_and_places_stay(value):
    for text in (f"pwd: {value}", f'secret = "{value}"', f"auth: {value}"):
        assert not secrets.guess_spans(text, []), text


@pytest.mark.parametrize("text, value", [
    ("Authorization: Bearer abcDEF123ghiJKL456", "abcDEF123ghiJKL456"), ('"authorization": "Bearer abcDEF123ghiJKL456"', "abcDEF123ghiJKL456"),
    ("auth: Basic dXNlcjpwYXNzd29yZDEyMw==", "dXNlcjpwYXNzd29yZDEyMw=="),
    ("token = https://example.org/hook/T0A9xZ/Xk29dLmPq7rS", "https://example.org/hook/T0A9xZ/Xk29dLmPq7rS")])
def test_tokens_behind_a_scheme_or_in_an_address(text, value):
    assert value in [text[a:b] for a, k, b in secrets.find_secrets(text) if k == "guess"]


def test_columns_with_a_dot(spark):
    df = spark.createDataFrame([(1, "pwd: k8#Vq!2z", "x", 3)], "doc_id long, text string, `a.b` string, n_chars int")
    out = secrets.redacted(df)
    assert out.columns == [*df.columns, "_lw_secrets"] and out.first()["text"] == "pwd: [SECRET]"
    assert corpus_pipeline.redact_secrets(spark, df, "").first().asDict() == {"doc_id": 1, "text": "pwd: [SECRET]", "a.b": "x", "n_chars": 13}


def test_every_stage_takes_names_with_a_dot(spark):
    from conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumnRenamed("source", "a.b").withColumnsRenamed({"lang": "lang"})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() == docs.count()


# -- 7 ---------------------------------------------------------------------------------------------------------------


def brute_classify(samples, text):
    """Sizes by a compressor made anew for every dictionary; (language, sizes of the deciding step)."""
    def sizes(of):
        out = []
        raw = langid.normalised(text)
        for lang, dicts in of:
            total = 0
            for texts in dicts:
                d = zstandard.ZstdCompressionDict(b" ".join(texts).ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                c = zstandard.ZstdCompressor(dict_data=d, level=langid.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
                total += sum(len(c.compress(raw[i:i + langid.BLOCK_BYTES])) for i in range(0, len(raw), langid.BLOCK_BYTES))
            out.append((total / len(dicts), lang))
        return sorted(out)

    first = sizes([(lang, [t]) for lang, t in sorted(samples.items())])
    if first[1][0] < first[0][0] * (1 + langid.NARROW):
        first = sizes([(lang, [t[i::langid.DRAWS] for i in range(min(langid.DRAWS, len(t)))]) for lang, t in sorted(samples.items())])
    return first


def test_languages_are_the_smallest_sizes(spark):
    rnd = random.Random(8)
    words = {"aa": ["the", "of", "and", "water", "house"], "bb": ["der", "und", "wasser", "haus", "die"], "cc": ["agua", "la", "de", "casa", "y"]}
    samples = {lang: [langid.normalised(" ".join(rnd.choice(w) for _ in range(30))) for _ in range(20)] for lang, w in words.items()}
    own = langid.Classifier(samples)
    texts = [" ".join(rnd.choice(words[rnd.choice("abc") * 2]) for _ in range(rnd.choice([1, 2, 5, 40]))) for _ in range(150)]
    texts += ["the der", "xyz", "agua " * 3000]
    narrow = 0
    for t in texts:
        (best, lang), (second, _) = brute_classify(samples, t)[:2]
        assert own.classify(t) == (lang, second / (best + second), second / best - 1)
        narrow += second / best - 1 < langid.MARGIN
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert langid.detect(df, samples).where("lang_rejected").count() == narrow > 0


def test_dictionaries_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(langid, "TOTAL_CHARS", 4 * langid.SAMPLE_CHARS)
    df = spark.createDataFrame([(i, f"text {i}", "xy"[i % 2]) for i in range(60)], "doc_id long, text string, lang string")
    assert {lang: len(t) for lang, t in langid.dictionaries(df).items()} == {"x": 2, "y": 2}


# -- 9 ---------------------------------------------------------------------------------------------------------------


def test_many_matches_in_one_text(spark):
    """Two hundred thousand addresses: every one found and placed, in time that grows with their number."""
    n = 200_000
    text = " ".join(f"u{i}@m{i % 50}.example.org," for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = pii.found(df).select("spans").first()["spans"]
    assert len(spans) == n and all(text[s.start:s.end] == f"u{i}@m{i % 50}.example.org" for i, s in enumerate(spans))


@pytest.mark.parametrize("step, piece", [(256, 4096), (2, 3)])
def test_running_sums_and_pieces(spark, monkeypatch, step, piece):
    monkeypatch.setattr(pii, "_STEP", step)
    monkeypatch.setattr(pii, "_PIECE", piece)
    texts = ["", "no match", "a@b.co", "😀 a@b.co, +49 30 1234567 é 10.0.0.1 x@y.zz end", "1.2.3.4 " * 9 + "a@b.co", "a@b.co" + " " * 9 + "c@d.ee"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    for r in pii.found(df).collect():
        text, out, at = texts[r.doc_id], [], 0
        for start, end, kind in sorted((s.start, s.end, s.kind) for s in r.spans):
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        assert got[r.doc_id] == "".join([*out, text[at:]])


# -- 10 --------------------------------------------------------------------------------------------------------------


def test_equal_ids_stand_alike_for_any_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, t) for t in ("aa bb cc dd ee ff gg zz".split() * 2)] + [(None, "q"), (0, "r")], "doc_id long, text string")
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            path = str(tmp_path / str(n))
            tokens.write_tokens(df, path)
            seen.append(collections.Counter(tuple(r) for r in tokens.read_tokens(spark, path).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]
    assert tokens.read_document(spark, path, 0) and tokens.read_document(spark, path, 5) == []


# -- 3 ---------------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def brute_score(model, text):
    """The score of a text without digits or marks inside words, straight from the definitions."""
    low = text.lower()
    words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", low)]
    sums, n = [0.0, 0.0], 0.0
    for i, (w, start, end) in enumerate(words):
        exact = max([t.weight for t in model.terms if (w.startswith(t.text) if t.stem else w == t.text)], default=0.0)
        near = max([t.weight for t in model.terms if not t.stem and len(t.text) >= toxicity.FUZZY_LENGTH and edits(w, t.text) == 1
                    and w not in model.ordinary], default=0.0)
        if not exact and not near:
            continue
        first, last = max(0, i - toxicity.CONTEXT), min(len(words), i + 1 + toxicity.CONTEXT)
        left = low[words[first - 1][2] if first else 0:start]
        right = low[end:words[last][1] if last < len(words) else len(low)]
        marks = [re.sub(r"[^\W\d_]", "", side) for side in (left, right)]
        window = {x for x, _, _ in words[first:i] + words[i + 1:last]}
        window |= {'"'} if all(re.search("[\"“”„«»‹›‘]", m) for m in marks) else set()
        odds = toxicity.WINDOW_ODDS + sum(model.context[x] for x in window if x in model.context)
        rest = window - set(model.context)
        odds += (toxicity.QUOTED if '"' in rest else 0) + (toxicity.REPORT if rest & toxicity._REPORT else 0) + (
            toxicity.ADDRESS if rest & toxicity._ADDRESS else 0)
        sums[odds > 0] += exact or toxicity.NEAR * near
        n += 1.0 if exact else toxicity.NEAR
    x = [math.log1p(sums[0]), math.sqrt(n / (len(words) + toxicity.SMALL_TEXT)), math.log1p(sums[1])]
    return 1 / (1 + math.exp(-max(-30, min(30, model.weights[-1] + sum(a * b for a, b in zip(model.weights, x))))))


def toxic_texts(rnd, n):
    """Toxic: an insult. Clean: none, or one that a critic tells of."""
    plain = "water house garden music river stone bread paper window street morning evening".split()
    insults = ["numbskull", "dimwit", "blockhead"]
    rows = []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randrange(8, 20))]
        kind = i % 8
        at = rnd.randrange(len(words))
        if kind < 3:
            words.insert(at, rnd.choice(insults))
        elif kind == 3:
            words[at:at] = ["reviewer", rnd.choice(insults), "scene"]
        rows.append((i, " ".join(words), int(kind < 3)))
    return rows


def test_the_window_is_learned_and_scores_follow_the_definitions(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MIN_RATIO", 2.0)  # a quarter of the texts with an insult are clean
    rnd = random.Random(6)
    rows = toxic_texts(rnd, 1600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert model.context["reviewer"] > 1 and model.context["scene"] > 1
    got = {r.doc_id: r.toxic_score for r in toxicity.score(docs, model).collect()}
    texts = [t for _, t, _ in rows[:160]] + ["", "numbskul", "a “dimwit” said", "you dimwit said he", '"blockhead" you', "reviewer dimwitt scene"]
    own = model.scorer()
    assert [own(t) for t in texts] == pytest.approx([brute_score(model, t) for t in texts])
    held = [(got[i] >= 0.5, y, t) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p == bool(y) for p, y, _ in held) >= 0.97 * len(held)
    told = [p for p, y, t in held if not y and "reviewer" in t]
    assert len(told) > 20 and sum(told) <= 0.05 * len(told)


def test_odds_are_learned_beyond_chance_only():
    assert toxicity.learn_context([("a", 90, 1), ("b", 1, 90), ("c", 10, 10), ("d", 1, 0)], 100, 100).keys() == {"a", "b"}
    assert toxicity.learn_context([("a", 90, 0)], 100, 0) == {}
    learned = toxicity.learn_context([("you", 1, 90)], 100, 100)["you"]  # what was known gives way
    assert learned > 2


# -- workers ---------------------------------------------------------------------------------------------------------


def test_a_worker_keeps_the_models_of_one_operator():
    from ledgerweave.llm import common, pieces

    pieces.lattice(pieces.default_model(), 1)
    decontaminate.kept("z", [(1, "a b c")], 2)
    common.let_go("decontaminate")
    assert not pieces._LATTICES and decontaminate._KEPT
    secrets.words_of()
    common.let_go("")
    assert not decontaminate._KEPT and not secrets._VOCABULARIES and not common._KEPT
    assert secrets.words_of().rank
