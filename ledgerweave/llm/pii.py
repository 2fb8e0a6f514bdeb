"""Personal data: fixed patterns, and terms that disclose the entities found.

Built-in functions only.  Every e-mail address, IP address, card and phone
number found is an entity.  Corpus counts tell how much a term reveals of an
entity: with N rows, n(e) with the entity, n(t) with the term and n(t, e) with
both, wherever they stand in the text, the term discloses
``log(N n(t, e) / (n(t) n(e)))`` of the ``log(N / n(e))`` bits that identify
the entity.  Terms that disclose at least ``DISCLOSURE`` of them are removed
from the rows that name the entity, as the entity itself is.  A term is a
word outside the e-mail addresses, of ``TERM_LETTERS`` letters or, written as
a name (``Li``, or in a script without capitals), of any length.

Matches are found with ``regexp_extract_all`` and placed with ``split`` by the
same pattern: the pieces between them have the offsets.  The patterns use
possessive repeats and start only where a run of characters starts (or where
the last match ended); that gives the matches of the plain patterns in
time linear in the text, without Java's recursion on long runs.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, span_text, written


class Kind(NamedTuple):
    name: str
    pattern: str
    might: str  # cheap test that a text could hold one
    valid: str  # SQL over x, the matched text


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_DIGITS = "regexp_replace(x, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + CASE
    WHEN i % 2 = 1 THEN int(substr(reverse({_DIGITS}), i, 1))
    WHEN int(substr(reverse({_DIGITS}), i, 1)) > 4 THEN 2 * int(substr(reverse({_DIGITS}), i, 1)) - 9
    ELSE 2 * int(substr(reverse({_DIGITS}), i, 1)) END) % 10 = 0"""

KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         "instr(text, '@') > 0", "true"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"text rlike '[0-9]\\.[0-9]'",
         f"x rlike '^{_PART}(?:[.]{_PART}){{3}}$'"),
    # only runs of 16 digits or more can pass, and a run is matched whole
    Kind("card", r"[0-9](?:[\x20-]?+[0-9]){15,}+", "text rlike '[0-9][ -]?[0-9][ -]?[0-9]'",
         f"length({_DIGITS}) <= 19 AND {_LUHN}"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "instr(text, '+') > 0", f"length({_DIGITS}) BETWEEN 8 AND 15"),
)
TERM = "term"
#: Letters of a term that is not written as a name.
TERM_LETTERS = 3
_TERMS = rf"\p{{L}}{{{TERM_LETTERS},}}+|(?<!\p{{L}})[\p{{Lu}}\p{{Lt}}\p{{Lo}}]\p{{L}}*+"
#: Share of an entity's information from which a term is removed, and different texts it needs.
DISCLOSURE, MIN_TEXTS = 0.9, 3

_SPAN = "array<struct<kind:string,start:int,end:int>>"


#: Matches of one step of a running sum, code points of one piece of a text.
_STEP, _PIECE = 256, 4096


def _running(n: str, start: str, advance: str, row: str, make: str) -> str:
    """SQL: ``make`` of every i below ``n`` with ``a.at``, the running value before i.

    ``advance`` is the running value after i.  A fold that appends to one
    array copies it at every step; here steps of ``_STEP`` places are folded
    one by one, from the running value at their start, so the work grows with
    the number of places, not with its square."""
    last = f"int(least((b.c + 1) * {_STEP}, {n}) - 1)"
    fold = f"aggregate(sequence(int(b.c * {_STEP}), {last}), b.at, (s, i) -> {advance.replace('a.at', 's')})"
    return f"""CASE WHEN {n} > 0 THEN flatten(transform(
      aggregate(sequence(0, int(({n} - 1) div {_STEP})),
        named_struct('at', {start}, 'out', cast(array() AS ARRAY<STRUCT<c: INT, at: INT>>)),
        (t, c) -> named_struct('at', {fold.replace('b.c', 'c').replace('b.at', 't.at')},
                               'out', concat(t.out, array(named_struct('c', c, 'at', t.at)))),
        t -> t.out),
      b -> aggregate(sequence(int(b.c * {_STEP}), {last}),
        named_struct('at', b.at, 'found', cast(array() AS ARRAY<{row}>)),
        (a, i) -> named_struct('at', {advance}, 'found', concat(a.found, array(cast({make} AS {row})))),
        a -> a.found))) ELSE cast(array() AS ARRAY<{row}>) END"""


def _offsets(m: str, g: str, row: str, make: str) -> str:
    """SQL: ``make`` of every match i, with ``a.at`` the end of the match before; m the matches, g the text between them."""
    return _running(f"size({m})", "0", f"a.at + length({g}[i]) + length({m}[i])", row, make)


def _located(kind: Kind) -> Column:
    """ARRAY<STRUCT<value, start, end>> of the valid matches of one kind, from its columns m_ and g_."""
    m, g = f"m_{kind.name}", f"g_{kind.name}"
    every = _offsets(m, g, "STRUCT<value: STRING, start: INT, end: INT>",
                     f"named_struct('value', {m}[i], 'start', a.at + length({g}[i]), 'end', a.at + length({g}[i]) + length({m}[i]))")
    return F.expr(f"filter({every}, f -> exists(array(f.value), x -> {kind.valid}))")


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, spans, entities): base spans by kind and start, and the different entities.

    ``h`` hashes the text, so rows with equal ids are told apart.
    """
    docs = documents(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    none = F.expr("cast(array() AS ARRAY<STRING>)")
    matched = docs.select("doc_id", F.xxhash64("text").alias("h"), *[
        F.when(F.expr(k.might), value).otherwise(none).alias(f"{prefix}_{k.name}") for k in KINDS for prefix, value in (
            ("m", F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))), ("g", F.split("text", k.pattern, -1)))])
    located = matched.select("doc_id", "h", *[_located(k).alias(k.name) for k in KINDS])

    def spans(k: Kind) -> Column:
        return F.transform(k.name, lambda x: F.struct(F.lit(k.name).alias("kind"), x["start"].alias("start"),
                                                      x["end"].alias("end")))

    def entities(k: Kind) -> Column:
        return F.transform(k.name, lambda x: F.concat_ws(":", F.lit(k.name), F.lower(x["value"])))

    return located.select("doc_id", "h", F.concat(*map(spans, KINDS)).alias("spans"),
                          F.array_distinct(F.concat(*map(entities, KINDS))).alias("entities"))


def term_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n_rows) over all rows; summed in every task before the shuffle."""
    letters = F.lit(r"\p{L}+")
    words = df.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(df[text_col]), letters, F.lit(0)))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n_rows"))


def named_rows(base: DataFrame) -> DataFrame:
    """(doc_id, h, entity): a row for each entity of each row."""
    return base.where(F.size("entities") > 0).select("doc_id", "h", F.explode("entities").alias("entity"))


def disclosing(docs: DataFrame, base: DataFrame, counts: DataFrame, n_rows: int, disclosure: float = DISCLOSURE,
               min_texts: int = MIN_TEXTS) -> DataFrame:
    """(entity, term, share): terms that disclose at least ``disclosure`` of an entity's information.

    n(e), n(t) and n(t, e) count all rows, repeated ones and those without an
    id too.  Only entities in ``min_texts`` different texts can have a term, so
    only texts that name one of those are read for words, each text once.
    """
    per_text = named_rows(base).groupBy("entity", "h").agg(F.count("*").alias("rows"))
    entities = written(per_text.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("rows").alias("n_entity"))
                       .where(F.col("texts") >= min_texts).drop("texts"), "pii-entities")
    per_text = written(per_text.join(entities.select("entity"), "entity"), "pii-texts")
    outside = F.regexp_replace("text", F.lit(KINDS[0].pattern), F.lit(" "))  # no other kind has letters
    words = docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).join(
        per_text.select("h").distinct(), "h", "left_semi").dropDuplicates(["h"]).select("h", F.array_distinct(F.transform(
            F.regexp_extract_all(outside, F.lit(_TERMS), F.lit(0)), F.lower)).alias("terms"))
    pairs = per_text.join(words, "h").select("entity", "rows", F.explode("terms").alias("term")).groupBy("entity", "term").agg(
        F.count("*").alias("texts"), F.sum("rows").alias("together")).where(F.col("texts") >= min_texts)
    known = written(written(pairs, "pii-pairs").join(counts, "term"), "pii-known").join(entities, "entity")
    information = F.log(F.lit(float(n_rows)) / F.col("n_entity"))
    told = F.log(F.lit(float(n_rows)) * F.col("together") / (F.col("n_rows") * F.col("n_entity")))
    return known.withColumn("share", told / information).where(
        (information > 0) & (F.col("share") >= disclosure)).select("entity", "term", "share")


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, spans, terms) for every row: ``spans`` of the base kinds, ``terms`` the spans of disclosing terms.

    A null text is empty.  Repeated rows give repeated results; for the
    counts a text that occurs in several rows is several rows but one text.
    """
    docs = documents(df, id_col, text_col)
    base = written(found(df, id_col, text_col), "pii-base")
    terms = disclosing(docs, base, term_counts(docs), base.count())
    terms = written(terms, "pii-terms")
    marked = named_rows(base).join(terms.select("entity", "term"), "entity").groupBy("doc_id", "h").agg(
        F.sort_array(F.collect_set("term")).alias("words"))
    marked = written(marked, "pii-marked")
    texts = docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = texts["doc_id"].eqNullSafe(marked["doc_id"]) & (texts["h"] == marked["h"])
    hit = texts.join(marked, same).select(texts["doc_id"], texts["h"], "text", "words").dropDuplicates(["doc_id", "h"])
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("words", "|"), F.lit(r")(?!\p{L})"))
    hit = hit.withColumn("pattern", pattern).select(
        "doc_id", "h", F.expr("regexp_extract_all(text, pattern, 0)").alias("m"), F.expr("split(text, pattern, -1)").alias("g"))
    every = _offsets("m", "g", "STRUCT<kind: STRING, start: INT, end: INT>",
                     f"named_struct('kind', '{TERM}', 'start', a.at + length(g[i]), 'end', a.at + length(g[i]) + length(m[i]))")
    placed = hit.select(hit["doc_id"].alias("_id"), hit["h"].alias("_h"), F.expr(every).alias("terms"))
    placed = written(placed, "pii-placed")
    joined = base.join(placed, base["doc_id"].eqNullSafe(placed["_id"]) & (base["h"] == placed["_h"]), "left")
    return joined.select("doc_id", "h", "spans", F.coalesce("terms", F.expr(f"cast(array() AS {_SPAN})")).alias("terms"))


def sanitised(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): entities generalised to their kind, disclosing terms removed (``[TERM]``).

    Overlapping spans become one mark, that of the first.
    """
    docs = documents(df, id_col, text_col).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    marks = personal_data(df, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.sort_array(
        F.transform(F.concat("spans", "terms"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                                   s["kind"].alias("kind")))).alias("marks")).distinct()
    joined = docs.join(marks, docs["doc_id"].eqNullSafe(marks["_id"]) & (docs["h"] == marks["_h"]), "left")
    # a mark counts if it starts at or behind the end of all before it; the text between is cut from pieces of the text
    cuts = _running("size(marks)", "0", "greatest(a.at, marks[i].end)", "STRUCT<at: INT, start: INT, kind: STRING>",
                    "named_struct('at', a.at, 'start', marks[i].start, 'kind', marks[i].kind)")
    cut = joined.select("doc_id", "text", F.coalesce("marks", F.expr(f"cast(array() AS {_MARKS})")).alias("marks"),
                        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)).alias("pieces")).select(
        "doc_id", "text", "marks", "pieces", F.expr(cuts).alias("cuts"))
    done = F.expr(f"""concat(
      array_join(transform(filter(cuts, c -> c.start >= c.at), c -> concat({_between('c.at', 'c.start')}, '[', upper(c.kind), ']')), ''),
      aggregate(array(array_max(transform(marks, s -> s.end))), '', (o, e) -> {_between('e', 'length(text)')}))""")
    return cut.select("doc_id", F.when(F.col("text").isNull() | (F.size("marks") == 0), F.col("text")).otherwise(done).alias("text"))


_MARKS = "ARRAY<STRUCT<start: INT, end: INT, kind: STRING>>"


def _between(a: str, b: str) -> str:
    """SQL: the text from code point ``a`` up to ``b``, without a walk from its beginning."""
    pa, pb = f"int({a} div {_PIECE})", f"int({b} div {_PIECE})"
    return f"""CASE WHEN {a} >= {b} THEN ''
      WHEN {pa} = {pb} THEN substr(pieces[{pa}], int({a} % {_PIECE}) + 1, {b} - {a})
      ELSE concat(substr(pieces[{pa}], int({a} % {_PIECE}) + 1), array_join(slice(pieces, {pa} + 2, {pb} - {pa} - 1), ''),
                  CASE WHEN {b} % {_PIECE} = 0 THEN '' ELSE substr(pieces[{pb}], 1, int({b} % {_PIECE})) END) END"""


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: span_text(s["kind"], s["start"], s["end"])), ",")
