"""Quality rules as one projection.

The threshold table ``RULES`` is compiled into a single Spark expression over
counts that are computed with built-in functions only: no user function and
no shuffle.  A rule bounds a count in per cent of another one.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

#: Words of one repeated window.
WINDOW = 8
#: Base rule: fewest words, and highest share of words in repeated windows (per cent).
MIN_WORDS, MAX_REPEAT = 20, 30

# fixed values: frequent function words of the four languages
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which you "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie "
    "le la les des et un une du que est dans qui par pour pas sur se plus ne en ce il au avec son sont mais "
    "el los las del que y una por con para su al lo como más pero sus o este sí porque esta entre cuando muy"
).split()


class Rule(NamedTuple):
    name: str
    count: str
    of: str
    at_least: int | None
    at_most: int | None


#: (rule, count, base, lower and upper bound of 100 * count / base)
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols_to_words", "n_symbols", "n_words", None, 20),
    Rule("shouted_words", "n_shouted", "n_words", None, 30),
    Rule("echoed_words", "n_echoed", "n_words", None, 20),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("letters", "n_letter_words", "n_words", 50, None),
)

_SPACE = r"[ \t\n\x0B\f\r]+"


def _passes(rule: Rule) -> Column:
    scaled, base = F.col(rule.count) * 100, F.col(rule.of)
    checks = []
    if rule.at_least is not None:
        checks.append(scaled >= base * rule.at_least)
    if rule.at_most is not None:
        checks.append(scaled <= base * rule.at_most)
    return reduce(Column.__and__, checks)


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the counts that the rules use."""
    text, words, windows, order, at = (F.col(c) for c in ("text", "words", "windows", "order", "at"))
    docs = documents(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    split = docs.withColumn("words", F.array_remove(F.split(text, _SPACE), "")).withColumn(
        "lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")))
    hashed = split.withColumn("windows", F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))))
    #: sorted only where a window repeats
    ordered = hashed.withColumn("order", F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    found = ordered.withColumn("at", F.sort_array(F.filter(
        F.transform(order, lambda x, i: F.when((x["h"] == F.get(order, i - 1)["h"])
                                               | (x["h"] == F.get(order, i + 1)["h"]), x["at"])),
        lambda x: x.isNotNull())))
    n = F.size(words).cast("long")

    def count(test) -> Column:
        return F.size(F.filter(words, test)).cast("long")

    return found.select(
        "doc_id", n.alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(
            F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1), p + WINDOW) - p)),
            F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        count(lambda w: w.endswith("!!")).alias("n_shouted"),
        F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))).cast("long").alias("n_echoed"),
        count(lambda w: F.lower(w).isin(STOP_WORDS)).alias("n_stop_words"),
        count(lambda w: w.rlike(r"\p{L}")).alias("n_letter_words"))


def quality(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures, the base verdict, the names of failed rules and ``kept``.

    A null or empty text has no words and fails the base rule.  Rows are
    judged one by one, so repeated rows, ties and missing ids change nothing.
    """
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)
    failed = F.array_compact(F.array(*[F.when(~_passes(r), F.lit(r.name)) for r in rules]))
    out = measures(df, id_col, text_col).withColumn("base_failed", base).withColumn("failed_rules", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def oracle_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    checks = []
    for r in RULES:
        if r.at_least is not None:
            checks.append(f"100 * {r.count} >= {r.at_least} * {r.of}")
        if r.at_most is not None:
            checks.append(f"100 * {r.count} <= {r.at_most} * {r.of}")
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text,
             list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS covered
      FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(covered, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
             len(list_filter(words, lambda x: ends_with(x, '!!')))::BIGINT AS n_shouted,
             len(list_filter(words, lambda x, i: i > 1 AND x = words[i - 1]))::BIGINT AS n_echoed,
             len(list_filter(words, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
             len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words
      FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(checks)} AS kept FROM b"""
