"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import decontaminate as DEC
from . import langid as LANG
from . import neighbours as NEI
from . import phrases as PHR
from . import pieces as PIE
from . import pii as PII
from . import quality as QUA
from . import secrets as SEC
from . import simhash as SIM
from . import substring as SUB
from . import tokens as TOK
from . import toxicity as TOX
from . import trie as TRI
from .common import id_remainder


def _docs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", ["doc_id", "text", *more])


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = DEC.contamination(_docs(spark, sf_dir), read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PIE.encode_pieces(_docs(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = TOX.learn(_docs(spark, sf_dir), read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]))
    out = TOX.score(_docs(spark, sf_dir), model)
    return out.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
                      F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUA.quality(_docs(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = SEC.secret_spans(_docs(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] != "guess")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *(count(k) for k in SEC.KINDS[:3]), F.sha2(SEC.joined(base), 256).alias("base_sha256"),
                      SEC.joined(F.col("spans")).alias("spans"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = SIM.near_duplicates(_docs(spark, sf_dir))
    return out.select("doc_id", SIM.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    dicts = LANG.dictionaries(_docs(spark, sf_dir, "lang"))
    out = LANG.detect(_docs(spark, sf_dir), dicts)
    return out.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred",
                      F.col("lang_score").alias("score"), F.col("lang_margin").alias("margin"),
                      F.col("lang_rejected").alias("rejected"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = SUB.substring_dedup(_docs(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = PII.personal_data(_docs(spark, sf_dir))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *(count(k.name) for k in PII.KINDS), F.sha2(PII.joined_spans(F.col("spans")), 256).alias("base_sha256"),
                      PII.joined_spans(F.concat("spans", "terms")).alias("spans"))


def op10_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TOK.token_pack(_docs(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TRI.prefix_trie(read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PHR.collocations(read_table(spark, sf_dir, "documents", ["lang", "text"]))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return NEI.nearest(rows, F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_secrets": op5_secrets,
    "op6_simhash": op6_simhash,
    "op7_langid": op7_langid,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_pii": op9_pii,
    "op10_token_pack": op10_token_pack,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_neighbours": op13_neighbours,
}

ORACLE: dict[str, str] = {
    "op1_decontaminate": DEC.oracle_sql(),
    "op4_quality": QUA.oracle_sql(),
    "op8_substring_dedup": SUB.oracle_sql(),
    "op11_prefix_trie": TRI.oracle_sql(),
    "op12_collocations": PHR.oracle_sql(),
}
