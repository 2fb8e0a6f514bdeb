"""Corpus pipeline: every stage is one operator applied to all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of
``documents``, but for the last, which returns the encoded documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm import decontaminate, langid, pieces, secrets, simhash
from ledgerweave.session import scratch_path
from ledgerweave.sources.tables import read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not told with a clear margin go (so do null texts and those without a letter)."""
    samples = langid.dictionaries(docs)
    found = langid.detect(docs, samples, prefix="_lw_")
    return found.where("not _lw_rejected").select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the smallest doc_id."""
    return simhash.one_of_each(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.uncontaminated(docs, read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets give way to a mark, and n_chars follows the new text."""
    clean = secrets.redacted(docs).drop("_lw_secrets")
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.length("text").cast(kind)).select(*[f"`{c}`" for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The N best piece segmentations of every document."""
    return pieces.encode_pieces(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode),
]

#: SQL cannot express compression, SimHash, guess costs or piece lattices; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = scratch_path(spark, "pipeline", f"{name}-{uuid.uuid4().hex}")
        out.write.mode("errorifexists").parquet(path)
        docs = spark.read.parquet(path)
    return docs
