"""Distributed ordinals and top-n equal their single-window definitions,
also when one group holds most rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerweave.operators.ordinal import dense_ordinal, first_n_per_group, rank_in_group


def _skewed(spark, n=5000):
    # group 0 holds about two thirds of the rows
    return spark.range(n).select(
        F.when(F.col("id") % 3 != 0, F.lit(0)).otherwise(F.col("id") % 17).alias("g"),
        ((F.col("id") * 7919) % n).alias("k"), F.col("id"))


def test_dense_ordinal_matches_row_number(spark):
    df = _skewed(spark)
    got = {r.id: r.o for r in dense_ordinal(df, ["k", "id"], name="o", start=1).collect()}
    want = {r.id: r.o for r in df.select("id", F.row_number().over(Window.orderBy("k", "id")).alias("o")).collect()}
    assert got == want


def test_rank_in_group_matches_window(spark):
    df = _skewed(spark).repartition(7)
    got = {r.id: r.r for r in rank_in_group(df, ["g"], ["k", "id"], name="r").collect()}
    w = Window.partitionBy("g").orderBy("k", "id")
    want = {r.id: r.r for r in df.select("id", F.row_number().over(w).alias("r")).collect()}
    assert got == want


def test_first_n_per_group_matches_window(spark):
    df = _skewed(spark)
    got = sorted((r.g, r.id, r.r) for r in first_n_per_group(df, ["g"], [F.col("k").desc(), F.col("id")], 50,
                                                              salt_from=["id"], name="r").collect())
    w = Window.partitionBy("g").orderBy(F.col("k").desc(), F.col("id"))
    want = sorted((r.g, r.id, r.r) for r in df.select("g", "id", F.row_number().over(w).alias("r"))
                  .where("r <= 50").collect())
    assert got == want
