"""Plan properties: native expressions only, no cartesian / nested-loop
joins, pruned and filtered scans."""

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL
from ledgerweave.plans.queries import QUERIES

BANNED = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udf_or_cartesian(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    plan = _plan(df)
    for b in BANNED:
        assert b not in plan, f"{name}: {b} in plan"


def test_scan_prunes_columns_and_pushes_filters(spark):
    from ledgerweave.sources import derived as D
    from ledgerweave.operators.lines import typed_pr_lines

    df = D.pr_landing_unnumbered(D.base_lines(spark, SF_SMALL))
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(l_orderkey)" in plan
    # lineitem columns that no rule reads are never scanned
    assert "l_commitdate" not in plan and "l_comment" not in plan
    assert typed_pr_lines(df) is not None


def test_outer_join_reuses_the_aggregation_exchanges(spark):
    """A1 + W1 + J1: one hash exchange on (gst_key, inv_key) per side, none
    added by the sort-merge join itself."""
    import re

    from ledgerweave.operators import pairing as P
    from ledgerweave.plans.reconcile import get_run

    run = get_run(spark, SF_SMALL)
    joined = P.outer_join(P.suffix_pr(run.pr_cons), P.suffix_2b(run.b2_cons))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "FullOuter" in plan
    key_exchanges = re.findall(r"Exchange hashpartitioning\(gst_key#\d+, inv_key#\d+", plan)
    assert len(key_exchanges) == 2, plan


def test_hot_keys_of_comment_joins_are_split(spark):
    """90 % of the lines on one key: the joins of J5-J8 read two tables, so AQE splits the hot partition."""
    from pyspark.sql import functions as F

    from ledgerweave.operators import comments as CM
    from ledgerweave.operators import dormant as DO
    from ledgerweave.plans.reconcile import get_run
    from ledgerweave.sources.scratch import materialize

    run = get_run(spark, SF_SMALL)
    hot = run.status.where("mapping = 'Matched'").select("gst_key", "inv_key").first()
    lines = run.pr_raw.crossJoin(spark.range(40).select(F.col("id").alias("_n")))  # more lines, for the test only
    on_key = F.col("_n") < 36
    lines = materialize(lines.withColumn("gst_key", F.when(on_key, F.lit(hot.gst_key)).otherwise(F.col("gst_key")))
                        .withColumn("inv_key", F.when(on_key, F.lit(hot.inv_key)).otherwise(F.col("inv_key"))).drop("_n").repartition(16))
    # many map tasks, since a partition is split between their outputs
    settings = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "64k",
                "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for df in (CM.pr_comments(lines, run.b2_lines, run.status), DO.lookup_reconcile(lines, run.b2_lines)):
            df.collect()
            assert "skew=true" in _plan(df)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_status_lookup_needs_no_shuffle(spark):
    from ledgerweave.operators import pairing as P
    from ledgerweave.plans.reconcile import get_run

    plan = P.status_lookup(get_run(spark, SF_SMALL).pairs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(gst_key" not in plan


def test_output_casts_match_spark_schemas(spark):
    """The SQL twins cast exactly the columns the Spark side normalises."""
    from pyspark.sql.types import DateType, DecimalType

    from ledgerweave.plans.output_casts import OUTPUT_CASTS

    for name, fn in QUERIES.items():
        schema = fn(spark, SF_SMALL).schema
        dec = [f.name for f in schema.fields if isinstance(f.dataType, DecimalType)]
        dat = [f.name for f in schema.fields if isinstance(f.dataType, DateType)]
        want = OUTPUT_CASTS.get(name, {"double": [], "date": []})
        assert (dec, dat) == (want["double"], want["date"]), name
        out = E.queries()[name](spark, SF_SMALL).schema
        assert not any(isinstance(f.dataType, (DecimalType, DateType)) for f in out.fields), name
