"""Work that is done once: month layouts, shuffle files of written stages, filters above what they test, key tables."""

import datetime as dt
import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerweave.functions import normalize as N
from ledgerweave.operators import comments as CM
from ledgerweave.operators import consolidate as C
from ledgerweave.operators import lines as L
from ledgerweave.sources.scratch import materialize


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


MONTHS = {"Jan 2024": (2024, 1), "sep-1997": (1997, 9), "DEC-2024": (2024, 12), "May-2024": (2024, 5), "March 2024": (2024, 3),
          "June-2024": (2024, 6), "1/2024": (2024, 1), "12-2024": (2024, 12), "2024-02": (2024, 2), "2024/11": (2024, 11),
          "3 2024": (2024, 3), "2024 Apr": (2024, 4), "2024 April": (2024, 4), "012024": (2024, 1), "202402": (2024, 2),
          " Jan-2024\n": (2024, 1), "05-01-2024": (2024, 1), "anf 2024": None, "Jan_2024": None, "13/2024": None,
          "ebm-2024": None, "20245": None, "": None, "total": None}


def test_months_and_the_layouts_tried_for_them(spark):
    rows = spark.createDataFrame([(t,) for t in MONTHS], "t string")
    got = {r.t: r.d for r in rows.select("t", N.parse_month("t").alias("d")).collect()}
    assert got == {t: dt.date(*ym, 1) if ym else None for t, ym in MONTHS.items()}
    # a failed parse costs microseconds: a period takes a layout that can match, and the usual ones take none
    tried = [F.when(N._may_match(F.col("t"), f), F.lit(1)).otherwise(0) for f in N.MONTH_FORMATS]
    usual = rows.select("t", sum(tried, F.lit(0)).alias("n"), N._short_month(F.col("t")).isNotNull().alias("short")).collect()
    of = {r.t: (r.n, r.short) for r in usual}
    assert of["sep-1997"] == (2, True) and of["Jan 2024"] == (4, True) and of["2024/11"] == (2, False) and of["total"] == (0, False)


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    names = set()
    while files.hasNext():
        names.add(files.next().getName())
    return {n for n in names if n.startswith("shuffle_")}


def test_written_stages_leave_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    rows = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "leaves-nothing")
    assert not _shuffle_files(spark) - before and rows.count() == 7


def test_key_filters_stay_above_the_keys(spark):
    """Below them, the scan's filter would make the keys' texts and patterns a second time."""
    cells = spark.createDataFrame([(i, f"07ABCDE123{i}F1Z7", f"INV/{i}", "PR") for i in range(4)], "row_no long, gstin_raw string, inv_raw string, s string")
    cells = materialize(cells.withColumns({c: F.lit(None).cast("string") for c in L.B2_COLUMNS if c not in cells.columns}))
    lines = L.typed_b2_rows(cells.withColumn("sheet", F.lit("B2B")))
    for df in (C.row_numbers_by_key(lines, "r"), C.period_by_key(lines), C.consolidate_by_key(lines, ["gstin_raw"])):
        filters = re.findall(r"Filter .*(?:\n(?! *[:+]).*)*", _plan(df))
        assert filters and not any("regexp_replace" in f for f in filters), filters
    found = {(r.gst_key, r.inv_key, r.r) for r in C.row_numbers_by_key(lines, "r").collect()}
    assert found == {(f"07ABCDE123{i}F1Z7", f"INV/{i}", str(i)) for i in range(4)}


def test_where_computed_is_where(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None), (1, True)], "a int, b boolean")
    assert sorted(map(tuple, L.where_computed(rows, F.col("b")).collect())) == sorted(map(tuple, rows.where("b").collect()))


def test_first_letters_of_invoice_keys(spark):
    """The heads and leading zeros go where they went: the letters looked at first are those the patterns begin with."""
    texts = ["FY24-25/12", "FY-2024-25/7", "24-25/0012", "2024-25/A1", "fy24-25/3", "0012", "000", "0", "INV/1/24-25", "1234", "F2", "２4-25/1", "", "00A-1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", N.norm_invoice("t").alias("whole"), N.norm_text("t").alias("o"))
    for r in N.with_invoice_key(got, "o", "k").collect():
        assert r.k == r.whole, r


def test_the_report_lists_the_registers_rows_once(spark, monkeypatch):
    from ledgerweave.plans import queries as Q

    made = []
    monkeypatch.setattr(CM, "row_numbers_by_key", lambda lines, name, f=CM.row_numbers_by_key: made.append(name) or f(lines, name))
    assert Q.QUERIES["write_report"](spark, SF_SMALL).count() > 0
    assert sorted(made) == ["row_number_in_2b", "row_number_in_pr"]
