"""The numbered lines: only facts are sorted and written, and every sheet's rows are numbered in line order."""

from datetime import date, datetime

from pyspark.sql import functions as F

from ledgerweave.functions import normalize as N
from ledgerweave.plans.reconcile import Run
from ledgerweave.session import SORT_SPLIT, SPLIT_CONF, sorting_splits
from ledgerweave.sources import derived as D
from ledgerweave.sources.scratch import materialize


def _tables(spark, path) -> str:
    orders = [(k, datetime(1996, 1 + k % 12, 1 + k % 28)) for k in range(1, 181)]
    lines = [(k, n, 7 * k % 11, k % 3, float(n), 100.0 + k, 0.05, 0.1, "R" if (k + n) % 2 else "N", "O" if n % 2 else "F", datetime(1996, 5, 1 + n))
             for k, _d in orders for n in range(1, 2 + k % 5)]
    lines += lines[40:80]  # rows that come twice
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
                          ).repartition(5).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(k, f"Vendor {k}") for k in range(7)], "s_suppkey long, s_name string").write.parquet(f"{path}/supplier.parquet")
    return str(path)


def test_rows_are_numbered_in_line_order(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several sorted partitions
    try:
        run = Run(spark, _tables(spark, tmp_path))
        rows = run.lines.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert not set(run.lines.columns) & {*D.PR_COLUMNS, *D.B2_COLUMNS}  # no text cell is sorted or written
    rows.sort(key=lambda r: tuple(r[c] for c in D.LINE_ORDER))

    def in_b2(r, note):
        return r.ok % 20 != 7 and (r.l_returnflag == "R" and r.ok % 4 == 1) == note

    has = {"PR": lambda r: r.ok % 20 != 3, "B2B": lambda r: in_b2(r, False), "B2B-CDNR": lambda r: in_b2(r, True),
           "IMPG": lambda r: r.ok % 37 == 0 and r.l_linestatus == "O"}
    for i, (sheet, test) in enumerate(has.items()):
        marked = [r[f"_n{i}"] for r in rows if test(r)]
        first = D.PR_FIRST_ROW if sheet == "PR" else D.PORTAL_FIRST_ROW
        assert marked and sorted(marked) == [*range(first, first + len(marked))]
        keys = {}
        for r in rows:
            if test(r):
                keys.setdefault(tuple(r[c] for c in D.LINE_ORDER), []).append(r[f"_n{i}"])
            else:
                assert r[f"_n{i}"] is None
        ends = [max(v) for _k, v in sorted(keys.items())]
        assert ends == sorted(ends)  # rows of a lesser key come first
        table = run.pr_landing if sheet == "PR" else run.b2_landing.where(f"sheet = '{sheet}'")
        assert sorted(r.row_no for r in table.select("row_no").collect()) == sorted(marked)
    assert {r.inv_date for r in rows if r.ok == 5} == {date(1996, 6, 6)}


def test_keys_dates_and_amounts_equal_the_rules_on_odd_texts(spark):
    """The typed columns equal N2 to N5 stated without short cuts, whatever white space, sign or layout a cell has."""
    cells = [None, "", " ", "0", "00", "007", "inv/5/24-25", "FY2024-25/8", "20242025/9", "a b", "x y", "é 1", "1,2.00", "₹1,234.5",
             "-3.005", "05-06-2024", "5-6-2024", "31-02-2024", "01-01-0000", "2024-06-05", "05/06/2024", "05-06-2024 ", "45000", "0　"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    keyed = N.with_invoice_key(df.select("c", N.norm_text("c").alias("t"), N.trimmed("c").alias("d")), "t", "key")
    day = F.to_date(F.try_to_timestamp("d", F.lit("d-M-yyyy")))
    got = keyed.select("*", N.norm_invoice("c").alias("n3"), N.drop_ws(F.col("c")).alias("bare"), F.translate("c", N.WS, "").alias("bare2"),
                       N.amount_of_cell("c").alias("a"), N.parse_amount("c").alias("n5"), N.parse_date("c").cast("string").alias("n4"), day.cast("string").alias("day")).collect()
    for r in got:
        assert r["key"] == r["n3"], r
        assert r["bare"] == r["bare2"], r
        assert r["a"] == r["n5"], r
        assert r["day"] is None or r["n4"] == r["day"], r


def test_splits_are_small_while_sorted_stages_are_written(spark):
    before = spark.conf.get(SPLIT_CONF)
    with sorting_splits(spark):
        assert spark.conf.get(SPLIT_CONF) == SORT_SPLIT
    assert spark.conf.get(SPLIT_CONF) == before


def test_files_of_a_written_stage_are_bounded(spark):
    rows = materialize(spark.range(0, 2500, 1, 1), "bounded", rows_per_file=1000)
    assert len(rows.inputFiles()) == 3 and rows.count() == 2500
