"""Uploads: files, consolidation, typing, column pools; published tables and the run log."""

import uuid

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import review as RV
from ledgerweave.operators import schema_match as SM
from ledgerweave.sources import files as X
from ledgerweave.sources import ingest as IG
from ledgerweave.sources import sinks as SK
from ledgerweave.sources.scratch import clean_up, materialize


@pytest.mark.parametrize("kind", ["cells", "csv"])
def test_rows_are_numbered_where_they_are_read(spark, tmp_path, kind):
    rows = spark.range(1, 3001).select(F.col("id").alias("row_no"), F.array(
        F.col("id").cast("string"), F.when(F.col("id") % 7 == 0, F.lit('a,"b"')).when(F.col("id") % 5 == 0, F.lit(" x ")),
        F.lit(None).cast("string")).alias("cells"))
    write = {"cells": X.write_cells, "csv": X.write_csv}[kind]
    write(rows, str(tmp_path), "book 1+%.xlsx", "S ", 4)
    write(rows, str(tmp_path), "book2.xlsx", "T", 1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # many blocks a file
        got = X.read_sheets(spark, str(tmp_path), kind)
        assert "Sort [" not in got._jdf.queryExecution().executedPlan().toString()
        out = got.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for book, sheet in (("book 1+%.xlsx", "S "), ("book2.xlsx", "T")):
        own = {r.row_no: r.cells for r in out if (r.workbook, r.sheet) == (book, sheet)}
        assert set(own) == set(range(1, 3001))
        assert all(c[0] == str(n) and c[1] == ('a,"b"' if n % 7 == 0 else " x " if n % 5 == 0 else None) and c[2] is None for n, c in own.items())


def test_csv_cells(spark):
    lines = ["a,b", ",a,", "", '"x, y","say ""no""",z', '"a"b,c', "é,東"]
    df = spark.createDataFrame([(s,) for s in lines], "s string").select(X.csv_cells(F.col("s")).alias("c"))
    assert [r.c for r in df.collect()] == [["a", "b"], [None, "a", None], [None], ["x, y", 'say "no"', "z"], ["ab", "c"], ["é", "東"]]
    with pytest.raises(Exception, match="runs over the end of its line"):
        spark.createDataFrame([('a,"b',)], "s string").select(X.csv_cells(F.col("s"))).collect()


def _uploads(spark):
    rows = []

    def sheet(file_seq, name, sheet_seq, sheet_name, cells):
        rows.extend((file_seq, name, sheet_seq, sheet_name, i + 1, c) for i, c in enumerate(cells))

    sheet(0, "a.xlsx", 0, "S", [["h1", "h2"], ["1", "x", None]])
    sheet(0, "a.xlsx", 1, "S ", [["h1", "h2"], ["2"]])           # the same trimmed name in one workbook
    sheet(1, "b.XLS", 0, " S", [["h1", "h2"], ["3", "y", "5", "6"]])
    sheet(2, "c.csv", 0, "S", [["h1"], ["4", "no workbook"]])
    sheet(3, "d.xlsx", 0, "S", [["only", "a", "header", "that", "is", "wide"]])
    sheet(3, "d.xlsx", 1, "N", [["1", "1.50", "1D", None, " 1e3 "], ["-2", ".5", "2", None, "0"]])
    return spark.createDataFrame(rows, "file_seq int, file_name string, sheet_seq int, sheet string, row_no long, cells array<string>")


def test_consolidation_of_ragged_sheets(spark):
    out = IG.consolidate_files(_uploads(spark), header_height=1)
    got = [(r.file_seq, r.sheet_seq, r.row_no, r.cells) for r in out.where("sheet = 'S'").orderBy("file_seq", "sheet_seq", "row_no").collect()]
    assert got == [(0, 0, 1, ["h1", "h2", None, None]), (0, 0, 2, ["1", "x", None, None]), (0, 1, 2, ["2", None, None, None]),
                   (1, 0, 2, ["3", "y", "5", "6"])]


def test_columns_of_numbers_become_double(spark):
    out = materialize(IG.consolidate_files(_uploads(spark), header_height=1))
    tables = IG.write_consolidated(out, IG.numeric_if_all(out))
    assert [f.dataType.simpleString() for f in tables["N"].schema if f.name.startswith("c")] == ["double", "double", "string", "double", "double"]
    assert sorted(r.c2 for r in tables["N"].collect()) == [0.5, 1.5] and {r.c5 for r in tables["N"].collect()} == {0.0, 1000.0}
    # of S the third and fourth columns have no header
    assert [f.dataType.simpleString() for f in tables["S"].schema if f.name.startswith("c")] == ["string", "string", "double", "double"]


def test_the_first_pool_with_a_hit_wins(spark):
    cleaned = SM.clean_headers(spark.createDataFrame([(0, "2B", i, h, None) for i, h in enumerate(["b exact", "a x", "a x y"])],
                                                     "table_id long, kind string, pos int, part1 string, part2 string"))
    got = {r.role: r.column for r in SM.pool_columns(cleaned, {"r": [["a x"], ["b exact"]], "s": [["none"], ["b exact"]], "t": [["none"]]}).collect()}
    assert got == {"r": "a x", "s": "b exact"}


@pytest.fixture()
def ids():
    """Run ids that no earlier session has used: what is published outlives the session."""
    tag = uuid.uuid4().hex
    return f"run/ü {tag}", f"run 2 {tag}"


def test_published_tables_are_found_by_run(spark, ids):
    one, two = spark.range(3).toDF("x"), spark.range(5).toDF("x")
    with pytest.raises(LookupError):
        SK.published(spark, ids[0], SK.STATE)
    SK.publish(spark, {"pair": one}, ids[0], SK.STATE)
    SK.publish(spark, {"pair": two}, ids[1], SK.STATE)
    assert SK.published(spark, ids[0], SK.STATE)["pair"].count() == 3
    with pytest.raises(Exception, match="boom"):  # half a run: its second table fails
        SK.publish(spark, {"pair": two, "lines": two.select(F.raise_error(F.lit("boom")).alias("x"))}, ids[0], SK.STATE)
    assert SK.published(spark, ids[0], SK.STATE)["pair"].count() == 3
    SK.publish(spark, {"pair": two}, ids[0], SK.STATE)
    assert SK.published(spark, ids[0], SK.STATE)["pair"].count() == 5


def test_run_log_has_one_row_a_run(spark, ids):
    pairs = spark.createDataFrame([("Matched", 1.0), ("Not Matched", 2.0)], "mapping string, v double").selectExpr(
        "mapping", *[f"cast(v as decimal(38,2)) as pr_{t}" for t in ("cgst", "sgst", "igst")])
    for run_id, status in ((ids[0], "review needed"), (ids[1], "completed"), (ids[0], "completed")):
        SK.log_run(RV.run_log(pairs, run_id, "me", "Recon_me", "file", status))
    rows = {r.run_id: r for r in SK.run_log(spark).where(F.col("run_id").isin(*ids)).collect()}
    assert set(rows) == set(ids) and rows[ids[0]].status == "completed" and rows[ids[0]].generated_at is not None
    other = rows[ids[1]]
    assert (other.matched_value, other.mismatched_value, other.row_count, other.file) == (3, 6, 2, "file")
    SK.delete_run(spark, ids[0])
    assert [r.run_id for r in SK.run_log(spark).where(F.col("run_id").isin(*ids)).collect()] == [ids[1]]


def test_written_stages_can_be_removed(spark, tmp_path):
    from ledgerweave.session import scratch_path
    from ledgerweave.sources.scratch import remove

    path = scratch_path(spark, "to-remove")
    spark.range(3).write.parquet(path)
    assert remove(spark, path) and not remove(spark, path)
    assert callable(clean_up)


def test_plain_amounts_need_no_cleaning(spark):
    from ledgerweave.functions import normalize as N

    texts = [None, "", "5", " 5.005 ", "1e3", "1,234.50", "₹12.00", "(100)", "--5", "1.2.3", "nan", "Infinity", " 7.0", "100-", "12.0", "9" * 40, ".5", "+3"]
    df = spark.createDataFrame([(t,) for t in texts], "x_raw string").withColumn("c", N.unless_plain_amount("x_raw"))
    got = df.select("x_raw", N.plain_or_parsed_amount("x_raw", "c").alias("a"), N.parse_amount("x_raw").alias("b")).collect()
    assert all(r.a == r.b for r in got), got
