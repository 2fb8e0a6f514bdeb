"""Plans and files of the upload side: what is done once a file, once a row, or not at all."""

from pyspark.sql import functions as F

from ledgerweave.sources import catalog as CT
from ledgerweave.sources import files as X
from ledgerweave.sources import ingest as IG

SF_SMALL = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _rows(spark, n):
    return spark.range(n).select((F.col("id") + 1).alias("row_no"), F.array(F.col("id").cast("string"), F.lit("a,b")).alias("cells"))


def test_a_path_is_not_taken_apart_for_every_row(spark, tmp_path):
    for kind, write in (("cells", X.write_cells), ("csv", X.write_csv)):
        write(_rows(spark, 50), str(tmp_path), "book one", f"s+{kind}")
        read = X.read_sheets(spark, str(tmp_path), kind)
        assert "RegExpExtract" not in _plan(read) and "regexp_extract(" not in _plan(read) and "url_decode" not in _plan(read)
        got = read.where((F.col("workbook") == "book one") & (F.col("sheet") == f"s+{kind}")).orderBy("row_no").collect()
        assert [(r["row_no"], r["cells"]) for r in got] == [(i + 1, [str(i), "a,b"]) for i in range(50)]


def test_a_larger_sheet_has_more_part_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "PART_ROWS", 10, raising=False)
    X.write_cells(_rows(spark, 95).repartition(3), str(tmp_path), "w", "s")
    assert len(list((tmp_path / "w" / "s.cells").glob("*.parquet"))) == 10
    got = X.read_cells(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [(r["row_no"], r["cells"][0]) for r in got] == [(i + 1, str(i)) for i in range(95)]


def test_an_empty_sheet_and_odd_row_numbers(spark, tmp_path):
    X.write_cells(_rows(spark, 0), str(tmp_path), "w", "none")
    rows = spark.createDataFrame([(7, ["c"]), (None, ["a"]), (-3, ["b"]), (10**12, ["d"])], "row_no long, cells array<string>")
    X.write_cells(rows, str(tmp_path), "w", "odd")
    got = X.read_cells(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [(r["sheet"], r["row_no"], r["cells"]) for r in got] == [("odd", i + 1, [c]) for i, c in enumerate("abcd")]


def test_upload_cells_are_made_after_the_sort(spark, monkeypatch):
    """The exchange that numbers the rows carries facts, not texts."""
    seen = []
    for module in (IG, CT):
        real = module.rank_in_group

        def ranked(df, *args, _real=real, **kw):
            seen.append(df.columns)
            return _real(df, *args, **kw)

        monkeypatch.setattr(module, "rank_in_group", ranked)
    IG.uploaded_files(spark, SF_SMALL)
    CT.run_uploads(spark, SF_SMALL)
    assert len(seen) == 2 and not any({"cells", "gstin_raw", "taxable"} & set(c) for c in seen)


def test_landing_types_only_what_is_read(spark):
    """No typed copy of the uploaded books is written for readers of their raw cells."""
    from ledgerweave.plans.given import Uploads

    up = Uploads(*CT.run_uploads(spark, SF_SMALL))
    plan = up.pr_lines.select("run_id", "row_no", "gstin_raw")._jdf.queryExecution().optimizedPlan().toString()
    assert "uploads-pr" not in plan and "inv_key" not in plan


def test_queries_fit_their_code_to_the_jit(spark):
    import __spark_entry__ as E

    key = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(key)
    E.queries()["validate_manifest"](spark, SF_SMALL)
    assert spark.conf.get(key) == "8000"
