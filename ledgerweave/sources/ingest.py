"""Upload-side jobs (file consolidation, column typing, input checks, row counts).

Uploads are rows ``(file_seq, file_name, sheet_seq, sheet, row_no, cells
ARRAY<STRING>)``: one row per sheet row of every uploaded workbook, header
rows included, cells as many as the row has.  The derived uploads split the
2B lines into five workbooks by order key; the fifth is not a workbook (wrong
extension) and is skipped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators.ordinal import rank_in_group
from ..session import scratch_path
from . import derived as D
from .scratch import materialize
from .tables import read_table

PORTAL_HEADER_HEIGHT = 6
FLAT_HEADER_HEIGHT = 1
N_FILES = 5
# The six header rows every derived portal sheet starts with (two columns at the end have no header).
PORTAL_HEADER = [
    ["Goods and Services Tax - GSTR-2B"],
    [],
    ["Taxable inward supplies received from registered persons"],
    [],
    ["GSTIN of supplier", "Invoice details", "Invoice details", "Invoice details", "Note type", "Trade/Legal name",
     "Supply Attract Reverse Charge", "ITC Availability", "Filing Date", "Period", "Nature of Transaction", "Taxable Value",
     "Tax Amount", "Tax Amount", "Tax Amount", "Total Tax", "Invoice Value", "Tax Amount"],
    [None, "Invoice number", "Invoice Date", "Invoice type", None, None, None, None, None, None, None, None, "Central Tax",
     "State/UT Tax", "Integrated Tax", None, None, "Cess"],
]
WORKBOOK_SUFFIXES = (".xls", ".xlsx")


def uploaded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2B lines as five uploaded workbooks (header rows included).

    Workbook 3 names its sheets with a stray space; workbooks 0 and 2 bring
    their B2B lines in two sheets of one trimmed name.  Every tenth order's
    rows end early.  Behind the 2B columns stand two columns without a header:
    a number, and a number that IMPG writes with a letter."""
    lines = D.placed_facts(D.line_facts(spark, sf_dir), (D.SHEET_B2B, D.SHEET_CDNR, D.SHEET_IMPG))
    seq = (F.col("ok") % N_FILES).cast("int")
    again = seq.isin(0, 2) & (F.col("sheet") == D.SHEET_B2B) & (F.col("ln") % 2 == 0)
    order = F.when(F.col("sheet") == D.SHEET_B2B, F.lit(0)).when(F.col("sheet") == D.SHEET_CDNR, F.lit(1)).otherwise(F.lit(2))
    lines = lines.select("*", seq.alias("file_seq"), F.when(again, F.lit(3)).otherwise(order).alias("sheet_seq"),
                         F.when(again, F.concat(F.lit(" "), "sheet")).when(seq == 3, F.concat("sheet", F.lit(" ")))
                         .otherwise(F.col("sheet")).alias("name"))

    def cells(rows: DataFrame) -> DataFrame:
        """The cells are made of the sorted facts, once, after the exchange."""
        numbers = [F.col("ln").cast("string"), F.concat(F.col("ok").cast("string"), F.when(F.col("sheet") == D.SHEET_IMPG, F.lit("D")).otherwise(F.lit("")))]
        all_cells = F.array(*D.b2_sheet_cells(), *numbers)
        return D.line_values(rows).select("file_seq", "sheet_seq", "name", F.when(
            F.col("ok") % 10 == 0, F.slice(all_cells, 1, len(D.B2_COLUMNS) - 2)).otherwise(all_cells).alias("cells"))

    # a name belongs to one (file, place), so it needs no place in the sort
    data = rank_in_group(lines, ["file_seq", "sheet_seq", "name"], D.LINE_ORDER, name="row_no", start=PORTAL_HEADER_HEIGHT + 1,
                         post=cells, sort_by=["file_seq", "sheet_seq", *D.LINE_ORDER])
    data = data.select("file_seq", "sheet_seq", F.col("name").alias("sheet"), "row_no", "cells")
    template = F.array(*[F.struct(F.lit(i + 1).cast("bigint").alias("row_no"),
                                  F.array(*[F.lit(v).cast("string") for v in row]).cast("array<string>").alias("cells"))
                         for i, row in enumerate(PORTAL_HEADER)])
    headers = (data.select("file_seq", "sheet_seq", "sheet").distinct()
               .select("file_seq", "sheet_seq", "sheet", F.explode(template).alias("h"))
               .select("file_seq", "sheet_seq", "sheet", "h.row_no", "h.cells"))
    suffix = F.when(F.col("file_seq") == N_FILES - 1, F.lit(".csv")).otherwise(F.lit(".xlsx"))
    return data.unionByName(headers).withColumn("file_name", F.concat(F.lit("upload_"), F.col("file_seq").cast("string"), suffix))


def consolidate_files(files: DataFrame, header_height: int = PORTAL_HEADER_HEIGHT) -> DataFrame:
    """One table per trimmed sheet name, union by position.

    The first sheet of a name (by workbook, then by place in the workbook)
    keeps all its rows; later ones lose their first ``header_height`` rows,
    and add nothing if they have no more.  Names that are no workbook's are
    skipped.  Rows are as wide as the widest sheet that adds rows, missing
    cells are null; they stay in (file, sheet, row) order."""
    name = F.lower(F.col("file_name"))
    rows = files.where(name.endswith(WORKBOOK_SUFFIXES[0]) | name.endswith(WORKBOOK_SUFFIXES[1])).withColumn("sheet", F.trim("sheet"))
    place = F.struct("file_seq", "sheet_seq")
    each = rows.groupBy("sheet", "file_seq", "sheet_seq").agg(F.max("row_no").alias("last_row"), F.max(F.size("cells")).alias("width"))
    firsts = each.groupBy("sheet").agg(F.min(place).alias("first"), F.max(F.when(F.col("last_row") > header_height, F.col("width"))).alias("_more"),
                                       F.min_by("width", place).alias("_own"))
    # one row per sheet name, written: the join goes by its bytes, not by a shuffle of whole sheets
    firsts = materialize(firsts.select("sheet", "first", F.greatest("_own", "_more").alias("width")), "first-files")
    kept = rows.join(firsts, "sheet").where((place == F.col("first")) | (F.col("row_no") > header_height))
    padded = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.get("cells", i))
    return kept.select("sheet", "file_seq", "sheet_seq", "row_no", F.when(F.col("width") > 0, padded).otherwise(F.col("cells")).alias("cells"))


def numeric_if_all(consolidated: DataFrame) -> DataFrame:
    """S7, first pass: per sheet and position, whether every present value parses as a number."""
    long = consolidated.select("sheet", F.posexplode("cells").alias("pos", "value"))
    return long.groupBy("sheet", "pos").agg(F.bool_and(F.col("value").isNull() | N.is_number("value")).alias("all_numeric"))


def write_consolidated(consolidated: DataFrame, types: DataFrame) -> dict[str, DataFrame]:
    """S7, second pass: every sheet as a written table of its own, columns c1, c2, ... DOUBLE where all values are numbers.

    ``types`` (one row per sheet and position) is read on the driver: it is the schemas."""
    spark = consolidated.sparkSession
    sheets: dict[str, list[bool]] = {}
    for r in types.orderBy("sheet", "pos").collect():
        sheets.setdefault(r["sheet"], []).append(r["all_numeric"])
    out = {}
    for sheet, numeric in sheets.items():
        columns = [(F.get("cells", F.lit(i)).try_cast("double") if n else F.get("cells", F.lit(i))).alias(f"c{i + 1}") for i, n in enumerate(numeric)]
        path = scratch_path(spark, "consolidated", uuid.uuid4().hex)
        consolidated.where(F.col("sheet") == sheet).select("file_seq", "sheet_seq", "row_no", *columns).write.parquet(path)
        out[sheet] = spark.read.parquet(path)
    return out


def typed_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """(sheet, pos, all_numeric, n_values, least, most) of the written tables, read back: what the conversion has made."""
    parts = []
    for sheet, df in tables.items():
        columns = [f for f in df.schema.fields if f.name.startswith("c") and f.name[1:].isdigit()]
        aggs = [F.struct(F.lit(i).alias("pos"), F.lit(f.dataType.simpleString() == "double").alias("all_numeric"), F.count(f.name).alias("n_values"),
                         *[(fn(f.name) if f.dataType.simpleString() == "double" else F.lit(None)).cast("double").alias(n)
                           for fn, n in ((F.min, "least"), (F.max, "most"))]) for i, f in enumerate(columns)]
        parts.append(df.agg(F.array(*aggs).alias("a")).select(F.lit(sheet).alias("sheet"), F.explode("a").alias("c")).select("sheet", "c.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def derived_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet lists of the two uploaded files of every run (one run per customer)."""
    cust = read_table(spark, sf_dir, "customer", ["c_custkey"])
    k = F.col("c_custkey")
    two_b = F.when(k % 7 == 0, F.array(F.lit("B2B-CDNR"), F.lit("IMPG"))) \
        .otherwise(F.array(F.lit("B2B"), F.lit("B2B-CDNR"), F.lit("IMPG")))
    pr = F.when(k % 11 == 0, F.array(F.lit("B2B"), F.lit("B2B-CDNR"))) \
        .when(k % 13 == 0, two_b).otherwise(F.array(F.lit("Sheet1")))
    slots = cust.select(k.alias("run_id"), F.posexplode(two_b).alias("pos", "sheet"), F.lit("2B").alias("slot")) \
        .unionByName(cust.select(k.alias("run_id"), F.posexplode(pr).alias("pos", "sheet"), F.lit("PR").alias("slot")))
    return slots.select("run_id", "slot", F.col("pos").cast("int"), "sheet")


def validate_manifest(manifest: DataFrame) -> DataFrame:
    """Per run, in order: 2B lacks B2B; PR has both B2B and B2B-CDNR
    (files swapped); identical ordered sheet lists (same file twice); else ok."""
    def ordered(slot):
        items = F.collect_list(F.when(F.col("slot") == slot, F.struct("pos", "sheet")))
        return F.transform(F.array_sort(items), lambda x: x["sheet"])

    lists = manifest.groupBy("run_id").agg(ordered("2B").alias("sheets_2b"), ordered("PR").alias("sheets_pr"))
    verdict = (F.when(~F.array_contains("sheets_2b", "B2B"), F.lit("missing B2B"))
               .when(F.array_contains("sheets_pr", "B2B") & F.array_contains("sheets_pr", "B2B-CDNR"),
                     F.lit("swapped"))
               .when(F.col("sheets_2b") == F.col("sheets_pr"), F.lit("duplicate"))
               .otherwise(F.lit("ok")))
    return lists.select("run_id", F.array_join("sheets_2b", "|").alias("sheets_2b"),
                        F.array_join("sheets_pr", "|").alias("sheets_pr"), verdict.alias("verdict"))


def row_counts(pr_landing: DataFrame, uploads: DataFrame, portal: bool = True) -> DataFrame:
    """Rows per uploaded sheet before any drop, less the header rows of
    each upload (a sheet shorter than its header has none, never below 0)."""
    height = PORTAL_HEADER_HEIGHT if portal else FLAT_HEADER_HEIGHT
    pr = pr_landing.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("pr").alias("source"), "rows")
    sheet = N.trimmed("sheet")
    raw = (uploads.where(sheet.isin("B2B", "B2B-CDNR")).groupBy("file_seq", "sheet_seq", "sheet").agg(F.count(F.lit(1)).alias("n")))
    b2 = raw.groupBy(F.when(sheet == "B2B", F.lit("b2b")).otherwise(F.lit("cdnr")).alias("source")).agg(
        F.sum(F.greatest(F.lit(0), F.col("n") - F.lit(height))).alias("rows"))
    return pr.unionByName(b2).select("source", F.col("rows").cast("bigint"))
