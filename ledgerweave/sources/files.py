"""Sheets read from files, every row with the number it has in its sheet.

A workbook is a folder and a sheet an entry in it: ``<root>/<workbook>/<sheet>.<type>``,
one file or a folder of part files in the order of their names.  Two types
are read: ``cells`` (Parquet with one column ``cells ARRAY<STRING>``, a row
for each sheet row, header rows included) and ``csv`` (a line for each sheet
row; quoted cells may hold commas, but not line ends).

Rows are numbered where they are read, nothing is sorted: a Parquet row knows
its place in its file, a text row its place in its block of the file.  What
is added to that place (the rows of the files or blocks before) comes from a
table of one row per file or block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import materialize

SUFFIXES = {"cells": "cells", "csv": "csv"}


def _sheet_of(path: Column, suffix: str) -> list[Column]:
    """(workbook, sheet) of a file's path."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    pattern = rf"([^/]+)/([^/]+)\.{suffix}(?:/[^/]*)?$"
    return [F.regexp_extract(plain, pattern, k).alias(name) for k, name in ((1, "workbook"), (2, "sheet"))]


def _numbered(rows: DataFrame, suffix: str, block: list[str], place: Column) -> DataFrame:
    """row_no = 1 + the rows of the sheet's blocks before + the place in the own block.  A path is taken apart once a
    block, not once a row."""
    sizes = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    sizes = sizes.select("*", *_sheet_of(F.col("_file"), suffix))
    before = Window.partitionBy("workbook", "sheet").orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "sheet-blocks")
    return (rows.join(offsets.drop("_n"), block)
            .withColumn("row_no", F.col("_before") + place + F.lit(1)).select("workbook", "sheet", "row_no", "cells"))


def read_cells(spark: SparkSession, root: str) -> DataFrame:
    """(workbook, sheet, row_no, cells) of the ``cells`` files under a folder."""
    df = spark.read.schema("cells array<string>").option("recursiveFileLookup", "true").parquet(f"{root}/*/*.{SUFFIXES['cells']}")
    rows = df.select("cells", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return _numbered(rows, SUFFIXES["cells"], ["_file"], F.col("_at"))


def csv_cells(line: Column) -> Column:
    """The cells of a CSV line; an empty cell is missing.  A quote that is not closed is an error."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]++|"")*+"[^,]*+|[^,]*+)'), 1)
    cell = F.transform(fields, lambda x: F.when(x.startswith('"'), F.replace(
        F.regexp_replace(x, r'^"((?:[^"]++|"")*+)"', "$1"), F.lit('""'), F.lit('"'))).when(x != "", x))
    open_quote = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    return F.when(open_quote, F.raise_error(F.lit("a quoted cell runs over the end of its line")).cast("array<string>")).otherwise(cell)


def read_csv(spark: SparkSession, root: str) -> DataFrame:
    """(workbook, sheet, row_no, cells) of the CSV files under a folder, split over tasks like any text."""
    df = spark.read.option("recursiveFileLookup", "true").text(f"{root}/*/*.{SUFFIXES['csv']}")
    rows = df.select(csv_cells(F.col("value")).alias("cells"), F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    # written, for the ids are those of this read
    return _numbered(materialize(rows, "csv-lines"), SUFFIXES["csv"], ["_file", "_block"], F.col("_at") - F.col("_first"))


def read_sheets(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return {"cells": read_cells, "csv": read_csv}[kind](spark, root)


#: Rows of a part file where the caller names no number of parts.
PART_ROWS = 250_000


def _in_parts(rows: DataFrame, parts: int | None) -> DataFrame:
    """The rows in row order over part files of about equally many row numbers.  A row's number tells its part, so nothing
    is sampled (a range exchange would make all cells twice)."""
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first"), F.max("row_no").alias("last")).first()
    first, width = ends["first"] or 0, (ends["last"] or 0) - (ends["first"] or 0) + 1
    parts = parts or max(4, -(-ends["n"] // PART_ROWS))
    part = F.floor((F.col("row_no") - first) / width * parts).cast("int")
    return rows.repartitionById(parts, F.coalesce(part, F.lit(0))).sortWithinPartitions("row_no")


def write_cells(rows: DataFrame, root: str, workbook: str, sheet: str, parts: int | None = None) -> None:
    """Write (row_no, cells) as a ``cells`` sheet, in row order over some part files."""
    _in_parts(rows, parts).select("cells").write.parquet(f"{root}/{workbook}/{sheet}.{SUFFIXES['cells']}")


def write_csv(rows: DataFrame, root: str, workbook: str, sheet: str, parts: int | None = None) -> None:
    """The same as CSV."""
    quoted = F.transform("cells", lambda x: F.coalesce(
        F.when(x.rlike('[",]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x), F.lit("")))
    _in_parts(rows, parts).select(F.array_join(quoted, ",")).write.text(f"{root}/{workbook}/{sheet}.{SUFFIXES['csv']}")
