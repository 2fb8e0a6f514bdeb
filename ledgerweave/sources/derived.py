"""Landing tables derived from the driver's TPC-H-like tables.

The driver data holds no invoices, so the two books are derived from
``orders`` + ``lineitem`` (one order = one invoice, its items = the lines).
The landing layout is what an upload looks like after the sheet reader: every
cell is text, every row carries the sheet row number it had in the workbook.

The same derivation is written as DuckDB SQL in ``plans.oracle``; both must
agree row for row.  See FIXTURES.md for the rules.

Scale: lineitem x orders and the vendor lookup are ordinary joins (AQE
broadcasts a side only when its bytes allow it).  Only the facts of a line
(numbers, dates, flags) are sorted and written, once and with the line's row
number in every sheet; the text cells are projections over that table, so a
reader makes the cells that it needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import SORT_ROWS
from .scratch import materialize
from .tables import read_table

# Sheet row of the first data row: header in row 1 for the purchase register,
# two header rows (5 and 6) in the portal layout of GSTR-2B.
PR_FIRST_ROW = 2
PORTAL_FIRST_ROW = 7
PORTAL_HEADER_ROWS = 6

# unique sort key of a line (l_orderkey, l_linenumber) alone repeats
LINE_ORDER = ["ok", "ln", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]

PR_COLUMNS = ["gstin_raw", "inv_raw", "date_raw", "doc_type", "vendor_name", "purchase_type",
              "taxable_raw", "cgst_raw", "sgst_raw", "igst_raw", "invoice_value_raw", "cess_raw"]
B2_COLUMNS = ["gstin_raw", "inv_raw", "date_raw", "inv_type", "note_type", "trade_name", "reverse_charge",
              "itc_availability", "filing_date_raw", "filing_period", "supply_type",
              "taxable_raw", "cgst_raw", "sgst_raw", "igst_raw", "total_tax_raw", "invoice_value_raw", "cess_raw"]

SHEET_B2B = "B2B"
SHEET_CDNR = "B2B-CDNR"
SHEET_IMPG = "IMPG"
#: The register among the sheets of both books.
BOOK_PR = "PR"


def _money_text(x: Column) -> Column:
    return x.cast("decimal(18,2)").cast("string")


def _day_text(d: Column) -> Column:
    """dd-MM-yyyy, put together from the ISO text (a formatter only for years that have not four digits)."""
    s = d.cast("string")
    return F.when(F.length(s) == 10, F.concat(F.substring(s, 9, 2), F.lit("-"), F.substring(s, 6, 2), F.lit("-"), F.substring(s, 1, 4))
                  ).otherwise(F.date_format(d, "dd-MM-yyyy"))


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: what the lines of both books are made of, no text but the vendor's name."""
    li = read_table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])
    od = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    sup = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name"])
    vendors = max(1, sup.count())  # row count of the file's metadata
    od = od.select("o_orderkey", F.to_date(F.col("o_orderdate")).alias("inv_date"), F.pmod("o_orderkey", F.lit(vendors).cast("long")).alias("vendor"))
    od = od.join(sup, F.col("s_suppkey") == F.col("vendor"), "left").drop("s_suppkey")
    return li.join(od, li.l_orderkey == od.o_orderkey, "inner").select(
        F.col("o_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "inv_date", "vendor", "s_name")


def line_values(facts: DataFrame) -> DataFrame:
    """The facts with the ids and amounts computed from them (other columns stay)."""
    ok, v = F.col("ok"), F.col("vendor")

    def letter(per: int) -> Column:
        return F.char((F.floor(v / per) % 26 + 65).cast("long"))

    taxable = F.round(F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")), 2)
    out = facts.select(
        "*",
        F.concat(F.lit("07"), letter(6_760_000), letter(260_000), letter(10_000), F.lit("CS"),
                 F.lpad((v % 10_000).cast("string"), 4, "0"), F.lit("F1Z"),
                 F.when(v % 2 == 0, F.lit("A")).otherwise(F.lit("7"))).alias("gstin"),
        F.concat(F.lit("INV/"), ok.cast("string")).alias("inv"),
        _is_cdnr().alias("is_cdnr"),
        taxable.alias("taxable"),
        (v % 2).alias("intra"),
    )
    tax = F.round(F.col("taxable") * F.col("l_tax").cast("decimal(4,2)"), 2)
    half = F.round(F.col("tax") * F.lit(0.5).cast("decimal(2,1)"), 2)
    total_tax = (F.col("cgst") * 2 + F.col("igst") + F.col("cess")).cast("decimal(18,2)")
    return (out.withColumn("tax", tax)
            .withColumn("cgst", F.when(F.col("intra") == 0, half).otherwise(F.lit(0)).cast("decimal(18,2)"))
            .withColumn("igst", F.when(F.col("intra") == 1, F.col("tax")).otherwise(F.lit(0)).cast("decimal(18,2)"))
            .withColumn("cess", F.when(ok % 6 == 0, F.round(F.col("taxable") * F.lit(0.01).cast("decimal(3,2)"), 2))
                        .otherwise(F.lit(0)).cast("decimal(18,2)"))
            .withColumn("taxable", F.col("taxable").cast("decimal(18,2)"))
            .withColumns({"total_tax": total_tax, "invoice_value": (F.col("taxable") + total_tax).cast("decimal(18,2)")}))


def base_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with the invoice facts both books start from."""
    return line_values(line_facts(spark, sf_dir))


def _is_cdnr() -> Column:
    return (F.col("l_returnflag") == "R") & (F.col("ok") % 4 == 1)


def _blank(cols: list[str], when_blank: Column, exprs: dict[str, Column]) -> list[Column]:
    return [F.when(~when_blank, exprs[c]).alias(c) for c in cols]


def _pr_cells() -> tuple[Column, dict[str, Column], Column]:
    """The register's rows: which lines it has, its cells, and where all cells are blank."""
    ok = F.col("ok")
    ln = F.col("ln")
    g = F.col("gstin")
    rupee = ok % 19 == 0
    amt = lambda x: F.when(rupee, F.concat(F.lit("₹"), _money_text(x))).otherwise(_money_text(x))
    exprs = {
        "gstin_raw": (F.when((ok % 997 == 0) & (ln == 1), F.lit("Total"))
                      .when((ok % 43 == 0) & (ln == 2), F.lit(None).cast("string"))
                      .when(ok % 41 == 0, F.concat(F.lower(F.substring(g, 1, 7)), F.lit(" "), F.substring(g, 8, 8)))
                      .when(ok % 73 == 0, F.concat(F.substring(g, 1, 7), F.lit("\u2009"), F.substring(g, 8, 8)))
                      .otherwise(g)),
        "inv_raw": (F.when(F.col("is_cdnr"), F.concat(F.lit("CN/"), ok.cast("string")))
                    .when(ok % 71 == 0, F.concat(F.lit("\u3000"), F.col("inv"), F.lit("\u2003")))
                    .when(ok % 5 == 0, F.concat(F.lit(" inv/"), ok.cast("string"), F.lit("/24-25")))
                    .otherwise(F.col("inv"))),
        "date_raw": (F.when(ok % 7 == 0, F.col("inv_date").cast("string"))
                     .when(ok % 9 == 0, F.datediff(F.col("inv_date"), F.lit("1899-12-30").cast("date")).cast("string"))
                     .otherwise(_day_text(F.col("inv_date")))),
        "doc_type": (F.when(F.col("is_cdnr"), F.lit("Credit Note"))
                     .when(ok % 3 == 1, F.lit("Tax Invoice"))),
        "vendor_name": (F.when(ln % 3 == 0, F.upper("s_name"))
                        .when(ln % 3 == 1, F.concat(F.col("s_name"), F.lit(" Traders")))
                        .when(ok % 2 == 0, g)),
        "purchase_type": F.when(ok % 31 == 0, F.lit("Import of goods")).otherwise(F.lit("Local")),
        "taxable_raw": amt(F.col("taxable")),
        "cgst_raw": amt(F.col("cgst")),
        "sgst_raw": amt(F.col("cgst")),
        "igst_raw": amt(F.col("igst")),
        "invoice_value_raw": F.when(ln % 4 != 0, amt(F.col("invoice_value"))),
        "cess_raw": amt(F.col("cess")),
    }
    return ok % 20 != 3, exprs, (ok % 61 == 0) & (ln == 3)


def pr_landing_unnumbered(base: DataFrame) -> DataFrame:
    has, exprs, blank = _pr_cells()
    return base.where(has).select(*LINE_ORDER, *_blank(PR_COLUMNS, blank, exprs))


def _b2_cells() -> tuple[Column, Column, dict[str, Column], Column]:
    """The same of the B2B and note sheets, and which of the two a line is in."""
    ok = F.col("ok")
    cd = F.col("is_cdnr")
    sign = F.when(cd, F.lit(-1)).otherwise(F.lit(1))
    b2_date = F.when(ok % 13 == 0, F.date_add(F.col("inv_date"), 1)).otherwise(F.col("inv_date"))
    filing = F.date_add(F.col("inv_date"), 11)
    note_type = F.when(cd, F.when(ok % 3 == 0, F.lit("Debit Note")).otherwise(F.lit("Credit Note")))
    cgst = F.col("cgst") + F.when(ok % 11 == 0, F.lit(5)).otherwise(F.lit(0))
    exprs = {
        "gstin_raw": F.when(ok % 17 == 0, F.regexp_replace(F.col("gstin"), "F1Z", "FIZ")).otherwise(F.col("gstin")),
        "inv_raw": (F.when(cd & (ok % 47 == 0), F.lit("/24-25"))
                    .when(cd & (ok % 53 == 0), F.col("inv"))
                    .when(cd, F.concat(F.lit("CN/"), ok.cast("string")))
                    .when(ok % 17 == 0, F.concat(F.lit("INV-"), ok.cast("string")))
                    .otherwise(F.col("inv"))),
        "date_raw": F.when(~(cd & (ok % 53 == 0) & (ok % 3 == 0)), _day_text(b2_date)),
        "inv_type": F.when(cd & (ok % 8 == 1), F.lit(None).cast("string")).when(cd, note_type).otherwise(F.lit("Regular")),
        "note_type": note_type,
        "trade_name": F.when(ok % 41 == 0, F.col("gstin")).otherwise(F.col("s_name")),
        "reverse_charge": F.when(ok % 23 == 0, F.lit("Yes")).otherwise(F.lit("No")),
        "itc_availability": F.when(ok % 29 == 0, F.lit("No")).otherwise(F.lit("Yes")),
        "filing_date_raw": _day_text(filing),
        "filing_period": F.date_format(filing, "MMM-yyyy"),
        "supply_type": F.when(~cd & (ok % 31 == 0), F.lit("Import of goods")).otherwise(F.lit("Regular")),
        "taxable_raw": _money_text(F.col("taxable") * sign),
        "cgst_raw": _money_text(cgst * sign),
        "sgst_raw": _money_text(F.col("cgst") * sign),
        "igst_raw": _money_text(F.col("igst") * sign),
        "total_tax_raw": _money_text(F.col("total_tax") * sign),
        "invoice_value_raw": _money_text(F.col("invoice_value") * sign),
        "cess_raw": _money_text(F.col("cess") * sign),
    }
    sheet = F.when(cd, F.lit(SHEET_CDNR)).otherwise(F.lit(SHEET_B2B))
    return ok % 20 != 7, sheet, exprs, (ok % 67 == 0) & (F.col("ln") == 2)


def b2_landing_unnumbered(base: DataFrame) -> DataFrame:
    has, sheet, exprs, blank = _b2_cells()
    return base.where(has).select(sheet.alias("sheet"), *LINE_ORDER, *_blank(B2_COLUMNS, blank, exprs))


def _impg_cells() -> tuple[Column, dict[str, Column]]:
    ok = F.col("ok")
    cols = {c: F.lit(None).cast("string") for c in B2_COLUMNS}
    cols.update({
        "inv_raw": F.concat(F.lit("BOE"), ok.cast("string"), F.lit("-"), F.col("ln").cast("string")),
        "date_raw": _day_text(F.col("inv_date")),
        "supply_type": F.lit("Import of goods"),
        "taxable_raw": _money_text(F.col("taxable")),
        "igst_raw": _money_text(F.col("tax")),
        "invoice_value_raw": _money_text(F.col("taxable") + F.col("tax")),
    })
    return (ok % 37 == 0) & (F.col("l_linestatus") == "O"), cols


def impg_landing_unnumbered(base: DataFrame) -> DataFrame:
    has, cols = _impg_cells()
    return base.where(has).select(F.lit(SHEET_IMPG).alias("sheet"), *LINE_ORDER, *[cols[c].alias(c) for c in B2_COLUMNS])


#: The sheets, in the order of a line's row numbers.
NUMBERED = (BOOK_PR, SHEET_B2B, SHEET_CDNR, SHEET_IMPG)


def _places() -> dict[str, Column]:
    """Sheet -> whether the line has a row there."""
    in_b2 = _b2_cells()[0]
    cdnr = F.coalesce(_is_cdnr(), F.lit(False))
    return {BOOK_PR: _pr_cells()[0], SHEET_B2B: in_b2 & ~cdnr, SHEET_CDNR: in_b2 & cdnr, SHEET_IMPG: _impg_cells()[0]}


def placed_facts(facts: DataFrame, sheets: tuple[str, ...]) -> DataFrame:
    """The facts of every row that the named sheets have, tagged with the sheet (a line may be in several)."""
    places = _places()
    tags = F.array_compact(F.array(*[F.when(places[s], F.lit(s)) for s in sheets]))
    return facts.select("*", F.explode(tags).alias("sheet"))


def b2_sheet_cells() -> list[Column]:
    """The cells of a 2B row (over ``line_values`` of ``placed_facts``) in the order of ``B2_COLUMNS``."""
    _has, _sheet, cells, blank = _b2_cells()
    _has, impg = _impg_cells()
    return [F.when(F.col("sheet") == SHEET_IMPG, impg[c]).when(~blank, cells[c]).alias(c) for c in B2_COLUMNS]


def pr_sheet_cells() -> list[Column]:
    """The same of a register row, in the order of ``PR_COLUMNS``."""
    _has, cells, blank = _pr_cells()
    return _blank(PR_COLUMNS, blank, cells)


def _counter(names: list[str]):
    """Every marked line (1 in a named column) gets its place among the marked lines of its partition, the others null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = dict.fromkeys(names, 0)
        for batch in batches:
            for name in names:
                k = batch.schema.get_field_index(name)
                marks = batch.column(k).to_numpy(zero_copy_only=False)
                places = np.cumsum(marks) + before[name]
                before[name] += int(marks.sum())
                batch = batch.set_column(k, name, pa.array(places, mask=marks == 0))
            yield batch
    return run


def numbered_lines(facts: DataFrame) -> DataFrame:
    """The facts of all lines, written once in ``LINE_ORDER``, and a line's row number in every sheet (null: it has no row there).

    Returns the facts and ``_n0`` ... in the order of ``NUMBERED``.  One range
    exchange sorts narrow rows; places are counted while a sorted partition
    streams by, what the partitions before hold comes from a table of one row
    per partition."""
    names = [f"_n{i}" for i in range(len(NUMBERED))]
    marks = [F.coalesce(has, F.lit(False)).cast("long").alias(n) for n, has in zip(names, _places().values(), strict=True)]
    ordered = facts.orderBy(*LINE_ORDER).select("*", *marks)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in ordered.schema])
    counted = materialize(ordered.mapInArrow(_counter(names), schema).withColumn("_part", F.spark_partition_id()), "lines",
                          rows_per_file=SORT_ROWS)
    sizes = counted.groupBy("_part").agg(*[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in names])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sizes.select("_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_b{n}") for n in names]), "line-offsets")
    out = counted.join(F.broadcast(offsets), "_part")
    firsts = [PR_FIRST_ROW, *[PORTAL_FIRST_ROW] * (len(NUMBERED) - 1)]
    return out.select(*facts.columns, *[(F.col(n) + F.col(f"_b{n}") + F.lit(first - 1)).cast("bigint").alias(n)
                                        for n, first in zip(names, firsts, strict=True)])


def _sheet_rows(lines: DataFrame, row_no: Column, columns: list[str], cells: dict[str, Column], blank: Column, sheet: Column) -> DataFrame:
    rows = line_values(lines.withColumn("row_no", row_no).where(F.col("row_no").isNotNull()))
    return rows.select(sheet.alias("sheet"), "row_no", *_blank(columns, blank, cells))


def pr_landing(lines: DataFrame) -> DataFrame:
    """The register's rows, text cells, numbered (over ``numbered_lines``)."""
    _has, cells, blank = _pr_cells()
    return _sheet_rows(lines, F.col("_n0"), PR_COLUMNS, cells, blank, F.lit(BOOK_PR)).drop("sheet")


def b2_landing(lines: DataFrame, by_sheet: bool = True) -> DataFrame:
    """The same of the 2B workbook's sheets, tagged (a line is in B2B or in CDNR, and may be in IMPG besides).

    With ``by_sheet`` B2B and CDNR are scans of their own under constant tags, so Spark makes the text of a whole row (G1)
    for notes only, and for the other sheets just the cells that are asked for.  A reader of all cells takes the two in one scan."""
    _has, sheet, cells, blank = _b2_cells()
    _has, impg = _impg_cells()
    parts = [(F.col("_n1"), F.lit(SHEET_B2B)), (F.col("_n2"), F.lit(SHEET_CDNR))] if by_sheet else [(F.coalesce("_n1", "_n2"), sheet)]
    books = [_sheet_rows(lines, row_no, B2_COLUMNS, cells, blank, tag) for row_no, tag in parts]
    return reduce(DataFrame.unionByName, [*books, _sheet_rows(lines, F.col("_n3"), B2_COLUMNS, impg, F.lit(False), F.lit(SHEET_IMPG))])
