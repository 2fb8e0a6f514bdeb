"""Uploaded-table catalog for schema discovery (C1-C13), derived from ``orders``.

Every 200 consecutive order keys form one uploaded table (``table_id``); its
header layout is one of six templates (purchase-register and portal GSTR-2B
layouts, including two-level portal headers and unnamed columns) and its
rows are the line items of those orders.  The catalog therefore grows with
the data: more orders -> more uploaded tables, more lines -> more cells.

* ``catalog``: (table_id, kind, pos, part1, part2) raw header parts
* ``cells``:   (table_id, pos, row_no, value) every cell as text

``run_uploads`` derives whole runs besides: every ``ORDERS_PER_RUN`` order keys
are one run with a purchase register, a B2B and a note sheet of the two
landing books, each under one of several headers and column orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordinal import rank_in_group
from . import derived as D

ORDERS_PER_TABLE = 200
ORDERS_PER_RUN = 2000
NBSP = " "
BUYER_GSTIN = "29AABCB0000A1Z5"

# Header templates of the derived uploads: (part1, part2, role) per column.
# part2 is None for a flat header; portal sheets carry an 'Unnamed' second level.
U = "Unnamed: {}_level_1"
TEMPLATES = [
    ("PR", [("Supplier GSTIN", None, "gstin"), ("Vendor Inv No", None, "invoice"), ("Invoice Date", None, "date"),
            ("Taxable Value", None, "taxable"), ("CGST", None, "cgst"), ("SGST", None, "sgst"), ("IGST", None, "igst"),
            ("Vendor Name", None, "name"), ("Purchase Type", None, "ptype"), ("Document Type", None, "dtype")]),
    ("PR", [("Our GSTIN", None, "buyer_gstin"), ("Party GSTIN", None, "gstin"), ("Voucher No", None, "voucher"),
            ("Bill No", None, "invoice"), ("Bill Date", None, "date"), ("Assessable" + NBSP + "Value", None, "taxable"),
            ("CGST Amount", None, "cgst"), ("SGST Amount", None, "sgst"), ("IGST Amount", None, "igst"),
            ("Party Name", None, "name")]),
    ("PR", [("Ref", None, "voucher"), ("Recipient GSTIN", None, "buyer_gstin"), ("Col 1", None, "gstin"),
            ("Col 2", None, "invoice"), ("Col 3", None, "date"), ("Amount", None, "taxable"),
            ("Narration", None, "narration"), ("Unnamed: 7", None, "voucher")]),
    ("2B", [("GSTIN of supplier", U.format(0), "gstin"), ("Trade/Legal name", U.format(1), "name"),
            ("Invoice details", "Invoice number", "invoice"), ("Invoice details", "Invoice type", "itype"),
            ("Invoice details", "Invoice Date", "date"), ("Invoice details", "Invoice Value(₹)", "invvalue"),
            ("Place of supply", U.format(6), "place"), ("Supply Attract Reverse Charge", U.format(7), "rcm"),
            ("Taxable Value (₹)", U.format(8), "taxable"), ("Tax Amount", "Integrated Tax(₹)", "igst"),
            ("Tax Amount", "Central Tax(₹)", "cgst"), ("Tax Amount", "State/UT Tax(₹)", "sgst"),
            ("Tax Amount", "Cess(₹)", "cess"), ("GSTR-1/IFF/GSTR-5 Period", U.format(13), "period"),
            ("GSTR-1/IFF/GSTR-5 Filing Date", U.format(14), "filing_date"), ("ITC Availability", U.format(15), "itc")]),
    ("2B", [("GSTIN of supplier", U.format(0), "gstin"), ("Trade/Legal name", U.format(1), "name"),
            ("Credit note/Debit note details", "Note type", "ntype"),
            ("Credit note/Debit note details", "Note number", "note_no"),
            ("Credit note/Debit note details", "Note date", "note_date"), ("Taxable Value (₹)", U.format(5), "taxable"),
            ("Tax Amount", "Integrated Tax(₹)", "igst"), ("Tax Amount", "Central Tax(₹)", "cgst"),
            ("Tax Amount", "State/UT" + NBSP + "Tax(₹)", "sgst"), ("ITC Availability", U.format(9), "itc")]),
    ("2B", [("GSTIN", None, "gstin"), ("Note Number", None, "sparse_note"), ("note no", None, "note_no"),
            ("Note Date", None, "note_date"), ("Note Type", None, "ntype"), ("Integrated Tax", None, "igst"),
            ("Central Tax", None, "cgst"), ("State/UT Tax", None, "sgst"), ("Reverse charge", None, "rcm")]),
]


def _money(x: Column) -> Column:
    return x.cast("decimal(18,2)").cast("string")


def _role_value(role: str) -> Column:
    ok = F.col("ok")
    date = F.date_format("inv_date", "dd-MM-yyyy")
    values = {
        "gstin": F.col("gstin"), "buyer_gstin": F.lit(BUYER_GSTIN), "invoice": F.col("inv"),
        "voucher": F.concat(F.lit("VCH/"), ok.cast("string"), F.lit("/"), F.col("ln").cast("string")),
        "date": date, "taxable": _money(F.col("taxable")), "cgst": _money(F.col("cgst")),
        "sgst": _money(F.col("cgst")), "igst": _money(F.col("igst")), "cess": _money(F.lit(0)),
        "invvalue": _money(F.col("taxable") + F.col("tax")), "name": F.col("s_name"), "ptype": F.lit("Local"),
        "dtype": F.lit("Tax Invoice"), "itype": F.lit("Regular"), "place": F.lit("Delhi"), "rcm": F.lit("No"),
        "period": F.date_format(F.date_add("inv_date", 11), "MMM-yyyy"),
        "filing_date": F.date_format(F.date_add("inv_date", 11), "dd-MM-yyyy"), "itc": F.lit("Yes"),
        "ntype": F.lit("Credit Note"), "note_no": F.concat(F.lit("CN/"), ok.cast("string")),
        "note_date": date, "narration": F.lit("Purchase of goods"),
        "sparse_note": F.when(F.col("ln") == 1, F.concat(F.lit("CN/"), ok.cast("string"))),
    }
    return values[role]


def table_id() -> Column:
    return (F.col("ok") / F.lit(ORDERS_PER_TABLE)).cast("bigint")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header parts of every uploaded table (one row per column)."""
    from .tables import read_table

    orders = read_table(spark, sf_dir, "orders", ["o_orderkey"])
    tables = orders.select((F.col("o_orderkey") / F.lit(ORDERS_PER_TABLE)).cast("bigint").alias("table_id")).distinct()
    t = F.pmod(F.col("table_id"), F.lit(len(TEMPLATES)))
    arr = None
    for i, (kind, cols) in enumerate(TEMPLATES):
        a = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(p).cast("int").alias("pos"),
                               F.lit(p1).cast("string").alias("part1"), F.lit(p2).cast("string").alias("part2"))
                      for p, (p1, p2, _r) in enumerate(cols)])
        arr = F.when(t == i, a) if arr is None else arr.when(t == i, a)
    return tables.select("table_id", F.explode(arr).alias("c")).select(
        "table_id", "c.kind", "c.pos", "c.part1", "c.part2")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of every uploaded table as text, with its sheet row."""
    base = D.base_lines(spark, sf_dir).withColumn("table_id", table_id())
    rows = rank_in_group(base, ["table_id"], D.LINE_ORDER, name="row_no", start=2)
    t = F.pmod(F.col("table_id"), F.lit(len(TEMPLATES)))
    arr = None
    for i, (_kind, cols) in enumerate(TEMPLATES):
        a = F.array(*[F.struct(F.lit(p).cast("int").alias("pos"), _role_value(r).alias("value"))
                      for p, (_p1, _p2, r) in enumerate(cols)])
        arr = F.when(t == i, a) if arr is None else arr.when(t == i, a)
    return rows.select("table_id", "row_no", F.explode(arr).alias("c")).select(
        "table_id", "c.pos", "row_no", "c.value")


# Headers of the derived runs: (part1, part2, landing column) per column, in the order of the sheet.
RUN_HEADERS = {
    "PR": [
        [("Supplier GSTIN", None, "gstin_raw"), ("Vendor Inv No", None, "inv_raw"), ("Invoice Date", None, "date_raw"),
         ("Taxable Value", None, "taxable_raw"), ("CGST", None, "cgst_raw"), ("SGST", None, "sgst_raw"), ("IGST", None, "igst_raw"),
         ("Invoice Value", None, "invoice_value_raw"), ("Cess", None, "cess_raw"), ("Vendor Name", None, "vendor_name"),
         ("Purchase Type", None, "purchase_type"), ("Document Type", None, "doc_type")],
        [("Party Name", None, "vendor_name"), ("Type of Purchase", None, "purchase_type"), ("Doc Type", None, "doc_type"),
         ("Bill" + NBSP + "No", None, "inv_raw"), ("Bill Date", None, "date_raw"), ("Party GSTIN", None, "gstin_raw"),
         ("Cess Amount", None, "cess_raw"), ("IGST Amount", None, "igst_raw"), ("SGST Amount", None, "sgst_raw"),
         ("CGST Amount", None, "cgst_raw"), ("Assessable Value", None, "taxable_raw"), ("Value of Invoice", None, "invoice_value_raw")],
        [("Vendor", None, "vendor_name"), ("Col 2", None, "gstin_raw"), ("Reference", None, "inv_raw"), ("Bill Date", None, "date_raw"),
         ("Central Tax", None, "cgst_raw"), ("State Tax", None, "sgst_raw"), ("Integrated Tax", None, "igst_raw"),
         ("Taxable Amount", None, "taxable_raw"), ("Nature", None, "purchase_type"), ("Doc Type", None, "doc_type")]],
    "2B": [
        [("GSTIN of supplier", U.format(0), "gstin_raw"), ("Trade/Legal name", U.format(1), "trade_name"),
         ("Invoice details", "Invoice number", "inv_raw"), ("Invoice details", "Invoice type", "inv_type"),
         ("Invoice details", "Invoice Date", "date_raw"), ("Invoice details", "Invoice Value(₹)", "invoice_value_raw"),
         ("Nature of Transaction", U.format(6), "supply_type"), ("Supply Attract Reverse Charge", U.format(7), "reverse_charge"),
         ("Taxable Value (₹)", U.format(8), "taxable_raw"), ("Tax Amount", "Integrated Tax(₹)", "igst_raw"),
         ("Tax Amount", "Central Tax(₹)", "cgst_raw"), ("Tax Amount", "State/UT Tax(₹)", "sgst_raw"),
         ("Tax Amount", "Cess(₹)", "cess_raw"), ("GSTR-1/IFF/GSTR-5 Period", U.format(13), "filing_period"),
         ("GSTR-1/IFF/GSTR-5 Filing Date", U.format(14), "filing_date_raw"), ("ITC Availability", U.format(15), "itc_availability"),
         ("Note type", U.format(16), "note_type")]],
    "CDNR": [
        [("GSTIN of supplier", U.format(0), "gstin_raw"), ("Trade/Legal name", U.format(1), "trade_name"),
         ("Credit note/Debit note details", "Note type", "note_type"), ("Credit note/Debit note details", "Note number", "inv_raw"),
         ("Credit note/Debit note details", "Note date", "date_raw"), ("Invoice type", U.format(5), "inv_type"),
         ("Taxable Value (₹)", U.format(6), "taxable_raw"), ("Tax Amount", "Integrated Tax(₹)", "igst_raw"),
         ("Tax Amount", "Central Tax(₹)", "cgst_raw"), ("Tax Amount", "State/UT" + NBSP + "Tax(₹)", "sgst_raw"),
         ("GSTR-1/IFF/GSTR-5 Period", U.format(10), "filing_period"), ("GSTR-1/IFF/GSTR-5 Filing Date", U.format(11), "filing_date_raw"),
         ("ITC Availability", U.format(12), "itc_availability")],
        [("Note Date", None, "date_raw"), ("Number", None, "inv_raw"), ("GSTIN", None, "gstin_raw"), ("Legal Name", None, "trade_name"),
         ("Note Type", None, "note_type"), ("Inv Type", None, "inv_type"), ("Integrated Tax", None, "igst_raw"), ("Central Tax", None, "cgst_raw"),
         ("State/UT Tax", None, "sgst_raw"), ("Taxable Value", None, "taxable_raw"), ("Filing Date", None, "filing_date_raw"),
         ("Return Period", None, "filing_period"), ("ITC Available", None, "itc_availability")]],
}
RUN_KINDS = ("PR", "2B", "CDNR")


def run_uploads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalog, rows, choices) of the derived runs: table_id = 3 x run_id + kind, headers by run_id.

    Note sheets of the second layout name their number so that nobody finds it: there a choice tells."""
    run = (F.col("ok") / F.lit(ORDERS_PER_RUN)).cast("bigint")
    sheets = (D.BOOK_PR, D.SHEET_B2B, D.SHEET_CDNR)  # in the order of RUN_KINDS
    facts = D.placed_facts(D.line_facts(spark, sf_dir), sheets)
    kind_no = F.array_position(F.array(*[F.lit(s) for s in sheets]), F.col("sheet")) - 1
    facts = facts.withColumn("table_id", run * len(RUN_KINDS) + kind_no)

    def cells(rows: DataFrame) -> DataFrame:
        """The cells are made of the sorted facts, once, after the exchange."""
        own = {D.BOOK_PR: dict(zip(D.PR_COLUMNS, D.pr_sheet_cells(), strict=True))}
        own |= dict.fromkeys(sheets[1:], dict(zip(D.B2_COLUMNS, D.b2_sheet_cells(), strict=True)))
        out = None
        for sheet, kind in zip(sheets, RUN_KINDS, strict=True):
            value = _by_layout(run, kind, lambda cols: F.array(*[own[sheet][c] for _p1, _p2, c in cols]))
            out = F.when(F.col("sheet") == sheet, value) if out is None else out.when(F.col("sheet") == sheet, value)
        return D.line_values(rows).select("table_id", out.alias("cells"))

    rows = rank_in_group(facts, ["table_id"], D.LINE_ORDER, name="row_no", start=1, post=cells)
    first = F.when(F.col("table_id") % len(RUN_KINDS) == 0, F.lit(D.PR_FIRST_ROW)).otherwise(F.lit(D.PORTAL_FIRST_ROW))
    rows = rows.select("table_id", (F.col("row_no") + first - 1).alias("row_no"), "cells")
    tables = rows.select("table_id").distinct().select("table_id", F.floor(F.col("table_id") / len(RUN_KINDS)).alias("run_id"),
                                                       F.element_at(F.array(*[F.lit(k) for k in RUN_KINDS]), (F.col("table_id") % len(RUN_KINDS) + 1).cast("int")).alias("kind"))

    def heads(cols):
        return F.array(*[F.struct(F.lit(p).cast("int").alias("pos"), F.lit(p1).cast("string").alias("part1"), F.lit(p2).cast("string").alias("part2"))
                         for p, (p1, p2, _c) in enumerate(cols)])

    parts = None
    for kind in RUN_KINDS:
        value = _by_layout(F.col("run_id"), kind, heads)
        parts = F.when(F.col("kind") == kind, value) if parts is None else parts.when(F.col("kind") == kind, value)
    catalog = tables.select("table_id", "run_id", "kind", F.explode(parts).alias("h")).select("table_id", "run_id", "kind", "h.*")
    hidden = tables.where((F.col("kind") == "CDNR") & (F.col("run_id") % len(RUN_HEADERS["CDNR"]) == 1))
    choices = hidden.select("table_id", F.lit("note_no").alias("role"), F.lit(" NUMBER ").alias("choice"))
    return catalog, rows, choices


def _by_layout(run: Column, kind: str, make) -> Column:
    layouts = RUN_HEADERS[kind]
    out = None
    for i, cols in enumerate(layouts):
        hit = F.pmod(run, F.lit(len(layouts))) == i
        out = F.when(hit, make(cols)) if out is None else out.when(hit, make(cols))
    return out
