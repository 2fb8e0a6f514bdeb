"""Registry of the queries exposed through ``__spark_entry__``.

Each entry maps a query name to a Spark callable ``(spark, sf_dir) ->
DataFrame`` and, where the semantics are expressible in SQL, to the
equivalent DuckDB query in ``plans.oracle`` style.  Column names are the same
on both sides; money is DECIMAL(38,2), counts and row numbers BIGINT, dates
DATE, text VARCHAR.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import consolidate as C
from ..operators import dashboard as DB
from ..operators import lines as L
from ..operators import pairing as P
from ..session import scratch_path
from ..sources import files as X
from ..sources.scratch import materialize
from . import oracle as O
from .given import sheet_from_rows
from .reconcile import get_run

SparkQuery = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, SparkQuery] = {}
ORACLE: dict[str, str] = {}


_MEMO: dict[tuple, DataFrame] = {}


def session_memo(kind: str, build: Callable[[SparkSession, str], DataFrame]) -> SparkQuery:
    """Build an eagerly written input once per (session, tables) for the
    queries that share it (the run's stages are shared the same way)."""
    def get(spark: SparkSession, sf: str) -> DataFrame:
        key = (kind, spark.sparkContext.applicationId, sf.rstrip("/"))
        if key not in _MEMO:
            _MEMO[key] = build(spark, sf)
        return _MEMO[key]
    return get


def register(name: str, sql: str | None = None):
    def deco(fn: SparkQuery) -> SparkQuery:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


MONEY = "decimal(38,2)"


def _money(c):
    return F.col(c).cast(MONEY).alias(c)


# =================================================================== sources
#: Headers under which the books are handed in again (uploads carry headers like these).
_PR_HEADERS = {"gstin_raw": "Supplier GSTIN", "inv_raw": "Vendor Inv No", "date_raw": "Invoice Date", "doc_type": "Document Type",
               "vendor_name": "Vendor Name", "purchase_type": "Purchase Type", "taxable_raw": "Taxable Value",
               "cgst_raw": "CGST", "sgst_raw": "SGST", "igst_raw": "IGST", "invoice_value_raw": "Invoice Value", "cess_raw": "Cess"}
_B2_HEADERS = {"gstin_raw": "GSTIN of supplier", "inv_raw": "Invoice details Invoice number",
               "date_raw": "Invoice details Invoice Date", "inv_type": "Invoice details Invoice type", "note_type": "Note type",
               "trade_name": "Trade/Legal name", "reverse_charge": "Supply Attract Reverse Charge",
               "itc_availability": "ITC Availability", "filing_date_raw": "GSTR-1/IFF/GSTR-5 Filing Date",
               "filing_period": "GSTR-1/IFF/GSTR-5 Period", "supply_type": "Nature of Transaction",
               "taxable_raw": "Taxable Value (₹)", "cgst_raw": "Tax Amount Central Tax(₹)",
               "sgst_raw": "Tax Amount State/UT Tax(₹)", "igst_raw": "Tax Amount Integrated Tax(₹)", "total_tax_raw": "Total Tax",
               "invoice_value_raw": "Invoice Value(₹)", "cess_raw": "Tax Amount Cess(₹)"}
_CDNR_HEADERS = {**_B2_HEADERS, "inv_raw": "Credit note/Debit note details Note number",
                 "date_raw": "Credit note/Debit note details Note date", "inv_type": "Invoice type"}
_SHEET_HEADERS = {"B2B": _B2_HEADERS, "B2B-CDNR": _CDNR_HEADERS, "IMPG": _B2_HEADERS}


def _write_folder(spark, sf) -> str:
    """Both books as files of an upload folder: the register as CSV under one header row, the 2B sheets as cell files
    under the portal's six (the fifth has the names, the sixth nothing of its own)."""
    run = get_run(spark, sf)
    root = scratch_path(spark, "uploads", uuid.uuid4().hex)

    def with_head(rows, heads, columns):
        head = spark.createDataFrame([(i + 1, list(h)) for i, h in enumerate(heads)], "row_no long, cells array<string>")
        return rows.select("row_no", F.array(*[F.col(c) for c in columns]).alias("cells")).unionByName(head)

    X.write_csv(with_head(run.pr_landing, [_PR_HEADERS.values()], _PR_HEADERS), root, "register.xlsx", "Sheet1")
    for sheet, names in _SHEET_HEADERS.items():
        heads = [["GSTR-2B"], [], ["Supplies"], [], names.values(), [f"Unnamed: {i}_level_1" for i in range(len(names))]]
        X.write_cells(with_head(run.b2_landing.where(F.col("sheet") == sheet), heads, names), root, "gstr2b.xlsx", sheet)
    return root


_folder = session_memo("folder", _write_folder)


def _pr_sheet(spark, sf):
    """The register's rows as their file has them, under the landing names."""
    rows = sheet_from_rows(X.read_csv(spark, _folder(spark, sf)).where("workbook = 'register.xlsx'"), "flat")
    return rows.select("row_no", *[F.col(f"`{h}`").alias(c) for c, h in _PR_HEADERS.items()])


def _b2_sheets(spark, sf):
    cells = X.read_cells(spark, _folder(spark, sf)).where("workbook = 'gstr2b.xlsx'")
    parts = [sheet_from_rows(cells.where(F.col("sheet") == sheet), "portal").select(
        F.lit(sheet).alias("sheet"), "row_no", *[F.col(f"`{h}`").alias(c) for c, h in names.items()]) for sheet, names in _SHEET_HEADERS.items()]
    return reduce(DataFrame.unionByName, parts)


register("src_purchase_register", O.with_stage("landing") + f"""
SELECT CAST(row_no AS BIGINT) AS row_no, {", ".join(O.PR_COLS)} FROM pr_land""")(
    lambda spark, sf: _pr_sheet(spark, sf).select(F.col("row_no").cast("bigint"), *O.PR_COLS))

register("src_2b_sheet", O.with_stage("landing") + f"""
SELECT sheet, CAST(row_no AS BIGINT) AS row_no, {", ".join(O.B2_COLS)} FROM b2_land""")(
    lambda spark, sf: _b2_sheets(spark, sf).select("sheet", F.col("row_no").cast("bigint"), *O.B2_COLS))


@register("drop_blank_rows", O.with_stage("landing") + f"""
SELECT sheet, CAST(row_no AS BIGINT) AS row_no, gstin_raw, inv_raw FROM b2_land
WHERE NOT ({" AND ".join(f"{c} IS NULL" for c in O.B2_COLS)})""")
def _s3(spark, sf):
    rows = L.drop_blank_rows(get_run(spark, sf).b2_landing, L.B2_COLUMNS)
    return rows.select("sheet", F.col("row_no").cast("bigint"), "gstin_raw", "inv_raw")


@register("tag_source_sheet", O.with_stage("landing") + """
SELECT sheet, count(*) AS n_rows, CAST(min(row_no) AS BIGINT) AS first_row, CAST(max(row_no) AS BIGINT) AS last_row
FROM b2_land GROUP BY sheet""")
def _s4(spark, sf):
    return get_run(spark, sf).b2_landing.groupBy("sheet").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("row_no").cast("bigint").alias("first_row"),
        F.max("row_no").cast("bigint").alias("last_row"))


@register("row_numbering", O.with_stage("landing") + """
SELECT 'PR' AS book, 'PR' AS sheet, CAST(row_no AS BIGINT) AS row_no, inv_raw FROM pr_land
UNION ALL SELECT '2B', sheet, CAST(row_no AS BIGINT), inv_raw FROM b2_land""")
def _s5(spark, sf):
    """Rows numbered where they are read from the upload folder; nothing is sorted."""
    pr = _pr_sheet(spark, sf).select(F.lit("PR").alias("book"), F.lit("PR").alias("sheet"), F.col("row_no").cast("bigint"), "inv_raw")
    return pr.unionByName(_b2_sheets(spark, sf).select(F.lit("2B").alias("book"), "sheet", F.col("row_no").cast("bigint"), "inv_raw"))


# =================================================================== scalar rules
@register("norm_text", O.with_stage("landing") + f"""
SELECT CAST(row_no AS BIGINT) AS row_no, {O.nt('gstin_raw')} AS gstin_text, {O.nt('inv_raw')} AS inv_text,
       {O.nt('vendor_name')} AS name_text, {O.nt('cgst_raw')} AS cgst_text
FROM pr_land""")
def _n1(spark, sf):
    return get_run(spark, sf).pr_landing.select(
        F.col("row_no").cast("bigint"), N.norm_text("gstin_raw").alias("gstin_text"),
        N.norm_text("inv_raw").alias("inv_text"), N.norm_text("vendor_name").alias("name_text"),
        N.norm_text("cgst_raw").alias("cgst_text"))


@register("norm_gstin", O.with_stage("lines") + """
SELECT 'PR' AS book, CAST(row_no AS BIGINT) AS row_no, gstin_raw, gst_key FROM pr_lines
UNION ALL SELECT sheet, CAST(row_no AS BIGINT), gstin_raw, gst_key FROM b2_lines""")
def _n2(spark, sf):
    run = get_run(spark, sf)
    return run.pr_lines.select(F.lit("PR").alias("book"), F.col("row_no").cast("bigint"), "gstin_raw", "gst_key") \
        .unionByName(run.b2_lines.select(F.col("sheet").alias("book"), F.col("row_no").cast("bigint"),
                                         "gstin_raw", "gst_key"))


@register("norm_invoice", O.with_stage("lines") + """
SELECT 'PR' AS book, CAST(row_no AS BIGINT) AS row_no, inv_raw, inv_key FROM pr_lines
UNION ALL SELECT sheet, CAST(row_no AS BIGINT), inv_raw, inv_key FROM b2_lines""")
def _n3(spark, sf):
    run = get_run(spark, sf)
    return run.pr_lines.select(F.lit("PR").alias("book"), F.col("row_no").cast("bigint"), "inv_raw", "inv_key") \
        .unionByName(run.b2_lines.select(F.col("sheet").alias("book"), F.col("row_no").cast("bigint"),
                                         "inv_raw", "inv_key"))


@register("parse_date", O.with_stage("lines") + """
SELECT 'PR' AS book, CAST(row_no AS BIGINT) AS row_no, date_raw, inv_date FROM pr_lines
UNION ALL SELECT sheet, CAST(row_no AS BIGINT), date_raw, inv_date FROM b2_lines""")
def _n4(spark, sf):
    run = get_run(spark, sf)
    return run.pr_lines.select(F.lit("PR").alias("book"), F.col("row_no").cast("bigint"), "date_raw", "inv_date") \
        .unionByName(run.b2_lines.select(F.col("sheet").alias("book"), F.col("row_no").cast("bigint"),
                                         "date_raw", "inv_date"))


@register("parse_amount", O.with_stage("lines") + """
SELECT CAST(row_no AS BIGINT) AS row_no, taxable_raw, cgst_raw, igst_raw, taxable, cgst, sgst, igst FROM pr_lines""")
def _n5(spark, sf):
    return get_run(spark, sf).pr_lines.select(
        F.col("row_no").cast("bigint"), "taxable_raw", "cgst_raw", "igst_raw", *[_money(a) for a in L.AMOUNTS])


@register("round_rupee", O.with_stage("lines") + """
SELECT sheet, CAST(row_no AS BIGINT) AS row_no, CAST(round_even(cgst, 0) AS BIGINT) AS cgst_rupee,
       CAST(round_even(igst, 0) AS BIGINT) AS igst_rupee, CAST(round_even(taxable, 0) AS BIGINT) AS taxable_rupee
FROM b2_lines""")
def _n6(spark, sf):
    return get_run(spark, sf).b2_lines.select(
        "sheet", F.col("row_no").cast("bigint"), *[
            N.round_rupee(c).cast("bigint").alias(f"{c}_rupee") for c in ("cgst", "igst", "taxable")])


# =================================================================== aggregation / pairing
@register("consolidate_by_key", O.with_stage("cons") + """
SELECT 'PR' AS book, gst_key, inv_key, taxable, cgst, sgst, igst, CAST(NULL AS DECIMAL(38,2)) AS total_tax, invoice_value, cess,
       inv_date, gstin_raw, inv_orig, doc_type AS type, vendor_name AS name, purchase_type AS supply_type,
       CAST(NULL AS VARCHAR) AS note_type, CAST(NULL AS VARCHAR) AS reverse_charge, CAST(NULL AS VARCHAR) AS itc_availability,
       CAST(NULL AS VARCHAR) AS filing_date_raw, CAST(NULL AS VARCHAR) AS filing_period,
       CAST(first_row AS BIGINT) AS first_row, CAST(n_lines AS BIGINT) AS n_lines FROM pr_cons
UNION ALL
SELECT sheet, gst_key, inv_key, taxable, cgst, sgst, igst, total_tax, invoice_value, cess, inv_date, gstin_raw, inv_orig,
       inv_type, trade_name, supply_type, note_type, reverse_charge, itc_availability, filing_date_raw, filing_period,
       CAST(first_row AS BIGINT), CAST(n_lines AS BIGINT) FROM b2_cons""")
def _a1(spark, sf):
    run = get_run(spark, sf)

    texts = ["note_type", "reverse_charge", "itc_availability", "filing_date_raw", "filing_period"]

    def book(df, name, type_col, name_col, supply):
        amounts = [_money(a) if a in df.columns else F.lit(None).cast(MONEY).alias(a) for a in P.ALL_AMOUNTS]
        return df.select(
            name.alias("book"), "gst_key", "inv_key", *amounts, "inv_date", "gstin_raw", "inv_orig",
            F.col(type_col).alias("type"), F.col(name_col).alias("name"), F.col(supply).alias("supply_type"),
            *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in texts],
            F.col("first_row").cast("bigint"), F.col("n_lines").cast("bigint"))

    return book(run.pr_cons, F.lit("PR"), "doc_type", "vendor_name", "purchase_type").unionByName(
        book(run.b2_cons, F.col("sheet"), "inv_type", "trade_name", "supply_type"))


@register("reconcile_given", O.with_stage("pairs") + """
SELECT gst_key, inv_key, sheet, mapping, remarks, reason, vendor_name, invoice_type, pr_invoice_value, pr_cess,
       b2_total_tax, b2_invoice_value, b2_cess FROM pairs""")
def _given(spark, sf):
    """The upload folder's two workbooks, their columns found by the headers, reconciled from there."""
    from .given import reconcile_files

    run = reconcile_files(spark, _folder(spark, sf), "register.xlsx", "gstr2b.xlsx")
    return run.pairs.select("gst_key", "inv_key", "sheet", "mapping", "remarks", "reason", "vendor_name", "invoice_type",
                            *[_money(f"pr_{a}") for a in ("invoice_value", "cess")], *[_money(f"b2_{a}") for a in L.MORE_AMOUNTS])


@register("recon_outer_join", O.with_stage("pairs") + """
SELECT gst_key, inv_key, sheet, pr_exists, pr_cgst, b2_cgst, pr_igst, b2_igst, pr_date, b2_date FROM joined""")
def _j1(spark, sf):
    return get_run(spark, sf).joined.select(
        "gst_key", "inv_key", "sheet", "pr_exists", _money("pr_cgst"), _money("b2_cgst"), _money("pr_igst"),
        _money("b2_igst"), "pr_date", "b2_date")


@register("classify_pairs", O.with_stage("pairs") + """
SELECT CAST(pair_id AS BIGINT) AS pair_id, gst_key, inv_key, sheet, mapping, remarks, reason FROM pairs""")
def _j3(spark, sf):
    return get_run(spark, sf).pairs.select(
        F.col("pair_id").cast("bigint"), "gst_key", "inv_key", "sheet", "mapping", "remarks", "reason")


@register("dashboard", O.with_stage("pairs") + """
, d AS (
  SELECT * FROM (VALUES ('Matched', 0), ('Almost Matched', 1), ('Not Matched', 2), ('Total', 3)) t(status, pos)
), s AS (
  SELECT CASE WHEN grouping(mapping) = 1 THEN 'Total' ELSE mapping END AS status,
         sum(coalesce(pr_cgst, 0)) AS pr_cgst, sum(coalesce(pr_sgst, 0)) AS pr_sgst, sum(coalesce(pr_igst, 0)) AS pr_igst,
         sum(coalesce(b2_cgst, 0)) AS b2_cgst, sum(coalesce(b2_sgst, 0)) AS b2_sgst, sum(coalesce(b2_igst, 0)) AS b2_igst
  FROM pairs GROUP BY ROLLUP (mapping)
)
SELECT d.status, CAST(d.pos AS INTEGER) AS pos,
       CAST(coalesce(s.pr_cgst, 0) AS DECIMAL(38,2)) AS pr_cgst, CAST(coalesce(s.pr_sgst, 0) AS DECIMAL(38,2)) AS pr_sgst,
       CAST(coalesce(s.pr_igst, 0) AS DECIMAL(38,2)) AS pr_igst,
       CAST(coalesce(s.pr_cgst, 0) + coalesce(s.pr_sgst, 0) + coalesce(s.pr_igst, 0) AS DECIMAL(38,2)) AS pr_total,
       CAST(coalesce(s.b2_cgst, 0) AS DECIMAL(38,2)) AS b2_cgst, CAST(coalesce(s.b2_sgst, 0) AS DECIMAL(38,2)) AS b2_sgst,
       CAST(coalesce(s.b2_igst, 0) AS DECIMAL(38,2)) AS b2_igst,
       CAST(coalesce(s.b2_cgst, 0) + coalesce(s.b2_sgst, 0) + coalesce(s.b2_igst, 0) AS DECIMAL(38,2)) AS b2_total
FROM d LEFT JOIN s ON d.status = s.status""")
def _a5(spark, sf):
    return DB.dashboard(get_run(spark, sf).pairs)


# =================================================================== more scalar rules
@register("render_date", O.with_stage("pairs") + """
SELECT CAST(pair_id AS BIGINT) AS pair_id,
       coalesce(strftime(pr_date, '%d-%m-%Y'), '') AS pr_date_display, coalesce(strftime(pr_date, '%Y%m%d'), '') AS pr_date_key,
       coalesce(strftime(pr_date, '%Y-%m-%d'), '') AS pr_date_iso, coalesce(strftime(b2_date, '%d-%m-%Y'), '') AS b2_date_display,
       coalesce(strftime(b2_date, '%Y%m%d'), '') AS b2_date_key, coalesce(strftime(b2_date, '%Y-%m-%d'), '') AS b2_date_iso
FROM pairs""")
def _n7(spark, sf):
    p = get_run(spark, sf).pairs
    return p.select(F.col("pair_id").cast("bigint"),
                    N.display_date("pr_date").alias("pr_date_display"), N.key_date("pr_date").alias("pr_date_key"),
                    N.iso_date("pr_date").alias("pr_date_iso"), N.display_date("b2_date").alias("b2_date_display"),
                    N.key_date("b2_date").alias("b2_date_key"), N.iso_date("b2_date").alias("b2_date_iso"))


@register("concat_key", O.with_stage("pairs") + """
SELECT CAST(pair_id AS BIGINT) AS pair_id, gst_key || '|' || inv_key AS pair_key FROM pairs""")
def _n8(spark, sf):
    return get_run(spark, sf).pairs.select(F.col("pair_id").cast("bigint"),
                                           N.concat_key("gst_key", "inv_key").alias("pair_key"))


@register("fuzzy_gstin", O.with_stage("pairs") + f"""
SELECT CAST(pair_id AS BIGINT) AS pair_id, gst_key, {O.fuzzy_g('gst_key')} AS fuzzy_gstin FROM pairs""")
def _n9(spark, sf):
    return get_run(spark, sf).pairs.select(F.col("pair_id").cast("bigint"), "gst_key",
                                           N.fuzzy_gstin("gst_key").alias("fuzzy_gstin"))


@register("fuzzy_invoice", O.with_stage("pairs") + f"""
SELECT CAST(pair_id AS BIGINT) AS pair_id, inv_key, {O.fuzzy_i('inv_key')} AS fuzzy_invoice FROM pairs""")
def _n10(spark, sf):
    return get_run(spark, sf).pairs.select(F.col("pair_id").cast("bigint"), "inv_key",
                                           N.fuzzy_invoice("inv_key").alias("fuzzy_invoice"))


@register("gstin_check", O.with_stage("lines") + f"""
SELECT sheet, CAST(row_no AS BIGINT) AS row_no, {O.is_gstin('gstin_raw')} AS gstin_valid,
       (coalesce(trade_name, '') <> '' AND NOT {O.is_gstin('trade_name')}) AS name_valid
FROM b2_lines WHERE sheet <> 'IMPG'""")
def _n11(spark, sf):
    b2 = get_run(spark, sf).b2_lines.where(F.col("sheet") != "IMPG")
    return b2.select("sheet", F.col("row_no").cast("bigint"), N.is_gstin("gstin_raw").alias("gstin_valid"),
                     N.is_valid_name("trade_name").alias("name_valid"))


@register("tax_period", O.with_stage("lines") + f"""
SELECT sheet, CAST(row_no AS BIGINT) AS row_no, filing_date, {O.tax_period_start('filing_date')} AS period_start,
       coalesce(strftime({O.tax_period_start('filing_date')}, '%b %Y'), '') AS tax_period
FROM b2_lines WHERE sheet <> 'IMPG'""")
def _n12(spark, sf):
    b2 = get_run(spark, sf).b2_lines.where(F.col("sheet") != "IMPG")
    return b2.select("sheet", F.col("row_no").cast("bigint"), "filing_date",
                     N.tax_period_start("filing_date").alias("period_start"),
                     N.tax_period_text("filing_date").alias("tax_period"))


@register("parse_month_year", O.with_stage("lines") + """
, m AS (
  SELECT sheet, row_no, filing_period,
         coalesce(try_strptime(trim(filing_period), '%b %Y'), try_strptime(trim(filing_period), '%b-%Y'),
                  try_strptime(trim(filing_period), '%B %Y'), try_strptime(trim(filing_period), '%B-%Y'),
                  try_strptime(trim(filing_period), '%m/%Y'), try_strptime(trim(filing_period), '%m-%Y'),
                  try_strptime(trim(filing_period), '%Y-%m')) AS d
  FROM b2_lines WHERE sheet <> 'IMPG'
)
SELECT sheet, CAST(row_no AS BIGINT) AS row_no, filing_period, CAST(year(d) AS INTEGER) AS year,
       CAST(month(d) AS INTEGER) AS month
FROM m""")
def _n15(spark, sf):
    b2 = get_run(spark, sf).b2_lines.where(F.col("sheet") != "IMPG")
    d = N.parse_month("filing_period")
    return b2.select("sheet", F.col("row_no").cast("bigint"), "filing_period",
                     F.year(d).alias("year"), F.month(d).alias("month"))


# =================================================================== projections
@register("suffix_sides", O.with_stage("pairs") + """
SELECT 'PR' AS side, gst_key, inv_key, CAST(NULL AS VARCHAR) AS sheet, pr_gstin AS gstin, pr_inv AS inv, pr_date AS inv_date,
       pr_taxable AS taxable, pr_cgst AS cgst, pr_sgst AS sgst, pr_igst AS igst, CAST(NULL AS DECIMAL(38,2)) AS total_tax,
       pr_invoice_value AS invoice_value, pr_cess AS cess, pr_doc_type AS type, pr_vendor_name AS name,
       CAST(pr_first_row AS BIGINT) AS first_row FROM pr_s
UNION ALL
SELECT '2B', gst_key, inv_key, sheet, b2_gstin, b2_inv, b2_date, b2_taxable, b2_cgst, b2_sgst, b2_igst, b2_total_tax,
       b2_invoice_value, b2_cess, b2_inv_type, b2_trade_name, CAST(b2_first_row AS BIGINT) FROM b2_s""")
def _p1(spark, sf):
    run = get_run(spark, sf)

    def side(name, df, prefix, type_col, name_col, sheet):
        return df.select(
            F.lit(name).alias("side"), "gst_key", "inv_key", sheet.alias("sheet"), F.col(f"{prefix}_gstin").alias("gstin"),
            F.col(f"{prefix}_inv").alias("inv"), F.col(f"{prefix}_date").alias("inv_date"),
            *[F.col(f"{prefix}_{a}").cast(MONEY).alias(a) for a in P.ALL_AMOUNTS], F.col(type_col).alias("type"),
            F.col(name_col).alias("name"), F.col(f"{prefix}_first_row").cast("bigint").alias("first_row"))

    return side("PR", P.suffix_pr(run.pr_cons), "pr", "pr_doc_type", "pr_vendor_name", F.lit(None).cast("string")).unionByName(
        side("2B", P.suffix_2b(run.b2_cons), "b2", "b2_inv_type", "b2_trade_name", F.col("sheet")))


@register("display_cols", O.with_stage("cons") + """
SELECT gst_key, inv_key, sheet, inv_orig AS inv_display, coalesce(strftime(inv_date, '%d-%m-%Y'), '') AS date_display,
       sheet AS display_source FROM b2_cons""")
def _p2(spark, sf):
    c = get_run(spark, sf).b2_cons
    return c.select("gst_key", "inv_key", "sheet", F.col("inv_orig").alias("inv_display"),
                    N.display_date("inv_date").alias("date_display"), F.col("sheet").alias("display_source"))


@register("rescue_empty_inv_key", O.with_stage("cons") + """
SELECT gst_key, inv_key, CAST(n_lines AS BIGINT) AS n_lines, taxable FROM b2_cons WHERE sheet = 'B2B-CDNR'""")
def _p3(spark, sf):
    c = get_run(spark, sf).b2_cons.where(F.col("sheet") == "B2B-CDNR")
    return c.select("gst_key", "inv_key", F.col("n_lines").cast("bigint"), _money("taxable"))


@register("invoice_type", O.with_stage("pairs") + """
SELECT CAST(pair_id AS BIGINT) AS pair_id, invoice_type FROM pairs""")
def _p4(spark, sf):
    return get_run(spark, sf).pairs.select(F.col("pair_id").cast("bigint"), "invoice_type")


@register("fill_cdnr_gstin", O.with_stage("pairs") + """
SELECT CAST(pair_id AS BIGINT) AS pair_id, sheet, b2_gstin FROM pairs WHERE sheet IS NOT NULL""")
def _p5(spark, sf):
    return get_run(spark, sf).pairs.where(F.col("sheet").isNotNull()).select(
        F.col("pair_id").cast("bigint"), "sheet", "b2_gstin")


_RECON_SQL = """
SELECT gst_key, inv_key, invoice_type, mapping, remarks, reason, vendor_name,
       coalesce(b2_filing_period, '') AS filing_period, coalesce(pr_gstin, '') AS pr_gstin,
       coalesce(b2_gstin, '') AS b2_gstin, coalesce(pr_inv, '') AS pr_inv, coalesce(b2_inv, '') AS b2_inv,
       coalesce(strftime(pr_date, '%Y-%m-%d'), '') AS pr_date, coalesce(strftime(b2_date, '%Y-%m-%d'), '') AS b2_date,
       pr_cgst, b2_cgst, pr_sgst, b2_sgst, pr_igst, b2_igst
FROM pairs"""


@register("recon_projection", O.with_stage("pairs") + _RECON_SQL)
def _p6(spark, sf):
    return P.recon_projection(get_run(spark, sf).pairs)


# =================================================================== filters and signs
@register("split_imports", O.with_stage("lines") + """
SELECT 'PR' AS book, CAST(row_no AS BIGINT) AS row_no, purchase_type AS type_text, is_import FROM pr_lines
UNION ALL
SELECT sheet, CAST(row_no AS BIGINT), supply_type, is_import FROM b2_lines WHERE sheet = 'B2B'""")
def _f1(spark, sf):
    run = get_run(spark, sf)
    pr = run.pr_lines.select(F.lit("PR").alias("book"), F.col("row_no").cast("bigint"),
                             F.col("purchase_type").alias("type_text"), "is_import")
    b2 = run.b2_lines.where(F.col("sheet") == "B2B").select(
        F.col("sheet").alias("book"), F.col("row_no").cast("bigint"), F.col("supply_type").alias("type_text"),
        "is_import")
    return pr.unionByName(b2)


@register("drop_total_rows", O.with_stage("lines") + """
SELECT 'PR' AS book, CAST(row_no AS BIGINT) AS row_no, gstin_raw, inv_raw FROM pr_lines WHERE is_total
UNION ALL SELECT sheet, CAST(row_no AS BIGINT), gstin_raw, inv_raw FROM b2_lines WHERE is_total""")
def _f2(spark, sf):
    run = get_run(spark, sf)
    pr = run.pr_lines.where("is_total").select(F.lit("PR").alias("book"), F.col("row_no").cast("bigint"),
                                               "gstin_raw", "inv_raw")
    b2 = run.b2_lines.where("is_total").select(F.col("sheet").alias("book"), F.col("row_no").cast("bigint"),
                                               "gstin_raw", "inv_raw")
    return pr.unionByName(b2)


@register("drop_empty_gstin", O.with_stage("lines") + """
SELECT 'PR' AS book, CAST(row_no AS BIGINT) AS row_no, inv_key FROM pr_lines
WHERE NOT is_import AND NOT is_total AND gst_key = ''
UNION ALL
SELECT sheet, CAST(row_no AS BIGINT), inv_key FROM b2_lines
WHERE ((sheet = 'B2B' AND NOT is_import) OR sheet = 'B2B-CDNR') AND NOT is_total AND gst_key = ''""")
def _f3(spark, sf):
    run = get_run(spark, sf)
    pr = run.pr_raw.where(~F.col("is_total") & (F.col("gst_key") == "")).select(
        F.lit("PR").alias("book"), F.col("row_no").cast("bigint"), "inv_key")
    b2 = L.matchable_2b(run.b2_lines).where(~F.col("is_total") & (F.col("gst_key") == "")).select(
        F.col("sheet").alias("book"), F.col("row_no").cast("bigint"), "inv_key")
    return pr.unionByName(b2)


@register("sign_credit_notes", O.with_stage("lines") + """
SELECT CAST(row_no AS BIGINT) AS row_no, note_type, taxable_raw, cgst_raw, taxable, cgst, sgst, igst
FROM b2_lines WHERE sheet = 'B2B-CDNR'""")
def _g1(spark, sf):
    c = L.cdnr_signed(get_run(spark, sf).b2_lines)
    return c.select(F.col("row_no").cast("bigint"), "note_type", "taxable_raw", "cgst_raw",
                    *[_money(a) for a in L.AMOUNTS])


# =================================================================== aggregations
@register("row_numbers_by_key", O.with_stage("lines") + """
SELECT '2B' AS book, gst_key, inv_key, array_to_string(list_sort(list(row_no)), ', ') AS row_numbers
FROM b2_lines WHERE ((sheet = 'B2B' AND NOT is_import) OR sheet = 'B2B-CDNR') AND gst_key <> '' AND inv_key <> ''
GROUP BY gst_key, inv_key
UNION ALL
SELECT 'PR', gst_key, inv_key, array_to_string(list_sort(list(row_no)), ', ')
FROM pr_lines WHERE NOT is_import AND gst_key <> '' AND inv_key <> ''
GROUP BY gst_key, inv_key""")
def _a2(spark, sf):
    run = get_run(spark, sf)
    b2 = C.row_numbers_by_key(L.matchable_2b(run.b2_lines), "row_numbers").withColumn("book", F.lit("2B"))
    pr = C.row_numbers_by_key(run.pr_raw, "row_numbers").withColumn("book", F.lit("PR"))
    return b2.unionByName(pr).select("book", "gst_key", "inv_key", "row_numbers")


@register("period_by_key", O.with_stage("lines") + f"""
SELECT gst_key, inv_key, arg_min({O.nt('filing_period')}, (CASE WHEN sheet = 'B2B' THEN 0 ELSE 1 END, row_no)) AS filing_period
FROM b2_lines WHERE ((sheet = 'B2B' AND NOT is_import) OR sheet = 'B2B-CDNR') AND gst_key <> '' AND inv_key <> ''
GROUP BY gst_key, inv_key""")
def _a3(spark, sf):
    return C.period_by_key(L.matchable_2b(get_run(spark, sf).b2_lines))


@register("vendor_name", O.with_stage("pairs") + """
SELECT gst_key, vendor_name FROM names""")
def _a4(spark, sf):
    return P.vendor_names(get_run(spark, sf).pairs.withColumn("fuzzy_reason", F.col("fuzzy_reason")))


@register("dashboard_pivot", O.with_stage("pairs") + """
, s AS (
  SELECT mapping, sum(coalesce(pr_cgst, 0)) AS pc, sum(coalesce(pr_sgst, 0)) AS ps, sum(coalesce(pr_igst, 0)) AS pi,
         sum(coalesce(b2_cgst, 0)) AS bc, sum(coalesce(b2_sgst, 0)) AS bs, sum(coalesce(b2_igst, 0)) AS bi
  FROM pairs GROUP BY mapping
), t AS (
  SELECT 'Matched' AS st, * FROM s WHERE mapping = 'Matched'
  UNION ALL SELECT 'Almost Matched', * FROM s WHERE mapping = 'Almost Matched'
  UNION ALL SELECT 'Not Matched', * FROM s WHERE mapping = 'Not Matched'
  UNION ALL SELECT 'Total', NULL, sum(pc), sum(ps), sum(pi), sum(bc), sum(bs), sum(bi) FROM s
), r AS (
  SELECT 'CGST' AS report, 0 AS report_pos, st, pc AS pr, bc AS b2 FROM t
  UNION ALL SELECT 'SGST', 1, st, ps, bs FROM t
  UNION ALL SELECT 'IGST', 2, st, pi, bi FROM t
  UNION ALL SELECT 'Total', 3, st, pc + ps + pi, bc + bs + bi FROM t
), lbl AS (SELECT * FROM (VALUES ('CGST', 0), ('SGST', 1), ('IGST', 2), ('Total', 3)) v(report, report_pos))
SELECT lbl.report, CAST(lbl.report_pos AS INTEGER) AS report_pos,
  CAST(coalesce(sum(pr) FILTER (WHERE st = 'Matched'), 0) AS DECIMAL(38,2)) AS matched_pr,
  CAST(coalesce(sum(b2) FILTER (WHERE st = 'Matched'), 0) AS DECIMAL(38,2)) AS matched_2b,
  CAST(coalesce(sum(pr) FILTER (WHERE st = 'Almost Matched'), 0) AS DECIMAL(38,2)) AS almost_pr,
  CAST(coalesce(sum(b2) FILTER (WHERE st = 'Almost Matched'), 0) AS DECIMAL(38,2)) AS almost_2b,
  CAST(coalesce(sum(pr) FILTER (WHERE st = 'Not Matched'), 0) AS DECIMAL(38,2)) AS not_matched_pr,
  CAST(coalesce(sum(b2) FILTER (WHERE st = 'Not Matched'), 0) AS DECIMAL(38,2)) AS not_matched_2b,
  CAST(coalesce(sum(pr) FILTER (WHERE st = 'Total'), 0) AS DECIMAL(38,2)) AS total_pr,
  CAST(coalesce(sum(b2) FILTER (WHERE st = 'Total'), 0) AS DECIMAL(38,2)) AS total_2b
FROM lbl LEFT JOIN r ON lbl.report = r.report GROUP BY lbl.report, lbl.report_pos""")
def _a6(spark, sf):
    return DB.dashboard_pivot(get_run(spark, sf).pairs)


@register("sum_column", O.with_stage("lines") + """
, parts AS (
  SELECT CASE WHEN sheet = 'B2B' AND is_import THEN 'B2B-IMPORTS' ELSE sheet END AS part, * FROM b2_lines
)
SELECT part, CAST(sum(coalesce(taxable, 0)) AS DECIMAL(38,2)) AS sum_taxable,
       CAST(sum(coalesce(cgst, 0)) AS DECIMAL(38,2)) AS sum_cgst, CAST(sum(coalesce(sgst, 0)) AS DECIMAL(38,2)) AS sum_sgst,
       CAST(sum(coalesce(igst, 0)) AS DECIMAL(38,2)) AS sum_igst
FROM parts GROUP BY part""")
def _a7(spark, sf):
    b2 = get_run(spark, sf).b2_lines
    part = F.when((F.col("sheet") == "B2B") & F.col("is_import"), F.lit("B2B-IMPORTS")).otherwise(F.col("sheet"))
    return DB.sum_column(b2.withColumn("part", part), L.AMOUNTS, ["part"])


# =================================================================== joins / windows / sets
@register("fuzzy_orphan_rescue", O.with_stage("pairs") + """
SELECT CAST(pair_id AS BIGINT) AS pair_id, gst_key, inv_key, sheet, b2_inv, b2_gstin, fuzzy_reason, pr_cgst, b2_cgst
FROM pairs WHERE fuzzy_reason IS NOT NULL""")
def _j2(spark, sf):
    p = get_run(spark, sf).pairs.where(F.col("fuzzy_reason").isNotNull())
    return p.select(F.col("pair_id").cast("bigint"), "gst_key", "inv_key", "sheet", "b2_inv", "b2_gstin",
                    "fuzzy_reason", _money("pr_cgst"), _money("b2_cgst"))


@register("status_lookup", O.with_stage("pairs") + """
SELECT gst_key, inv_key, mapping, remarks, reason FROM status""")
def _j4(spark, sf):
    return get_run(spark, sf).status


@register("fill_within_key", O.with_stage("pairs") + """
, k AS (SELECT gst_key, inv_key FROM pairs GROUP BY gst_key, inv_key HAVING count(*) > 1)
SELECT CAST(p.pair_id AS BIGINT) AS pair_id, p.gst_key, p.inv_key, p.sheet, p.b2_inv_type, p.b2_note_type,
       p.b2_trade_name, p.b2_filing_period, p.b2_gstin, p.b2_inv, p.b2_date, p.reason, p.pr_inv, p.pr_date
FROM pairs p JOIN k ON p.gst_key = k.gst_key AND p.inv_key = k.inv_key""")
def _w1(spark, sf):
    return get_run(spark, sf).pairs.where(F.col("key_rows") > 1).select(
        F.col("pair_id").cast("bigint"), "gst_key", "inv_key", "sheet", "b2_inv_type", "b2_note_type",
        "b2_trade_name", "b2_filing_period", "b2_gstin", "b2_inv", "b2_date", "reason", "pr_inv", "pr_date")


@register("fifo_rank", O.with_stage("pairs") + """
SELECT 'PR' AS side, gst_key, inv_key, CAST(0 AS INTEGER) AS sheet_rank, fg, fi, CAST(fifo AS BIGINT) AS fifo FROM pr_r
WHERE (fg, fi) IN (SELECT (fg, fi) FROM b2_r)
UNION ALL
SELECT '2B', src_gst, src_inv, CAST(src_rank AS INTEGER), fg, fi, CAST(fifo AS BIGINT) FROM b2_r
WHERE (fg, fi) IN (SELECT (fg, fi) FROM pr_r)""")
def _w2(spark, sf):
    ranked = P.fifo_ranks(get_run(spark, sf).joined)
    return ranked.select(F.when(F.col("side") == 0, F.lit("PR")).otherwise(F.lit("2B")).alias("side"), "gst_key", "inv_key",
                         F.col("sheet_rank").cast("int"), "fg", "fi", F.col("fifo").cast("bigint"))


@register("sort_pairs", O.with_stage("pairs") + """
SELECT CAST(pair_id AS BIGINT) AS pair_id, gst_key, inv_key, sheet FROM pairs ORDER BY pair_id""")
def _t2(spark, sf):
    return get_run(spark, sf).pairs.select(F.col("pair_id").cast("bigint"), "gst_key", "inv_key", "sheet") \
        .orderBy("pair_id")


@register("union_sheets", O.with_stage("cons") + """
SELECT gst_key, inv_key, sheet, taxable, cgst, sgst, igst, CASE WHEN sheet = 'B2B' THEN total_tax END AS total_tax, inv_date, trade_name,
       CASE WHEN sheet = 'B2B' THEN reverse_charge END AS reverse_charge, CASE WHEN sheet = 'B2B' THEN supply_type END AS supply_type,
       CASE WHEN sheet = 'B2B-CDNR' THEN note_type END AS note_type FROM b2_cons""")
def _u1(spark, sf):
    """The two sheets consolidated each on its own, under columns of its own, and united by name."""
    run = get_run(spark, sf)
    shared = ["gstin_raw", "inv_orig", "trade_name"]
    b2b = C.consolidate_by_key(run.b2b_raw, [*shared, "reverse_charge", "supply_type"], sums=[*L.AMOUNTS, "total_tax"])
    cdnr = C.consolidate_by_key(run.cdnr_raw, [*shared, "note_type"], sums=L.AMOUNTS).withColumn("sheet", F.lit("B2B-CDNR"))
    cdnr = C.rescue_empty_inv_key(materialize(cdnr, "notes"))
    return b2b.withColumn("sheet", F.lit("B2B")).unionByName(cdnr, allowMissingColumns=True).select(
        "gst_key", "inv_key", "sheet", *[_money(a) for a in [*L.AMOUNTS, "total_tax"]], "inv_date", "trade_name", "reverse_charge",
        "supply_type", "note_type")


@register("distinct_names", O.with_stage("pairs") + """
SELECT DISTINCT gst_key, pr_vendor_name AS name, 'PR' AS side FROM pairs WHERE pr_vendor_name IS NOT NULL
UNION
SELECT DISTINCT gst_key, b2_trade_name, '2B' FROM pairs WHERE b2_trade_name IS NOT NULL""")
def _u3(spark, sf):
    p = get_run(spark, sf).pairs
    pr = p.select("gst_key", F.col("pr_vendor_name").alias("name"), F.lit("PR").alias("side"))
    b2 = p.select("gst_key", F.col("b2_trade_name").alias("name"), F.lit("2B").alias("side"))
    return pr.unionByName(b2).dropDuplicates().na.drop()


# =================================================================== comments
from ..operators import comments as CM  # noqa: E402
from ..operators import itc as ITC  # noqa: E402

_B2_PART = "((sheet = 'B2B' AND NOT is_import) OR sheet = 'B2B-CDNR')"
_COMMENT_CTES = f"""
, rl2b AS (
  SELECT gst_key, inv_key, array_to_string(list_sort(list(row_no)), ', ') AS rws FROM b2_lines
  WHERE {_B2_PART} AND gst_key <> '' AND inv_key <> '' GROUP BY gst_key, inv_key
), rlpr AS (
  SELECT gst_key, inv_key, array_to_string(list_sort(list(row_no)), ', ') AS rws FROM pr_lines
  WHERE NOT is_import AND gst_key <> '' AND inv_key <> '' GROUP BY gst_key, inv_key
), info_pr AS (
  SELECT s.gst_key, s.inv_key, s.mapping, s.remarks, s.reason,
         CASE WHEN s.mapping IN ('Matched', 'Almost Matched') THEN coalesce(r.rws, '') ELSE '' END AS row_number_in_2b
  FROM status s LEFT JOIN rl2b r ON s.gst_key = r.gst_key AND s.inv_key = r.inv_key
), info_2b AS (
  SELECT s.gst_key, s.inv_key, s.mapping, s.remarks, s.reason,
         CASE WHEN s.mapping IN ('Matched', 'Almost Matched') THEN coalesce(r.rws, '') ELSE '' END AS row_number_in_pr
  FROM status s LEFT JOIN rlpr r ON s.gst_key = r.gst_key AND s.inv_key = r.inv_key
), prc AS (
  SELECT l.*, coalesce(i.mapping, '') AS mapping, coalesce(i.remarks, '') AS remarks, coalesce(i.reason, '') AS reason,
         coalesce(i.row_number_in_2b, '') AS row_number_in_2b
  FROM pr_lines l LEFT JOIN info_pr i ON l.gst_key = i.gst_key AND l.inv_key = i.inv_key WHERE NOT l.is_import
), b2c AS (
  SELECT l.*, coalesce(i.mapping, '') AS mapping, coalesce(i.remarks, '') AS remarks, coalesce(i.reason, '') AS reason,
         coalesce(i.row_number_in_pr, '') AS row_number_in_pr,
         coalesce(strftime({O.tax_period_start('l.filing_date')}, '%b %Y'), '') AS tax_period
  FROM b2_lines l LEFT JOIN info_2b i ON l.gst_key = i.gst_key AND l.inv_key = i.inv_key WHERE {_B2_PART}
)"""


def _comments(spark, sf):
    run = get_run(spark, sf)
    return run, run.status


@register("pr_comments", O.with_stage("pairs") + _COMMENT_CTES + """
SELECT CAST(row_no AS BIGINT) AS row_no, gstin_raw, inv_raw, mapping, remarks, reason, row_number_in_2b FROM prc""")
def _j5(spark, sf):
    run, st = _comments(spark, sf)
    return CM.pr_comments(run.pr_raw, run.b2_lines, st).select(
        F.col("row_no").cast("bigint"), "gstin_raw", "inv_raw", "mapping", "remarks", "reason", "row_number_in_2b")


@register("b2b_comments", O.with_stage("pairs") + _COMMENT_CTES + """
SELECT CAST(row_no AS BIGINT) AS row_no, gstin_raw, inv_raw, mapping, remarks, reason, row_number_in_pr, tax_period
FROM b2c WHERE sheet = 'B2B'""")
def _j6(spark, sf):
    run, st = _comments(spark, sf)
    return CM.b2_comments(run.b2b_raw, run.pr_raw, st).select(
        F.col("row_no").cast("bigint"), "gstin_raw", "inv_raw", "mapping", "remarks", "reason", "row_number_in_pr",
        "tax_period")


@register("cdnr_comments", O.with_stage("pairs") + _COMMENT_CTES + """
SELECT CAST(row_no AS BIGINT) AS row_no, gstin_raw, inv_raw, taxable, cgst, sgst, igst, mapping, remarks, reason,
       row_number_in_pr, tax_period
FROM b2c WHERE sheet = 'B2B-CDNR'""")
def _j7(spark, sf):
    run, st = _comments(spark, sf)
    return CM.b2_comments(run.cdnr_raw, run.pr_raw, st).select(
        F.col("row_no").cast("bigint"), "gstin_raw", "inv_raw", *[_money(a) for a in L.AMOUNTS], "mapping",
        "remarks", "reason", "row_number_in_pr", "tax_period")


def _n14(x: str) -> str:
    s = f"regexp_replace(replace(coalesce({x}, ''), ',', ''), '(?i)nan', '', 'g')"
    return f"coalesce(TRY_CAST(regexp_replace({s}, '^{O.WS}+|{O.WS}+$', '', 'g') AS DECIMAL(38,10)), CAST(0 AS DECIMAL(38,10)))"


@register("comments_projection", O.with_stage("pairs") + _COMMENT_CTES + f"""
SELECT CAST(row_no AS BIGINT) AS row_no, gstin_raw AS gstin, inv_raw AS invoice_no, date_raw AS invoice_date,
       doc_type AS document_type, vendor_name, purchase_type, {_n14('taxable_raw')} AS taxable_value,
       {_n14('cgst_raw')} AS cgst, {_n14('sgst_raw')} AS sgst, {_n14('igst_raw')} AS igst,
       mapping, remarks, reason, row_number_in_2b
FROM prc""")
def _p7(spark, sf):
    run, st = _comments(spark, sf)
    sheet = CM.pr_comments_sheet(CM.pr_comments(run.pr_raw, run.b2_lines, st))
    return sheet.withColumn("row_no", F.col("row_no").cast("bigint"))


@register("coerce_numeric_columns", O.with_stage("lines") + f"""
SELECT CAST(row_no AS BIGINT) AS row_no, taxable_raw, {_n14('taxable_raw')} AS taxable_value,
       {_n14('cgst_raw')} AS cgst, {_n14('sgst_raw')} AS sgst, {_n14('igst_raw')} AS igst
FROM pr_lines WHERE NOT is_import""")
def _n14q(spark, sf):
    pr = get_run(spark, sf).pr_raw.select(
        F.col("row_no").cast("bigint"), "taxable_raw", F.col("taxable_raw").alias("taxable_value"),
        F.col("cgst_raw").alias("cgst"), F.col("sgst_raw").alias("sgst"), F.col("igst_raw").alias("igst"))
    return CM.coerce_numeric_columns(pr, keep=("taxable_raw",))


def _n13_month(x: str) -> str:
    d = (f"coalesce(try_strptime(trim({x}), '%b %Y'), try_strptime(trim({x}), '%b-%Y'), "
         f"try_strptime(trim({x}), '%B %Y'), try_strptime(trim({x}), '%B-%Y'))")
    return f"CASE WHEN {d} IS NOT NULL THEN strftime({d}, '%b-%Y') ELSE {x} END"


@register("format_period_columns", O.with_stage("pairs") + _COMMENT_CTES + f"""
SELECT CAST(row_no AS BIGINT) AS row_no,
       CASE WHEN filing_date IS NOT NULL THEN strftime(filing_date, '%d-%m-%Y') ELSE filing_date_raw END AS filing_date,
       {_n13_month('filing_period')} AS filing_period, {_n13_month('tax_period')} AS tax_period
FROM b2c WHERE sheet = 'B2B'""")
def _n13q(spark, sf):
    run, st = _comments(spark, sf)
    sheet = CM.b2_comments_sheet(CM.b2_comments(run.b2b_raw, run.pr_raw, st), signed=False)
    return sheet.select(F.col("row_no").cast("bigint"), "filing_date", "filing_period", "tax_period")


# =================================================================== ITC
_ITC_FLAGS = f"""
, flags AS (
  SELECT l.*, coalesce(lower({O.trim_ws('s.mapping')}) = 'not matched', FALSE) AS nm
  FROM b2_lines l LEFT JOIN status s ON l.gst_key = s.gst_key AND l.inv_key = s.inv_key
)"""
_SHEET_SQL = {"B2B": "(sheet = 'B2B' AND NOT is_import)", "B2B-CDNR": "(sheet = 'B2B-CDNR')"}
_FILTER_SQL = {"all": "TRUE", "rcm_yes": "rcm_yes", "itc_no": "itc_no"}


def _sum_sql(cond: str, t: str) -> str:
    return f"CAST(coalesce(sum({t}) FILTER (WHERE {cond}), 0) AS DECIMAL(38,2))"


_A8_PARTS = []
for _sh, _sc in _SHEET_SQL.items():
    for _f, _fc in _FILTER_SQL.items():
        for _nm, _nc in (("any", "TRUE"), ("not matched", "nm")):
            _cond = f"{_sc} AND {_fc} AND {_nc}"
            _A8_PARTS.append(f"SELECT '{_sh}' AS sheet, '{_f}' AS filter, '{_nm}' AS status_filter, "
                             + ", ".join(f"{_sum_sql(_cond, t)} AS {t}" for t in ("igst", "cgst", "sgst"))
                             + " FROM flags")


@register("itc_filtered_sum", O.with_stage("pairs") + _ITC_FLAGS + "\n" + "\nUNION ALL\n".join(_A8_PARTS))
def _a8(spark, sf):
    run = get_run(spark, sf)
    return ITC.itc_filtered_sum(run.b2_lines, run.status)


def _itc_table_sql(return_month: str) -> str:
    y, m = return_month.split("-")
    tp = O.tax_period_start("coalesce(filing_date, inv_date)")
    prior = f"({tp} < make_date({int(y)}, {int(m)}, 1))"
    cols = [f"{_sum_sql('sheet = ' + chr(39) + 'IMPG' + chr(39) + ' OR (sheet = ' + chr(39) + 'B2B' + chr(39) + ' AND is_import)', 'igst')} AS imp_igst"]
    for sh, s in (("B2B", "b2b"), ("B2B-CDNR", "cdnr")):
        for f, fc in _FILTER_SQL.items():
            for t in ("igst", "cgst", "sgst"):
                cols.append(f"{_sum_sql(_SHEET_SQL[sh] + ' AND ' + fc, t)} AS {s}_{f}_{t}")
                cols.append(f"{_sum_sql(_SHEET_SQL[sh] + ' AND ' + fc + ' AND nm', t)} AS nm_{s}_{f}_{t}")
        for t in ("igst", "cgst", "sgst"):
            cols.append(f"{_sum_sql(_SHEET_SQL[sh] + ' AND ' + prior, t)} AS {s}_prior_{t}")
    z = "CAST(0 AS DECIMAL(38,2))"
    v = {
        "4A1": {"igst": "imp_igst", "cgst": z, "sgst": z},
        "4A3": {t: f"b2b_rcm_yes_{t}" for t in ("igst", "cgst", "sgst")},
        "4A5": {t: f"(b2b_all_{t} + cdnr_all_{t} - b2b_rcm_yes_{t} - b2b_itc_no_{t})" for t in ("igst", "cgst", "sgst")},
        "4B2": {t: f"(nm_b2b_all_{t} + nm_cdnr_all_{t} - nm_b2b_rcm_yes_{t} - nm_b2b_itc_no_{t})"
                for t in ("igst", "cgst", "sgst")},
        "4D1": {t: f"(b2b_prior_{t} + cdnr_prior_{t})" for t in ("igst", "cgst", "sgst")},
        "4D2": {t: f"(b2b_itc_no_{t} + cdnr_itc_no_{t})" for t in ("igst", "cgst", "sgst")},
    }
    v["4A"] = {t: f"({v['4A1'][t]} + {v['4A3'][t]} + {v['4A5'][t]})" for t in ("igst", "cgst", "sgst")}
    v["4B"] = dict(v["4B2"])
    v["4C"] = {t: f"({v['4A'][t]} - {v['4B'][t]})" for t in ("igst", "cgst", "sgst")}
    rows = []
    for pos, (code, details) in enumerate(ITC.ITC_CODES):
        vals = v.get(code, {"igst": z, "cgst": z, "sgst": z})
        rows.append(f"SELECT '{code}' AS code, CAST({pos} AS INTEGER) AS pos, '{details}' AS details, "
                    f"CAST({vals['igst']} AS DECIMAL(38,2)) AS integrated, CAST({vals['cgst']} AS DECIMAL(38,2)) AS central, "
                    f"CAST({vals['sgst']} AS DECIMAL(38,2)) AS state, {z} AS cess FROM t")
    return (O.with_stage("pairs") + _ITC_FLAGS + f"\n, t AS (SELECT {', '.join(cols)} FROM flags)\n"
            + "\nUNION ALL\n".join(rows))


@register("itc_table", _itc_table_sql("1997-01"))
def _a9(spark, sf):
    run = get_run(spark, sf)
    return ITC.itc_table(run.b2_lines, run.status, run.return_month)


@register("prior_period_itc", O.with_stage("lines") + f"""
SELECT {", ".join(f"CAST(coalesce(sum({t}) FILTER (WHERE {O.tax_period_start('coalesce(filing_date, inv_date)')} < DATE '1997-01-01'), 0) AS DECIMAL(38,2)) AS {t}" for t in ("igst", "cgst", "sgst"))}
FROM b2_lines WHERE {_B2_PART}""")
def _a10(spark, sf):
    run = get_run(spark, sf)
    return ITC.prior_period_itc(run.b2_lines, run.return_month)


@register("filter_rcm", O.with_stage("lines") + """
SELECT CAST(row_no AS BIGINT) AS row_no, gst_key, inv_key, reverse_charge, igst, cgst, sgst
FROM b2_lines WHERE sheet = 'B2B' AND NOT is_import AND rcm_yes""")
def _f4(spark, sf):
    b = get_run(spark, sf).b2b_raw.where("rcm_yes")
    return b.select(F.col("row_no").cast("bigint"), "gst_key", "inv_key", "reverse_charge",
                    *[_money(t) for t in ("igst", "cgst", "sgst")])


@register("filter_itc_no", O.with_stage("lines") + f"""
SELECT sheet, CAST(row_no AS BIGINT) AS row_no, gst_key, inv_key, itc_availability, igst, cgst, sgst
FROM b2_lines WHERE {_B2_PART} AND itc_no""")
def _f5(spark, sf):
    b = L.matchable_2b(get_run(spark, sf).b2_lines).where("itc_no")
    return b.select("sheet", F.col("row_no").cast("bigint"), "gst_key", "inv_key", "itc_availability",
                    *[_money(t) for t in ("igst", "cgst", "sgst")])


@register("filter_not_matched", O.with_stage("pairs") + _ITC_FLAGS + f"""
SELECT sheet, CAST(row_no AS BIGINT) AS row_no, gst_key, inv_key, igst, cgst, sgst
FROM flags WHERE {_B2_PART} AND nm""")
def _f6(spark, sf):
    run = get_run(spark, sf)
    b = ITC.lines_with_status(L.matchable_2b(run.b2_lines), run.status).where("nm")
    return b.select("sheet", F.col("row_no").cast("bigint"), "gst_key", "inv_key",
                    *[_money(t) for t in ("igst", "cgst", "sgst")])


# =================================================================== review, saved state, run log
from ..operators import dormant as DM  # noqa: E402
from ..operators import review as RV  # noqa: E402
from ..sources.tables import read_table  # noqa: E402

_REVIEWED = """
, reviewed AS (
  SELECT * REPLACE (
    CASE WHEN mapping = 'Almost Matched' THEN (CASE WHEN pair_id % 2 = 0 THEN 'Matched' ELSE 'Not Matched' END)
         ELSE mapping END AS mapping,
    CASE WHEN mapping = 'Almost Matched' THEN (CASE WHEN pair_id % 2 = 0 THEN 'Accepted by User' ELSE 'Rejected by User' END)
         ELSE remarks END AS remarks,
    CASE WHEN mapping = 'Almost Matched' THEN (CASE WHEN pair_id % 2 = 0 THEN 'User Verified'
                                                    ELSE coalesce(reason, '') || ' (Rejected)' END)
         ELSE reason END AS reason)
  FROM pairs
)"""


@register("review_candidates", O.with_stage("pairs") + """
SELECT CAST(pair_id AS BIGINT) AS id, gst_key, inv_key, mapping, remarks, reason, vendor_name, invoice_type,
       coalesce(pr_gstin, '') AS pr_gstin, coalesce(b2_gstin, '') AS b2_gstin, coalesce(pr_inv, '') AS pr_inv,
       coalesce(b2_inv, '') AS invoice_no_2b, coalesce(strftime(pr_date, '%Y-%m-%d'), '') AS pr_date,
       coalesce(strftime(b2_date, '%Y-%m-%d'), '') AS invoice_date_2b,
       pr_cgst, b2_cgst, pr_sgst, b2_sgst, pr_igst, b2_igst
FROM pairs WHERE mapping = 'Almost Matched'""")
def _f7(spark, sf):
    out = RV.review_candidates(get_run(spark, sf).pairs)
    return out.select(F.col("id").cast("bigint"), *[c for c in out.columns if c != "id"])


@register("apply_review", O.with_stage("pairs") + _REVIEWED + """
SELECT CAST(pair_id AS BIGINT) AS pair_id, gst_key, inv_key, mapping, remarks, reason FROM reviewed""")
def _j9(spark, sf):
    return get_run(spark, sf).reviewed.select(F.col("pair_id").cast("bigint"), "gst_key", "inv_key", "mapping",
                                              "remarks", "reason")


@register("pending_state", O.with_stage("pairs") + """
SELECT CAST(pair_id AS BIGINT) AS pair_id, gst_key, inv_key, sheet, mapping, pr_cgst, b2_cgst FROM pairs""")
def _s11(spark, sf):
    from ..sources.sinks import load_pending_state, save_pending_state

    run = get_run(spark, sf)
    save_pending_state(run)
    pairs = load_pending_state(spark, run.run_id)["pair"]
    return pairs.select(F.col("pair_id").cast("bigint"), "gst_key", "inv_key", "sheet", "mapping",
                        _money("pr_cgst"), _money("b2_cgst"))


@register("not_matched_report", O.with_stage("pairs") + _REVIEWED + """
SELECT gst_key, inv_key, invoice_type, mapping, remarks, reason, vendor_name,
       coalesce(b2_filing_period, '') AS filing_period, coalesce(pr_gstin, '') AS pr_gstin,
       coalesce(b2_gstin, '') AS b2_gstin, coalesce(pr_inv, '') AS pr_inv, coalesce(b2_inv, '') AS b2_inv,
       coalesce(strftime(pr_date, '%Y-%m-%d'), '') AS pr_date, coalesce(strftime(b2_date, '%Y-%m-%d'), '') AS b2_date,
       pr_cgst, b2_cgst, pr_sgst, b2_sgst, pr_igst, b2_igst
FROM reviewed WHERE mapping = 'Not Matched'""")
def _f8(spark, sf):
    return P.recon_projection(RV.not_matched_report(get_run(spark, sf).reviewed))


_RUN_LOG_SQL = O.with_stage("pairs") + _REVIEWED + """
, runs AS (SELECT 'reviewed' AS owner, 'completed' AS status, * FROM reviewed UNION ALL SELECT 'pending', 'review needed', * FROM pairs)
SELECT owner, 'Recon_' || owner AS report_name,
  CAST(coalesce(sum(coalesce(pr_cgst, 0) + coalesce(pr_sgst, 0) + coalesce(pr_igst, 0)) FILTER (WHERE mapping = 'Matched'), 0) AS DECIMAL(38,2)) AS matched_value,
  CAST(coalesce(sum(coalesce(pr_cgst, 0) + coalesce(pr_sgst, 0) + coalesce(pr_igst, 0)) FILTER (WHERE mapping <> 'Matched'), 0) AS DECIMAL(38,2)) AS mismatched_value,
  count(*) AS row_count, status, TRUE AS has_time, count(*) AS file_rows
FROM runs GROUP BY owner, status"""


@register("run_log", _RUN_LOG_SQL)
def _k1(spark, sf):
    """Two runs published and logged, one of them twice, a third logged and deleted: the log has the first two, each
    with its time and with the file that holds its rows."""
    from ..sources import sinks as SK

    run = get_run(spark, sf)
    logged = {"pending": (run.pairs, "review needed"), "reviewed": (run.reviewed, "completed")}
    ids = {owner: f"{run.run_id}/{spark.sparkContext.applicationId}/{owner}" for owner in (*logged, "gone")}
    for owner in ("pending", "reviewed", "pending"):
        pairs, status = logged[owner]
        version = SK.write_report(spark, {"reconciliation": P.recon_projection(pairs)}, ids[owner])
        SK.log_run(RV.run_log(pairs, ids[owner], owner, f"Recon_{owner}", version, status))
    SK.log_run(RV.run_log(run.pairs, ids["gone"], "gone", "Recon_gone", "", "failed"))
    SK.delete_run(spark, ids["gone"])
    log = SK.run_log(spark).where(F.col("run_id").isin(*ids.values()))
    files = [SK.published(spark, ids[owner], SK.REPORT)["reconciliation"].agg(F.count(F.lit(1)).alias("file_rows"))
             .withColumn("run_id", F.lit(ids[owner])) for owner in logged]
    versions = SK.manifest(spark).select("run_id", F.col("version").alias("file")).distinct()
    return (log.join(versions, ["run_id", "file"]).join(files[0].unionByName(files[1]), "run_id")
            .select("owner", "report_name", _money("matched_value"), _money("mismatched_value"), "row_count", "status",
                    F.col("generated_at").isNotNull().alias("has_time"), "file_rows"))


@register("history_topk", """
WITH r AS (
  SELECT o_custkey % 20 AS owner, o_orderkey AS report_id,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'Reconciliation_Report_' || strftime(o_orderdate, '%Y%m%d') || '.xlsx'
              ELSE 'Recon_' || CAST(o_custkey % 20 AS VARCHAR) || '_' || strftime(o_orderdate, '%Y%m%d') || '_'
                   || CAST(o_orderkey AS VARCHAR) || '.xlsx' END AS name,
         o_orderdate AS created, o_orderstatus = 'P' AS trashed
  FROM orders
), l AS (
  SELECT *, row_number() OVER (PARTITION BY owner ORDER BY created DESC, report_id DESC) AS rank
  FROM r WHERE contains(name, 'Recon_' || CAST(owner AS VARCHAR) || '_') AND NOT trashed
)
SELECT owner, CAST(rank AS BIGINT) AS rank, report_id, regexp_replace(name, '\\.xlsx$', '') AS report_name,
       strftime(created, '%d-%b-%Y %H:%M') AS generated_at
FROM l WHERE rank <= 50""")
def _t1(spark, sf):
    orders = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                                              "o_orderpriority"])
    out = RV.history_topk(RV.derived_reports(orders))
    return out.withColumn("rank", F.col("rank").cast("bigint"))


# =================================================================== dormant
@register("lookup_reconcile", O.with_stage("lines") + f"""
, c0 AS (
  SELECT gst_key, inv_key, inv_date, cgst, sgst, igst,
         row_number() OVER (PARTITION BY gst_key, inv_key ORDER BY CASE WHEN sheet = 'B2B' THEN 0 ELSE 1 END, row_no) AS rn,
         count(*) OVER (PARTITION BY gst_key, inv_key) AS n_cand
  FROM b2_lines WHERE {_B2_PART} AND gst_key <> '' AND inv_key <> ''
), cand AS (SELECT * FROM c0 WHERE rn = 1),
j AS (
  SELECT p.row_no, p.gst_key, p.inv_key, c.n_cand,
    concat_ws('; ',
      CASE WHEN NOT (p.inv_date IS NOT DISTINCT FROM c.inv_date) THEN 'Invoice Date' END,
      CASE WHEN abs(round_even(p.cgst, 0)) <> abs(round_even(c.cgst, 0)) THEN 'CGST' END,
      CASE WHEN abs(round_even(p.sgst, 0)) <> abs(round_even(c.sgst, 0)) THEN 'SGST' END,
      CASE WHEN abs(round_even(p.igst, 0)) <> abs(round_even(c.igst, 0)) THEN 'IGST' END) AS problems,
    CASE WHEN c.n_cand > 1 THEN 'multiple matches in 2B (' || CAST(c.n_cand AS VARCHAR) || ')' END AS multi
  FROM pr_lines p LEFT JOIN cand c ON p.gst_key = c.gst_key AND p.inv_key = c.inv_key
  WHERE NOT p.is_import
)
SELECT CAST(row_no AS BIGINT) AS row_no, gst_key, inv_key,
  CASE WHEN gst_key = '' OR inv_key = '' THEN 'Not Matched' WHEN n_cand IS NULL THEN 'Not Matched'
       WHEN problems <> '' THEN 'Almost Matched' ELSE 'Matched' END AS mapping,
  CASE WHEN gst_key = '' OR inv_key = '' THEN 'no GSTIN+Invoice in PR' WHEN n_cand IS NULL THEN 'no GSTIN+Invoice match'
       WHEN problems <> '' THEN 'mismatch'
       ELSE 'All fields matched' || coalesce(' (' || multi || ')', '') END AS remarks,
  CASE WHEN gst_key = '' OR inv_key = '' THEN 'missing GSTIN/Invoice in PR' WHEN n_cand IS NULL THEN ''
       WHEN problems <> '' THEN concat_ws('; ', problems, multi) ELSE '' END AS reason
FROM j""")
def _j8(spark, sf):
    run = get_run(spark, sf)
    out = DM.lookup_reconcile(run.pr_raw, L.matchable_2b(run.b2_lines))
    return out.withColumn("row_no", F.col("row_no").cast("bigint"))


_G2_SQL = f"""
, g2 AS (
  SELECT sheet, row_no, gst_key, inv_key,
         CASE WHEN sheet = 'B2B-CDNR' THEN (CASE WHEN regexp_matches(lower({O.nt('note_type')}), '\\bdebit\\b|\\bdn\\b|\\bdr\\b')
                                                THEN 'debit' ELSE 'credit' END) ELSE 'invoice' END AS note_class,
         {O.parse_amount(O.nt('cgst_raw'))} AS c_abs, {O.parse_amount(O.nt('igst_raw'))} AS i_abs
  FROM b2_lines WHERE sheet IN ('B2B', 'B2B-CDNR')
)"""


@register("classify_notes", O.with_stage("lines") + _G2_SQL + """
SELECT sheet, CAST(row_no AS BIGINT) AS row_no, note_class,
       CASE WHEN note_class = 'credit' THEN -abs(c_abs) ELSE abs(c_abs) END AS cgst,
       CASE WHEN note_class = 'credit' THEN -abs(i_abs) ELSE abs(i_abs) END AS igst
FROM g2""")
def _g2(spark, sf):
    out = DM.classify_notes(get_run(spark, sf).b2_lines)
    return out.select("sheet", F.col("row_no").cast("bigint"), "note_class", _money("cgst"), _money("igst"))


@register("note_type_by_key", O.with_stage("cons") + _G2_SQL + """
, f AS (
  SELECT gst_key, inv_key, arg_min(note_class, row_no) FILTER (WHERE note_class IS NOT NULL) AS note_class
  FROM g2 WHERE sheet = 'B2B-CDNR' GROUP BY gst_key, inv_key
)
SELECT c.gst_key, c.inv_key, coalesce(f.note_class, '') AS note_class
FROM b2_cons c LEFT JOIN f ON c.gst_key = f.gst_key AND c.inv_key = f.inv_key WHERE c.sheet = 'B2B-CDNR'""")
def _g3(spark, sf):
    run = get_run(spark, sf)
    return DM.note_type_by_key(DM.classify_notes(run.b2_lines), run.b2_cons)


# =================================================================== ingest
from ..sources import ingest as IG  # noqa: E402

_uploads = session_memo("uploads", IG.uploaded_files)

_HDR_VALUES = ", ".join("(" + str(i + 1) + ", [" + ", ".join("NULL" if v is None else "'" + v + "'" for v in row) + "]::VARCHAR[])"
                        for i, row in enumerate(IG.PORTAL_HEADER))
_FILES_SQL = O.with_stage("landing") + f"""
, f0 AS (
  SELECT CAST(ok % 5 AS INTEGER) AS file_seq, (ok % 5 IN (0, 2) AND sheet = 'B2B' AND ln % 2 = 0) AS again,
         CASE WHEN again THEN 3 WHEN sheet = 'B2B' THEN 0 WHEN sheet = 'B2B-CDNR' THEN 1 ELSE 2 END AS sheet_seq,
         CASE WHEN again THEN ' ' || sheet WHEN ok % 5 = 3 THEN sheet || ' ' ELSE sheet END AS name, {O.LINE_ORDER},
         [{", ".join(f"CASE WHEN blank THEN NULL ELSE {c} END" for c in O.B2_COLS)}, CAST(ln AS VARCHAR),
          CAST(ok AS VARCHAR) || CASE WHEN sheet = 'IMPG' THEN 'D' ELSE '' END] AS whole
  FROM b2_land0
), f1 AS (
  SELECT file_seq, sheet_seq, name AS sheet,
         row_number() OVER (PARTITION BY file_seq, sheet_seq, name ORDER BY {O.LINE_ORDER}) + 6 AS row_no,
         CASE WHEN ok % 10 = 0 THEN whole[1:{len(O.B2_COLS) - 2}] ELSE whole END AS cells FROM f0
), hdr AS (SELECT * FROM (VALUES {_HDR_VALUES}) t(row_no, cells)),
files AS (
  SELECT * FROM f1
  UNION ALL
  SELECT d.file_seq, d.sheet_seq, d.sheet, h.row_no, h.cells
  FROM (SELECT DISTINCT file_seq, sheet_seq, sheet FROM f1) d CROSS JOIN hdr h
), frows AS (SELECT * REPLACE (trim(sheet) AS sheet) FROM files WHERE file_seq <> 4),
of_sheet AS (SELECT sheet, file_seq, sheet_seq, max(row_no) AS n, max(len(cells)) AS w FROM frows GROUP BY ALL),
firsts AS (
  SELECT sheet, min((file_seq, sheet_seq)) AS f, greatest(arg_min(w, (file_seq, sheet_seq)), coalesce(max(w) FILTER (WHERE n > 6), 0)) AS width
  FROM of_sheet GROUP BY sheet
), consolidated AS (
  SELECT r.sheet, r.file_seq, r.sheet_seq, CAST(r.row_no AS BIGINT) AS row_no,
         list_transform(range(f.width), lambda i: r.cells[i + 1]) AS cells
  FROM frows r JOIN firsts f ON r.sheet = f.sheet WHERE (r.file_seq, r.sheet_seq) = f.f OR r.row_no > 6
)"""


@register("consolidate_files", _FILES_SQL + """
SELECT sheet, file_seq, CAST(sheet_seq AS INTEGER) AS sheet_seq, row_no, CAST(len(cells) AS INTEGER) AS width,
       array_to_string(list_transform(cells, lambda x: coalesce(x, '~')), '|') AS cells FROM consolidated""")
def _s6(spark, sf):
    out = IG.consolidate_files(_uploads(spark, sf))
    return out.select("sheet", F.col("file_seq").cast("int"), F.col("sheet_seq").cast("int"), F.col("row_no").cast("bigint"),
                      F.size("cells").alias("width"), F.array_join("cells", "|", "~").alias("cells"))


@register("union_files", _FILES_SQL + """
SELECT sheet, count(*) AS n_rows, count(DISTINCT file_seq) AS n_files, sum(len(list_filter(cells, lambda x: x IS NOT NULL)))::BIGINT AS n_cells
FROM consolidated GROUP BY sheet""")
def _u2(spark, sf):
    out = IG.consolidate_files(_uploads(spark, sf))
    return out.groupBy("sheet").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("file_seq").alias("n_files"),
                                    F.sum(F.size(F.filter("cells", lambda x: x.isNotNull())).cast("bigint")).alias("n_cells"))


@register("numeric_if_all", _FILES_SQL + f"""
, long AS (SELECT sheet, unnest(generate_series(1, len(cells))) AS i, unnest(cells) AS value FROM consolidated),
t AS (SELECT sheet, i, coalesce(bool_and(regexp_full_match(value, '{N.NUMBER_PATTERN.strip("^$")}')), TRUE) AS all_numeric,
             count(value) AS n_values, min(TRY_CAST(value AS DOUBLE)) AS least, max(TRY_CAST(value AS DOUBLE)) AS most
      FROM long GROUP BY sheet, i)
SELECT sheet, CAST(i - 1 AS INTEGER) AS pos, all_numeric, n_values, CASE WHEN all_numeric THEN least END AS least,
       CASE WHEN all_numeric THEN most END AS most FROM t""")
def _s7(spark, sf):
    consolidated = materialize(IG.consolidate_files(_uploads(spark, sf)), "consolidated")
    return IG.typed_profile(IG.write_consolidated(consolidated, IG.numeric_if_all(consolidated)))


@register("validate_manifest", """
WITH m AS (
  SELECT c_custkey AS run_id,
         CASE WHEN c_custkey % 7 = 0 THEN ['B2B-CDNR', 'IMPG'] ELSE ['B2B', 'B2B-CDNR', 'IMPG'] END AS s2b
  FROM customer
), m2 AS (
  SELECT run_id, s2b, CASE WHEN run_id % 11 = 0 THEN ['B2B', 'B2B-CDNR'] WHEN run_id % 13 = 0 THEN s2b
                           ELSE ['Sheet1'] END AS spr
  FROM m
)
SELECT run_id, array_to_string(s2b, '|') AS sheets_2b, array_to_string(spr, '|') AS sheets_pr,
  CASE WHEN NOT list_contains(s2b, 'B2B') THEN 'missing B2B'
       WHEN list_contains(spr, 'B2B') AND list_contains(spr, 'B2B-CDNR') THEN 'swapped'
       WHEN s2b = spr THEN 'duplicate' ELSE 'ok' END AS verdict
FROM m2""")
def _s8(spark, sf):
    return IG.validate_manifest(IG.derived_manifests(spark, sf))


@register("row_counts", O.with_stage("landing") + """
SELECT 'pr' AS source, count(*) AS rows FROM pr_land
UNION ALL SELECT 'b2b', count(*) FROM b2_land WHERE sheet = 'B2B'
UNION ALL SELECT 'cdnr', count(*) FROM b2_land WHERE sheet = 'B2B-CDNR'""")
def _s9(spark, sf):
    run = get_run(spark, sf)
    return IG.row_counts(run.pr_landing, _uploads(spark, sf))


def _row_text_sql(columns: dict[str, str]) -> str:
    """SQL: a row as text; money at two decimals, whatever scale the column has."""
    return " || '|' || ".join(f"coalesce(CAST({f'CAST({c} AS DECIMAL(38,2))' if t == 'money' else c} AS VARCHAR), '~')" for c, t in columns.items())


_RECON_COLUMNS = {c: "text" for c in ("gst_key", "inv_key", "invoice_type", "mapping", "remarks", "reason", "vendor_name", "filing_period",
                                      "pr_gstin", "b2_gstin", "pr_inv", "b2_inv", "pr_date", "b2_date")}
_RECON_COLUMNS |= {f"{s}_{t}": "money" for t in ("cgst", "sgst", "igst") for s in ("pr", "b2")}
_TAXES = {"taxable_value": "money", "cgst": "money", "sgst": "money", "igst": "money"}
_FOUND = {"mapping": "text", "remarks": "text", "reason": "text"}
_B2_SHEET = {b: "text" for _a, b in CM.B2_SHEET_COLUMNS}
#: Report table -> its columns, as the contents are compared.
_REPORT_COLUMNS = {
    "dashboard": {"status": "text", "pos": "text", **{f"{s}_{t}": "money" for s in ("pr", "b2") for t in ("cgst", "sgst", "igst", "total")}},
    "itc": {"code": "text", "pos": "text", "details": "text", "integrated": "money", "central": "money", "state": "money", "cess": "money"},
    "reconciliation": _RECON_COLUMNS,
    "pr_comments": {"row_no": "text", **{b: _TAXES.get(b, "text") for _a, b in CM.PR_SHEET_COLUMNS}, **_FOUND, "row_number_in_2b": "text"},
    "b2b_comments": {"row_no": "text", **_B2_SHEET, "taxable_value": "text", "cgst": "text", "sgst": "text", "igst": "text", **_FOUND,
                     "row_number_in_pr": "text", "tax_period": "text"},
    "cdnr_comments": {"row_no": "text", **_B2_SHEET, **_TAXES, **_FOUND, "row_number_in_pr": "text", "tax_period": "text"},
}


def _report_sql() -> str:
    """The contents of all six tables over the reviewed pairs, each from the SQL of its own query."""
    def body(sql: str) -> str:  # after the common stages
        return sql[len(O.with_stage("pairs")):].strip().lstrip(",").strip()

    def sheet(where: str, amounts: dict[str, str]) -> str:
        cols = ", ".join(f"{a} AS {b}" for a, b in CM.B2_SHEET_COLUMNS if b not in ("filing_date", "filing_period"))
        return (f"SELECT row_no, {cols}, {', '.join(f'{a} AS {b}' for b, a in amounts.items())}, mapping, remarks, reason, row_number_in_pr, "
                f"CASE WHEN filing_date IS NOT NULL THEN strftime(filing_date, '%d-%m-%Y') ELSE filing_date_raw END AS filing_date, "
                f"{_n13_month('filing_period')} AS filing_period, {_n13_month('tax_period')} AS tax_period FROM b2c WHERE {where}")

    parts = {"dashboard": ORACLE["dashboard"], "itc": ORACLE["itc_table"], "reconciliation": O.with_stage("pairs") + _RECON_SQL}
    selects, ctes = {}, []
    for name, sql in parts.items():
        *own, last = body(sql).rsplit("\n)\nSELECT ", 1) if name == "dashboard" else [body(sql)]
        if name == "dashboard":
            ctes.append(own[0] + "\n)")
            selects[name] = "SELECT " + last
        elif name == "itc":
            flags, rest = sql[len(O.with_stage("pairs")):].strip().lstrip(",").split("\n)\n", 1)
            totals, rows = rest.strip().lstrip(",").split(" FROM flags)\n", 1)
            ctes += [flags + "\n)", totals + " FROM flags)"]
            selects[name] = rows
        else:
            selects[name] = own[0] if own else last
    ctes.append(_COMMENT_CTES.strip().lstrip(","))
    amounts = {"taxable_value": "taxable", "cgst": "cgst", "sgst": "sgst", "igst": "igst"}
    selects["pr_comments"] = ORACLE["comments_projection"].rsplit("\n)", 1)[1]
    selects["b2b_comments"] = sheet("sheet = 'B2B'", {b: f"{a}_raw" for b, a in amounts.items()})
    selects["cdnr_comments"] = sheet("sheet = 'B2B-CDNR'", amounts)
    out = [f"SELECT '{name}' AS report_table, {_row_text_sql(cols)} AS row_text FROM (\n{selects[name]}\n)" for name, cols in _REPORT_COLUMNS.items()]
    # the pairs and their statuses are those after the review
    after = ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(out)
    after = after.replace("FROM pairs", "FROM reviewed").replace("JOIN status s", "JOIN status_after s").replace("FROM status s", "FROM status_after s")
    return O.with_stage("pairs") + _REVIEWED + """
, status_after AS (
  SELECT gst_key, inv_key, arg_max(mapping, pair_id) AS mapping, arg_max(remarks, pair_id) AS remarks, arg_max(reason, pair_id) AS reason
  FROM reviewed GROUP BY gst_key, inv_key
),
""" + after


@register("write_report", _report_sql())
def _s10(spark, sf):
    """The six tables published for the run, found again by its id, their rows as text."""
    from ..sources.sinks import REPORT, published, write_report

    run = get_run(spark, sf)
    rev = run.reviewed
    st = P.status_lookup(rev)
    info = CM.b2_key_info(run.pr_raw, st)  # written once for both sheets
    write_report(spark, {
        "dashboard": DB.dashboard(rev),
        "itc": ITC.itc_table(run.b2_lines, st, run.return_month),
        "reconciliation": P.recon_projection(rev),
        "pr_comments": CM.pr_comments_sheet(CM.pr_comments(run.pr_raw, run.b2_lines, st)),
        "b2b_comments": CM.b2_comments_sheet(CM.b2_comments(run.b2b_raw, run.pr_raw, st, info=info), signed=False),
        "cdnr_comments": CM.b2_comments_sheet(CM.b2_comments(run.cdnr_raw, run.pr_raw, st, info=info), signed=True),
    }, run.run_id)
    parts = []
    for name, df in published(spark, run.run_id, REPORT).items():
        cells = [F.coalesce((F.col(c).cast(MONEY) if t == "money" else F.col(c)).cast("string"), F.lit("~")) for c, t in _REPORT_COLUMNS[name].items()]
        parts.append(df.select(F.lit(name).alias("report_table"), F.concat_ws("|", *cells).alias("row_text")))
    return reduce(DataFrame.unionByName, parts)


# =================================================================== schema discovery
from ..operators import schema_match as SM  # noqa: E402
from ..sources import catalog as CT  # noqa: E402
from . import oracle_runs as OR  # noqa: E402
from . import oracle_schema as OS  # noqa: E402


def _cleaned(spark, sf):
    return SM.clean_headers(CT.catalog(spark, sf))


_cells = session_memo("cells", CT.cells)


def _values(spark, sf):
    return SM.present_values(_cells(spark, sf), _cleaned(spark, sf))


def _score_sql(alias: str, list_expr: str, norm: str) -> str:
    return (f"5 * (EXISTS (SELECT 1 FROM dict d WHERE d.list_name = {list_expr} AND d.t = {norm}))::INT"
            f" + 3 * (EXISTS (SELECT 1 FROM dict d WHERE d.list_name = {list_expr} AND contains({norm}, d.t)))::INT"
            f" + 2 * (EXISTS (SELECT 1 FROM dict d WHERE d.list_name = {list_expr} AND starts_with({norm}, d.t)))::INT"
            f" + contains({norm}, 'inv')::INT + contains({norm}, 'gst')::INT")


@register("clean_headers", OS.with_schema() + """
SELECT table_id, CAST(pos AS INTEGER) AS pos, col AS column_name, soft, norm FROM cleaned""")
def _c1(spark, sf):
    return _cleaned(spark, sf).select("table_id", F.col("pos").cast("int"), F.col("column").alias("column_name"),
                                      "soft", "norm")


@register("match_columns", OS.with_schema() + """
SELECT table_id, kind, role, col AS column_name, CAST(score AS INTEGER) AS score FROM c2""")
def _c2(spark, sf):
    out = SM.match_columns(_cleaned(spark, sf))
    return out.select("table_id", "kind", "role", F.col("column").alias("column_name"),
                      F.col("score").cast("int"))


_ORDERED = ", ".join(f"('{role}', {k}, '{lst}')" for role, lists in SM.FIRST_POOLS.items() for k, lst in enumerate(lists))


@register("first_pool", OS.with_schema() + f"""
, p3 AS (SELECT * FROM (VALUES {_ORDERED}) v(role, k, list_name)),
s3 AS (SELECT c.table_id, c.pos, c.col, p.role, p.k, {_score_sql('d', 'p.list_name', 'c.norm')} AS score
       FROM cleaned c CROSS JOIN p3 p WHERE c.kind = '2B'),
b3 AS (SELECT table_id, role, col FROM (
         SELECT *, row_number() OVER (PARTITION BY table_id, role ORDER BY k, score DESC, pos) AS rn FROM s3 WHERE score > 0)
       WHERE rn = 1),
r3 AS (SELECT DISTINCT c.table_id, p.role FROM cleaned c CROSS JOIN p3 p WHERE c.kind = '2B')
SELECT r3.table_id, r3.role, coalesce(b3.col, rx.col) AS column_name
FROM r3 LEFT JOIN b3 ON b3.table_id = r3.table_id AND b3.role = r3.role
LEFT JOIN rx ON rx.table_id = r3.table_id AND rx.pattern = r3.role""")
def _c3(spark, sf):
    return SM.first_pool(_cleaned(spark, sf)).withColumnRenamed("column", "column_name")


@register("match_by_regex", OS.with_schema() + """
SELECT table_id, pattern, col AS column_name FROM rx""")
def _c4(spark, sf):
    return SM.match_by_regex(_cleaned(spark, sf)).withColumnRenamed("column", "column_name")


@register("match_by_keyword", OS.with_schema() + """
, k AS (SELECT *, lower(trim(col)) AS low, regexp_replace(lower(trim(col)), '[^a-z0-9]', '', 'g') AS nn
        FROM cleaned WHERE kind = '2B')
SELECT table_id,
  coalesce(arg_min(col, pos) FILTER (WHERE contains(low, 'itc availability')),
           arg_min(col, pos) FILTER (WHERE contains(low, 'itc available'))) AS itc_column,
  arg_min(col, pos) FILTER (WHERE contains(low, 'reverse charge') OR contains(low, 'attract reverse charge'))
    AS reverse_charge_column,
  coalesce(arg_min(col, pos) FILTER (WHERE contains(nn, 'date') AND (contains(nn, 'filing') OR contains(nn, 'gstr1')
                                            OR contains(nn, 'iff')) AND NOT contains(nn, 'period')),
           arg_min(col, pos) FILTER (WHERE contains(low, 'filing') AND contains(low, 'date') AND NOT contains(low, 'period')))
    AS filing_date_column,
  arg_min(col, pos) FILTER (WHERE contains(low, 'filing') AND contains(low, 'date') AND NOT contains(low, 'period'))
    AS prior_period_filing_column
FROM k GROUP BY table_id""")
def _c5(spark, sf):
    cleaned = _cleaned(spark, sf)
    tables = cleaned.where(F.col("kind") == "2B").select("table_id").distinct()
    return tables.join(SM.match_by_keyword(cleaned), "table_id", "left")


@register("match_import_type", OS.with_schema() + f"""
, sc6 AS (SELECT c.table_id, c.pos, c.col, {_score_sql('d', "'import_type'", 'c.norm')} AS score FROM cleaned c),
b6 AS (SELECT table_id, col FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY score DESC, pos) AS rn
                                 FROM sc6) WHERE rn = 1 AND score > 0),
fb AS (SELECT table_id, arg_min(col, pos) AS col FROM cleaned
       WHERE contains(lower(col), 'type') AND (contains(lower(col), 'purchase') OR contains(lower(col), 'trans')
                                               OR contains(lower(col), 'nature')) GROUP BY table_id)
SELECT t.table_id, coalesce(b6.col, fb.col) AS type_column
FROM (SELECT DISTINCT table_id FROM cleaned) t LEFT JOIN b6 ON b6.table_id = t.table_id
LEFT JOIN fb ON fb.table_id = t.table_id""")
def _c6(spark, sf):
    return SM.match_import_type(_cleaned(spark, sf))


def _c7_sql() -> str:
    parts = []
    for kind, suffix, lists, role, bonus in (("PR", "pr", ["vendor_name_pr"], "vendor_name", False),
                                             ("2B", "2b", ["trade_name_2b", "vendor_name_pr"], "vendor_name", False),
                                             ("2B", "2b", ["gstr1_status_2b"], "filing_status", True)):
        n = f"regexp_replace(lower(trim(c.col || '_{suffix}')), '[^a-z0-9]', '', 'g')"
        lst = ", ".join(f"'{x}'" for x in lists)
        s = (f"4 * (EXISTS (SELECT 1 FROM dict d WHERE d.list_name IN ({lst}) AND d.t || '{suffix}' = {n}))::INT"
             f" + 2 * (EXISTS (SELECT 1 FROM dict d WHERE d.list_name IN ({lst}) AND contains({n}, d.t || '{suffix}')))::INT"
             f" + contains({n}, 'name')::INT")
        s += (f" + 3 * contains({n}, 'period')::INT" if bonus else
              f" - 10 * (contains({n}, 'date') OR contains({n}, 'period') OR contains({n}, 'month'))::INT")
        parts.append(f"SELECT c.table_id, c.pos, c.col, '{role}' AS role, {s} AS score FROM cleaned c WHERE c.kind = '{kind}'")
    return OS.with_schema() + f"""
, s7 AS ({" UNION ALL ".join(parts)})
SELECT table_id, role, col AS column_name, CAST(score AS INTEGER) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY table_id, role ORDER BY score DESC, pos) AS rn FROM s7)
WHERE rn = 1 AND score > 0"""


@register("match_name_column", _c7_sql())
def _c7(spark, sf):
    out = SM.match_name_column(_cleaned(spark, sf))
    return out.select("table_id", "role", F.col("column").alias("column_name"), F.col("score").cast("int"))


@register("profile_gstin", OS.with_schema() + """
SELECT table_id, col AS column_name, CAST(score AS DOUBLE) AS score FROM gv""")
def _c8(spark, sf):
    cleaned = _cleaned(spark, sf)
    out = SM.profile_gstin(cleaned.where(F.col("kind") == "PR"), _values(spark, sf))
    return out.select("table_id", F.col("column").alias("column_name"), F.col("score").cast("double"))


@register("profile_invoice", OS.with_schema() + """
SELECT table_id, col AS column_name, CAST(score AS DOUBLE) AS score FROM iv""")
def _c9(spark, sf):
    cleaned = _cleaned(spark, sf)
    out = SM.profile_invoice(cleaned.where(F.col("kind") == "PR"), _values(spark, sf))
    return out.select("table_id", F.col("column").alias("column_name"), F.col("score").cast("double"))


@register("resolve_roles", OS.with_schema() + """
SELECT table_id, kind, role, col AS column_name FROM resolved""")
def _c10(spark, sf):
    out = SM.resolve_roles(_cleaned(spark, sf), _values(spark, sf))
    return out.withColumnRenamed("column", "column_name")


_NOTE_TERMS = ", ".join(f"('{t}', {i + 1})" for i, t in enumerate(SM.ROLE_LISTS["note_no_2b"]))


@register("best_note_column", OS.with_schema() + f"""
, fill AS (SELECT table_id, pos, avg(CAST(({O.trim_ws('value')} <> '') AS INTEGER)::DOUBLE) AS fill
           FROM cells GROUP BY table_id, pos),
cols AS (SELECT c.table_id, c.pos, c.col, coalesce(f.fill, 0.0) AS fill
         FROM cleaned c LEFT JOIN fill f ON f.table_id = c.table_id AND f.pos = c.pos),
prim AS (SELECT table_id, col AS primary_column FROM resolved WHERE role = 'note_no'),
pf AS (SELECT p.table_id, p.primary_column, c.fill AS pfill FROM prim p
       LEFT JOIN cols c ON c.table_id = p.table_id AND c.col = p.primary_column),
nc AS (SELECT * FROM (VALUES {_NOTE_TERMS}) v(term, rk)),
ex AS (SELECT table_id, col AS fullest FROM (
         SELECT c.*, nc.rk, row_number() OVER (PARTITION BY c.table_id ORDER BY c.fill DESC, nc.rk) AS rn
         FROM cols c JOIN nc ON nc.term = c.col WHERE c.fill > 0) WHERE rn = 1)
SELECT pf.table_id, pf.primary_column,
       CASE WHEN pf.primary_column IS NULL OR coalesce(pf.pfill, 0.0) < {SM.NOTE_FILL_MIN}
            THEN coalesce(ex.fullest, pf.primary_column) ELSE pf.primary_column END AS note_column
FROM pf LEFT JOIN ex ON ex.table_id = pf.table_id""")
def _c11(spark, sf):
    cleaned = _cleaned(spark, sf)
    cells = _cells(spark, sf)
    resolved = SM.resolve_roles(cleaned, _values(spark, sf))
    out = SM.best_note_column(cleaned, cells, resolved)
    return out.withColumnRenamed("primary", "primary_column")


_POOLS = ", ".join(f"('{kind}', {k}, '{lst}')" for kind, lsts in SM.NUMERIC_POOLS.items() for k, lst in enumerate(lsts))


@register("numeric_roles", OS.with_schema() + f"""
, pools AS (SELECT * FROM (VALUES {_POOLS}) v(kind, k, list_name)),
psc AS (SELECT c.table_id, c.pos, c.col, p.k, {_score_sql('d', 'p.list_name', 'c.norm')} AS score
        FROM cleaned c JOIN pools p ON p.kind = c.kind),
pb AS (SELECT table_id, k, col FROM (SELECT *, row_number() OVER (PARTITION BY table_id, k ORDER BY score DESC, pos) AS rn
                                    FROM psc) WHERE rn = 1 AND score > 0),
tx AS (SELECT table_id, CASE role WHEN 'cgst' THEN 4 WHEN 'sgst' THEN 5 ELSE 6 END AS k, col FROM resolved
       WHERE role IN ('cgst', 'sgst', 'igst') AND col IS NOT NULL),
al AS (SELECT table_id, col, min(k) AS k FROM (SELECT table_id, k, col FROM pb UNION ALL SELECT table_id, k, col FROM tx)
       GROUP BY table_id, col)
SELECT table_id, string_agg(col, ' | ' ORDER BY k) AS numeric_columns FROM al GROUP BY table_id""")
def _c12(spark, sf):
    cleaned = _cleaned(spark, sf)
    resolved = SM.resolve_roles(cleaned, _values(spark, sf))
    return SM.numeric_roles(cleaned, resolved)


@register("role_dictionary", OS.with_schema() + """
SELECT d.list_name, CAST(d.pos AS INTEGER) AS pos, d.term, d.t AS norm_term, CAST(coalesce(n.n, 0) AS BIGINT) AS n_columns
FROM dict d LEFT JOIN (SELECT norm, count(*) AS n FROM cleaned GROUP BY norm) n ON n.norm = d.t
WHERE d.list_name NOT IN ('pr_invoice_pen', 'import_type')""")
def _c13(spark, sf):
    return SM.role_dictionary_usage(_cleaned(spark, sf))


@register("first_n_per_column", OS.with_schema() + """
SELECT table_id, CAST(pos AS INTEGER) AS pos, CAST(row_no AS BIGINT) AS row_no, value FROM sample""")
def _w3(spark, sf):
    out = SM.first_n_per_column(_cells(spark, sf))
    return out.select("table_id", F.col("pos").cast("int"), F.col("row_no").cast("bigint"), "value")


# =================================================================== any number of runs at once (C10 by maps, S1-J3 by run)
def _uploads_of(spark, sf):
    from .given import Uploads

    # the rows are read from written tables as they are
    catalog, rows, choices = CT.run_uploads(spark, sf)
    return Uploads(materialize(catalog, "runs-catalog"), rows, materialize(choices, "runs-choices"))


_many = session_memo("runs", _uploads_of)


@register("land_uploads", OR.land_sql())
def _land_uploads(spark, sf):
    """The cells of all runs' tables under the landing columns, by the column maps found for each table."""
    up = _many(spark, sf)
    pr = up.pr_lines.select(F.col("run_id").cast("bigint"), F.lit("PR").alias("sheet"), "row_no", *[F.col(c) for c in OR.SHARED],
                            "invoice_value_raw", "cess_raw", F.col("vendor_name").alias("name"), F.col("doc_type").alias("type"))
    b2 = up.b2_lines.select(F.col("run_id").cast("bigint"), "sheet", "row_no", *[F.col(c) for c in OR.SHARED], "invoice_value_raw", "cess_raw",
                            F.col("trade_name").alias("name"), F.col("inv_type").alias("type"))
    return pr.unionByName(b2)


@register("reconcile_uploads", OR.pairs_sql())
def _reconcile_uploads(spark, sf):
    """All runs reconciled in one plan: consolidated, joined, rescued, classified and named inside each run."""
    return _many(spark, sf).pairs.select(F.col("run_id").cast("bigint"), "gst_key", "inv_key", "sheet", "mapping", "remarks", "reason",
                                         "vendor_name", "invoice_type", _money("pr_cgst"), _money("b2_cgst"), _money("b2_cess"))
