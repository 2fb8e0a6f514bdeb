"""Line-level jobs: typing the landing text, filters and sign rules.

All of these are narrow projections / filters over the landing tables: no
shuffle, one whole-stage-codegen span per scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..sources.derived import B2_COLUMNS, SHEET_B2B, SHEET_CDNR, SHEET_IMPG

AMOUNTS = ["taxable", "cgst", "sgst", "igst"]
#: Amounts a book may have besides; a landing table that has the column carries and sums it.
MORE_AMOUNTS = ["total_tax", "invoice_value", "cess"]

# Import / overseas wording (F1), reverse-charge and ineligible
# answers (F4, F5), debit wording that keeps a note positive (G1).
IMPORT_TERMS = ("import of goods", "imported goods", "import", "overseas")
RCM_YES = ("yes", "y")
ITC_NO = ("no", "n", "ineligible")
DEBIT_MARKERS = ("debit", " dr ", " dr.")


def _lower_trim_text(c: Column) -> Column:
    """``str(value).lower().strip()`` where a missing cell reads as 'nan'."""
    return N.strip_ws(F.lower(F.coalesce(c, F.lit("nan"))))


def is_import(type_col: Column) -> Column:
    """F1 predicate on the type column; missing and '' are not imports (white space around a text hides no term)."""
    s = F.lower(F.coalesce(type_col.cast("string"), F.lit("")))
    hit = F.lit(False)
    for term in IMPORT_TERMS:
        hit = hit | s.contains(term)
    return hit


def is_blank_row(cols: list[str]) -> Column:
    """S3: every data cell missing."""
    return F.coalesce(*[F.col(c) for c in cols]).isNull()  # stops at the first cell that is there


def drop_blank_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """S3 ``dropna(how='all')`` over the data cells; row numbers are kept."""
    return df.na.drop(how="all", subset=cols)


def debit_row(cols: list[str]) -> Column:
    """G1: the whole row's text (cells joined by spaces, lower case) marks a debit."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("nan")) for c in cols]))
    hit = F.lit(False)
    for m in DEBIT_MARKERS:
        hit = hit | text.contains(m)
    return hit


def amounts_of(columns: list[str]) -> list[str]:
    """The amounts of a book: the four of every book and those of ``MORE_AMOUNTS`` that its landing columns hold."""
    return [*AMOUNTS, *[a for a in MORE_AMOUNTS if f"{a}_raw" in columns]]


def _drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_t_")])


def typed_pr_lines(pr_rows: DataFrame) -> DataFrame:
    """Purchase register rows plus keys, typed date and amounts and the
    F1/F2/F3 flags (every input column is kept)."""
    amounts = amounts_of(pr_rows.columns)
    step = pr_rows.select(
        "*",
        N.norm_text("gstin_raw").alias("_t_g"),
        N.norm_text("inv_raw").alias("inv_orig"),
        N.trimmed("date_raw").alias("_t_d"),
    )
    out = N.with_invoice_key(step, "inv_orig", "inv_key").select(
        "*",
        N.drop_ws(F.upper("_t_g")).alias("gst_key"),
        N.parse_date_text("_t_d").alias("inv_date"),
        *[N.amount_of_cell(f"{a}_raw").alias(a) for a in amounts],
        is_import(F.col("purchase_type")).alias("is_import"),
        (N.is_total_label("gstin_raw") | N.is_total_label("inv_raw")).alias("is_total"),
    )
    return _drop_helpers(out)


def typed_b2_rows(b2_rows: DataFrame) -> DataFrame:
    """2B rows (B2B, CDNR, IMPG) plus keys, typed values, G1 signs on credit/debit notes and the F1/F4/F5 flags (every input column is kept;
    blank rows are typed too and dropped by ``typed_b2_lines``)."""
    amounts = amounts_of(b2_rows.columns)
    cells = [c for c in B2_COLUMNS if c in b2_rows.columns]
    step = b2_rows.select(
        "*",
        N.norm_text("gstin_raw").alias("_t_g"),
        N.norm_text("inv_raw").alias("inv_orig"),
        N.trimmed("date_raw").alias("_t_d"),
        N.trimmed("filing_date_raw").alias("_t_fd"),
        *[N.amount_of_cell(f"{a}_raw").alias(f"_t_{a}_v") for a in amounts],
        F.when(F.col("sheet") == SHEET_CDNR, debit_row(cells + ["sheet"])).alias("_t_debit"),
    )
    is_cdnr = F.col("sheet") == SHEET_CDNR
    signed = []
    for a in amounts:
        v = F.col(f"_t_{a}_v")
        signed.append(F.when(is_cdnr, F.when(F.col("_t_debit"), F.abs(v)).otherwise(-F.abs(v))).otherwise(v).alias(a))
    out = N.with_invoice_key(step, "inv_orig", "inv_key").select(
        "*",
        N.drop_ws(F.upper("_t_g")).alias("gst_key"),
        N.parse_date_text("_t_d").alias("inv_date"),
        N.parse_date_text("_t_fd").alias("filing_date"),
        *signed,
        ((F.col("sheet") == SHEET_B2B) & is_import(F.col("supply_type"))).alias("is_import"),
        (N.is_total_label("gstin_raw") | N.is_total_label("inv_raw")).alias("is_total"),
        _lower_trim_text(F.col("reverse_charge")).isin(*RCM_YES).alias("rcm_yes"),
        _lower_trim_text(F.col("itc_availability")).isin(*ITC_NO).alias("itc_no"),
        is_blank_row(cells).alias("is_blank"),
    )
    return _drop_helpers(out)


def typed_b2_lines(b2_typed: DataFrame) -> DataFrame:
    """S3 over typed 2B rows: drop rows whose data cells are all missing.

    The flag is computed once when the typed rows are written, so readers
    filter on one boolean instead of scanning every raw text column."""
    return b2_typed.where(~F.col("is_blank"))


def pr_clean(pr_lines: DataFrame) -> DataFrame:
    """F1 on the purchase register: imports are dropped."""
    return pr_lines.where(~F.col("is_import"))


def b2b_clean(b2_lines: DataFrame) -> DataFrame:
    """F1 on B2B: the non-import half (imports feed 4A1 only)."""
    return b2_lines.where((F.col("sheet") == SHEET_B2B) & ~F.col("is_import"))


def b2b_imports(b2_lines: DataFrame) -> DataFrame:
    return b2_lines.where((F.col("sheet") == SHEET_B2B) & F.col("is_import"))


def cdnr_signed(b2_lines: DataFrame) -> DataFrame:
    return b2_lines.where(F.col("sheet") == SHEET_CDNR)


def impg_lines(b2_lines: DataFrame) -> DataFrame:
    return b2_lines.where(F.col("sheet") == SHEET_IMPG)


def matchable_2b(b2_lines: DataFrame) -> DataFrame:
    """B2B (clean) + CDNR (signed): the 2B lines that take part in matching."""
    return b2_lines.where(((F.col("sheet") == SHEET_B2B) & ~F.col("is_import")) | (F.col("sheet") == SHEET_CDNR))


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """``where`` on columns that ``df`` computes, which stays above that computation.

    Spark would move the filter down to the scan and compute the columns there once more, for the filter alone.  It does
    not move one below a projection whose value depends on the row's place; the number itself plays no part."""
    keep = F.when(F.monotonically_increasing_id() >= 0, condition).alias("_lw_keep")
    return df.select("*", keep).where("_lw_keep").drop("_lw_keep")


def keyed_rows(df: DataFrame) -> DataFrame:
    """F2 + F3: no total rows, no empty GSTIN key (empty invoice keys stay)."""
    return where_computed(df, ~F.col("is_total") & (F.col("gst_key") != ""))


def whole_keys(df: DataFrame) -> DataFrame:
    """Lines whose GSTIN key and invoice key are both non-empty."""
    return where_computed(df, (F.col("gst_key") != "") & (F.col("inv_key") != ""))
