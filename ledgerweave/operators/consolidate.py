"""One row per (supplier GSTIN, invoice key).

``consolidate_by_key`` is a single aggregation with a map-side partial step:
sums, minima and "first non-null in sheet order" are pre-aggregated in every
task before the shuffle, so a hot key (one supplier whose invoices all
collapse to the same key) sends at most one row per task.  The text "first"
values are ``min_by`` over strings, which Spark runs as a sort-based
aggregate (its hash aggregate cannot hold string buffers); it spills instead
of failing when a partition is large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..sources.scratch import materialize
from .lines import amounts_of, keyed_rows, whole_keys
from .ordinal import dense_ordinal, rank_in_group

KEY = ["gst_key", "inv_key"]


def first_non_null(col: str, order_col: str = "row_no"):
    """pandas ``first`` in sheet order: the value of the earliest row where it is present."""
    return F.min_by(F.col(col), F.when(F.col(col).isNotNull(), F.col(order_col)))


def consolidate_by_key(lines: DataFrame, first_cols: Sequence[str], extra_keys: Sequence[str] = (),
                       sums: Sequence[str] | None = None) -> DataFrame:
    """A1: F2, F3, then group by key: sum amounts (all that the book has),
    earliest date, first non-null of every other column, first sheet row."""
    rows = keyed_rows(lines)
    sums = amounts_of(lines.columns) if sums is None else sums
    aggs = [F.sum(c).cast("decimal(38,2)").alias(c) for c in sums]
    aggs.append(F.min("inv_date").alias("inv_date"))
    aggs += [first_non_null(c).alias(c) for c in first_cols]
    aggs.append(F.min("row_no").alias("first_row"))
    aggs.append(F.count(F.lit(1)).alias("n_lines"))
    return rows.groupBy(*KEY, *extra_keys).agg(*aggs)


PR_FIRST = ["gstin_raw", "inv_orig", "doc_type", "vendor_name", "purchase_type"]
# every text column of the 2B landing book; later scans of the written table read the columns they need
B2_FIRST = ["gstin_raw", "inv_orig", "inv_type", "note_type", "trade_name", "reverse_charge", "itc_availability",
            "filing_date_raw", "filing_period", "supply_type"]


def consolidate_pr(pr_lines_clean: DataFrame) -> DataFrame:
    return consolidate_by_key(pr_lines_clean, PR_FIRST)


def rescue_empty_inv_key(b2_cons: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A CDNR note whose key is empty becomes ``__CDNR_ROW__<i>__`` where
    ``i`` is its 0-based position among the consolidated CDNR rows in key order.

    Only the distinct CDNR keys (two columns) are ordered, with the
    distributed ordinal; the renames (at most one per supplier) join back.
    With ``by`` the positions are those inside each run.
    """
    cdnr = b2_cons.where(F.col("sheet") == "B2B-CDNR").select(*by, *KEY)
    ords = rank_in_group(cdnr, by, KEY, name="_pos", start=0) if by else dense_ordinal(cdnr, KEY, name="_pos", start=0)
    renames = ords.where(F.col("inv_key") == "").select(
        *by, "gst_key", F.lit("").alias("_empty"), F.lit("B2B-CDNR").alias("_sheet"),
        F.concat(F.lit("__CDNR_ROW__"), F.col("_pos").cast("string"), F.lit("__")).alias("_new_key"))
    # at most one rename per supplier; written, so the join goes by its bytes
    renames = materialize(renames, "renames")
    same = (b2_cons.gst_key == renames.gst_key) & (b2_cons.inv_key == renames._empty) & (b2_cons.sheet == renames._sheet)
    for c in by:
        same = same & (b2_cons[c] == renames[c])
    out = b2_cons.join(renames, same, "left").select(b2_cons["*"], renames["_new_key"])
    return out.withColumn("inv_key", F.coalesce(F.col("_new_key"), F.col("inv_key"))).drop("_new_key")


ROW_BUCKET = 100_000


def row_numbers_by_key(lines: DataFrame, name: str) -> DataFrame:
    """A2: every sheet row per key, numeric order, joined with ', '.
    Only rows whose GSTIN key and invoice key are both non-empty.

    Two levels so a key with very many lines is not sorted in one task: rows
    are sorted inside contiguous row-number buckets first; the per-key step
    only concatenates the bucket texts in bucket order (all numbers of bucket
    b are below those of bucket b + 1, so the result is the same sorted list).
    """
    rows = whole_keys(lines)
    bucket = (F.col("row_no") / F.lit(ROW_BUCKET)).cast("bigint")
    parts = rows.groupBy(*KEY, bucket.alias("_b")).agg(
        F.array_join(F.array_sort(F.collect_list(F.col("row_no"))), ", ").alias("_t"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_b"), F.col("_t"))))
    return parts.groupBy(*KEY).agg(F.array_join(F.transform(ordered, lambda x: x["_t"]), ", ").alias(name))


def period_by_key(b2_lines: DataFrame) -> DataFrame:
    """A3: first seen filing period text per key, B2B rows before CDNR rows."""
    rows = whole_keys(b2_lines)
    rank = F.when(F.col("sheet") == "B2B", F.lit(0)).otherwise(F.lit(1))
    order = F.struct(rank.alias("r"), F.col("row_no").alias("n"))
    txt = N.norm_text("filing_period")
    return rows.groupBy(*KEY).agg(F.min_by(txt, order).alias("filing_period"))
