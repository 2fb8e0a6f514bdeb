"""Reviewer decisions, saved state and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..sources.scratch import materialize
from .ordinal import first_n_per_group
from .pairing import ALMOST, MATCHED, NOT_MATCHED

# Texts written by the review step.
ACCEPTED_REMARK = "Accepted by User"
ACCEPTED_REASON = "User Verified"
REJECTED_REMARK = "Rejected by User"
REJECTED_SUFFIX = " (Rejected)"
HISTORY_PAGE = 50



def review_candidates(pairs: DataFrame) -> DataFrame:
    """the Almost Matched pairs shown to the reviewer (missing -> '')."""
    rows = pairs.where(F.col("mapping") == ALMOST)
    txt = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select(
        F.col("pair_id").alias("id"), "gst_key", "inv_key", "mapping", "remarks", "reason", "vendor_name",
        "invoice_type", txt("pr_gstin").alias("pr_gstin"), txt("b2_gstin").alias("b2_gstin"),
        txt("pr_inv").alias("pr_inv"), txt("b2_inv").alias("invoice_no_2b"),
        N.iso_date("pr_date").alias("pr_date"), N.iso_date("b2_date").alias("invoice_date_2b"),
        "pr_cgst", "b2_cgst", "pr_sgst", "b2_sgst", "pr_igst", "b2_igst")


def apply_review(pairs: DataFrame, accepted_ids: DataFrame) -> DataFrame:
    """Accepted Almost pairs become Matched, every other Almost pair Not Matched."""
    acc = materialize(accepted_ids.select(F.col("pair_id").alias("_acc_id")).distinct(), "accepted")
    j = pairs.join(acc, pairs.pair_id == acc._acc_id, "left")
    almost = F.col("mapping") == ALMOST
    ok = F.col("_acc_id").isNotNull()
    return j.select(
        *[c for c in pairs.columns if c not in ("mapping", "remarks", "reason")],
        F.when(almost, F.when(ok, F.lit(MATCHED)).otherwise(F.lit(NOT_MATCHED))).otherwise(F.col("mapping"))
        .alias("mapping"),
        F.when(almost, F.when(ok, F.lit(ACCEPTED_REMARK)).otherwise(F.lit(REJECTED_REMARK))).otherwise(F.col("remarks"))
        .alias("remarks"),
        F.when(almost, F.when(ok, F.lit(ACCEPTED_REASON))
               .otherwise(F.concat(F.coalesce(F.col("reason"), F.lit("")), F.lit(REJECTED_SUFFIX))))
        .otherwise(F.col("reason")).alias("reason"),
    )


def derived_decisions(pairs: DataFrame) -> DataFrame:
    """Reviewer input for the derived books: accept Almost pairs with an even id."""
    return pairs.where((F.col("mapping") == ALMOST) & (F.col("pair_id") % 2 == 0)).select("pair_id")


def not_matched_report(pairs: DataFrame) -> DataFrame:
    """F8: the 'Not Matched only' download."""
    return pairs.where(F.col("mapping") == NOT_MATCHED)


def run_log(pairs: DataFrame, run_id: str, owner: str, report_name: str, file: str, status: str = "completed") -> DataFrame:
    """K1: the log row of a run: when, which file, matched / mismatched tax value, pair count and how it ended."""
    total = (F.coalesce(F.col("pr_cgst"), F.lit(0)) + F.coalesce(F.col("pr_sgst"), F.lit(0))
             + F.coalesce(F.col("pr_igst"), F.lit(0)))
    matched = F.col("mapping") == MATCHED

    def value(when):
        return F.coalesce(F.sum(F.when(when, total)), F.lit(0)).cast("decimal(38,2)")

    return pairs.agg(value(matched).alias("matched_value"), value(~matched).alias("mismatched_value"),
                     F.count(F.lit(1)).alias("row_count")).select(
        F.lit(run_id).alias("run_id"), F.lit(owner).alias("owner"), F.lit(report_name).alias("report_name"),
        F.current_timestamp().alias("generated_at"), "matched_value", "mismatched_value", "row_count", F.lit(file).alias("file"),
        F.lit(status).alias("status"))


def history_topk(reports: DataFrame, n: int = HISTORY_PAGE) -> DataFrame:
    """Per owner, reports named 'Recon_<owner>_...' not trashed, newest first, at most ``n``.

    Exact top-n per owner in two stages (salted sub-groups first), so an owner
    with a huge history never lands in a single task.
    """
    listed = reports.where(
        F.col("name").contains(F.concat(F.lit("Recon_"), F.col("owner").cast("string"), F.lit("_")))
        & ~F.col("trashed"))
    order = [F.col("created").desc(), F.col("report_id").desc()]
    top = first_n_per_group(listed, ["owner"], order, n, salt_from=["report_id"], name="rank")
    return top.select("owner", "rank", "report_id", F.regexp_replace("name", r"\.xlsx$", "").alias("report_name"),
                      F.date_format("created", "dd-MMM-yyyy HH:mm").alias("generated_at"))


def derived_reports(orders: DataFrame) -> DataFrame:
    """Saved report files derived from ``orders``: one per order, 20 owners;
    urgent orders were finished without review and carry the other name."""
    owner = F.pmod(F.col("o_custkey"), F.lit(20))
    name = F.when(F.col("o_orderpriority") == "1-URGENT",
                  F.concat(F.lit("Reconciliation_Report_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".xlsx"))) \
        .otherwise(F.concat(F.lit("Recon_"), owner.cast("string"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"),
                            F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".xlsx")))
    return orders.select(owner.alias("owner"), F.col("o_orderkey").alias("report_id"), name.alias("name"),
                         F.col("o_orderdate").alias("created"), (F.col("o_orderstatus") == "P").alias("trashed"))
