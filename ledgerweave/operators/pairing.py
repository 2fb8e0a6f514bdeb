"""Building the ``pair`` table.

Plan shape (see README "Plans"):

* J1 joins the two consolidated books on (gst_key, inv_key).  The 2B side
  first runs the W1 window partitioned by the same key (at most two rows per
  key, one per sheet, so no window partition can be hot); its exchange is the
  one the sort-merge join needs, so W1 costs no extra shuffle.
* Matched rows pass straight through.  Only orphans (rows present on one side)
  enter J2, which ranks them first-in-first-out inside each fuzzy key with
  ``rank_in_group`` (range-sorted, so a hot fuzzy key is split across tasks)
  and pairs equal ranks with an equi-join; no pair enumeration.
* J3/P4/P5 are row-level expressions; A4 is one aggregation per GSTIN
  (partial aggregation map-side) joined back; AQE broadcasts the name table
  when it is small at run time and splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from .consolidate import KEY
from .lines import AMOUNTS, MORE_AMOUNTS
from ..sources.scratch import materialize
from .ordinal import rank_in_group

# Status labels, remarks and reason texts of the classification.
MATCHED = "Matched"
ALMOST = "Almost Matched"
NOT_MATCHED = "Not Matched"
STATUSES = (MATCHED, ALMOST, NOT_MATCHED)
REMARK_ALL_MATCHED = "All fields matched"
REMARK_MISMATCH = "mismatch"
REMARK_FUZZY = "mis-match"
REMARK_MISSING_2B = "missing in 2B"
REMARK_MISSING_PR = "missing in PR"
REASON_DATE = "Invoice Date"
REASON_GSTIN = "GSTIN"
REASON_INVOICE = "Invoice No"
REASON_TYPOS = "Typos"

ALL_AMOUNTS = [*AMOUNTS, *MORE_AMOUNTS]
PR_VALUES = ["pr_gstin", "pr_inv", "pr_date", *[f"pr_{a}" for a in ALL_AMOUNTS], "pr_doc_type",
             "pr_vendor_name", "pr_first_row"]
B2_VALUES = ["b2_gstin", "b2_inv", "b2_date", *[f"b2_{a}" for a in ALL_AMOUNTS], "b2_inv_type", "b2_note_type",
             "b2_trade_name", "b2_filing_period", "b2_first_row"]
# Every 2B column but the sums and counts, which are never missing (nor is a PR column: a key has one PR row)
B2_FILLABLE = [c for c in B2_VALUES if c.removeprefix("b2_") not in (*ALL_AMOUNTS, "first_row")]


def _amounts(cons: DataFrame, prefix: str) -> list[Column]:
    """The sums under their side's names; null for an amount that the book does not have."""
    return [(F.col(a) if a in cons.columns else F.lit(None).cast("decimal(38,2)")).alias(f"{prefix}_{a}") for a in ALL_AMOUNTS]


def suffix_pr(pr_cons: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """P1 for the purchase register side.  Here and below, ``by`` names columns that keep runs apart: rows of different
    runs never meet, whatever their keys."""
    return pr_cons.select(
        *by, *KEY, F.lit(True).alias("pr_exists"),
        F.col("gstin_raw").alias("pr_gstin"), F.col("inv_orig").alias("pr_inv"), F.col("inv_date").alias("pr_date"),
        *_amounts(pr_cons, "pr"),
        F.col("doc_type").alias("pr_doc_type"), F.col("vendor_name").alias("pr_vendor_name"),
        F.col("first_row").alias("pr_first_row"))


def suffix_2b(b2_cons: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """P1 for the 2B side, plus the W1 sibling values of the same key (of two rows, the only value there is)."""
    b2 = b2_cons.select(
        *by, *KEY, "sheet",
        F.when(F.col("sheet") == "B2B", F.lit(0)).otherwise(F.lit(1)).alias("sheet_rank"),
        F.col("gstin_raw").alias("b2_gstin"), F.col("inv_orig").alias("b2_inv"), F.col("inv_date").alias("b2_date"),
        *_amounts(b2_cons, "b2"),
        F.col("inv_type").alias("b2_inv_type"), F.col("note_type").alias("b2_note_type"),
        F.col("trade_name").alias("b2_trade_name"), F.col("filing_period").alias("b2_filing_period"),
        F.col("first_row").alias("b2_first_row"))
    w = Window.partitionBy(*by, *KEY)
    return b2.select("*", F.count(F.lit(1)).over(w).alias("b2_parts"),
                     *[F.max(c).over(w).alias(f"{c}__sib") for c in B2_FILLABLE])


def _use_siblings(df: DataFrame, when: Column) -> DataFrame:
    """ffill/bfill inside the key = take the sibling's value where missing."""
    filled = {c: F.when(when, F.coalesce(F.col(c), F.col(f"{c}__sib"))).otherwise(F.col(c)) for c in B2_FILLABLE}
    return df.withColumns(filled).drop(*[f"{c}__sib" for c in B2_FILLABLE])


def outer_join(pr: DataFrame, b2: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Full outer equi-join on both keys (keys are never null)."""
    return pr.join(b2, [*by, *KEY], "full").withColumn("pr_exists", F.coalesce(F.col("pr_exists"), F.lit(False)))


def fifo_ranks(joined: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rank of every orphan among those of its fuzzy key and side (0: PR, 1: 2B), in key order.

    Only fuzzy keys present on both sides can pair; ranks are relative to the
    whole fuzzy group, and every member of such a group is kept.  Both sides
    are ranked by one distributed ordinal (side is part of the group).
    """
    fk = [N.fuzzy_gstin("gst_key").alias("fg"), N.fuzzy_invoice("inv_key").alias("fi")]
    has_b2 = F.col("sheet").isNotNull()
    pr_f = joined.where(F.col("pr_exists") & ~has_b2).select(*by, *KEY, F.lit(0).alias("sheet_rank"), *fk, F.lit(0).alias("side"))
    b2_f = joined.where(~F.col("pr_exists") & has_b2).select(*by, *KEY, "sheet_rank", *fk, F.lit(1).alias("side"))
    fuzzy = [*by, "fg", "fi"]
    both = pr_f.select(*fuzzy).intersect(b2_f.select(*fuzzy))
    cand = pr_f.unionByName(b2_f).join(both, fuzzy, "left_semi")
    return rank_in_group(cand, [*fuzzy, "side"], [*KEY, "sheet_rank"], name="fifo")


def fuzzy_rescue(joined: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """J2 + W1 + W2 over the joined rows; returns the rows of ``pair`` before J3."""
    key = [*by, *KEY]
    has_b2 = F.col("sheet").isNotNull()
    matched = _use_siblings(joined.where(F.col("pr_exists") & has_b2), F.lit(True)).withColumn(
        "fuzzy_reason", F.lit(None).cast("string")).withColumn("key_rows", F.col("b2_parts"))
    pr_o = joined.where(F.col("pr_exists") & ~has_b2).select(*key, *PR_VALUES, "pr_exists")
    b2_o = joined.where(~F.col("pr_exists") & has_b2).select(
        *key, "sheet", "sheet_rank", *B2_VALUES, "b2_parts", *[f"{c}__sib" for c in B2_FILLABLE])

    ranked = fifo_ranks(joined, by)
    pr_r = ranked.where(F.col("side") == 0).select("fg", "fi", "fifo", *key)
    b2_r = ranked.where(F.col("side") == 1).select(
        *by, "fg", "fi", "fifo", F.col("gst_key").alias("src_gst"), F.col("inv_key").alias("src_inv"),
        F.col("sheet_rank").alias("src_rank"))
    links = materialize(pr_r.join(b2_r, [*by, "fg", "fi", "fifo"], "inner").select(*key, "src_gst", "src_inv", "src_rank"),
                        "links")

    b2_src = b2_o.select(*by, F.col("gst_key").alias("src_gst"), F.col("inv_key").alias("src_inv"),
                         F.col("sheet_rank").alias("src_rank"), "sheet", "sheet_rank", *B2_VALUES)
    reason = F.concat_ws(", ", F.when(F.col("gst_key") != F.col("src_gst"), F.lit(REASON_GSTIN)),
                         F.when(F.col("inv_key") != F.col("src_inv"), F.lit(REASON_INVOICE)))
    rescued = (pr_o.join(links, key, "inner")
               .join(b2_src, [*by, "src_gst", "src_inv", "src_rank"], "inner")
               .withColumn("fuzzy_reason", F.when(reason == "", F.lit(REASON_TYPOS)).otherwise(reason))
               .withColumn("b2_parts", F.lit(1).cast("bigint"))
               .withColumn("key_rows", F.lit(1).cast("bigint"))
               .drop("src_gst", "src_inv", "src_rank"))
    pr_left = pr_o.join(links.select(*key), key, "left_anti").withColumn("fuzzy_reason", F.lit(None).cast("string")) \
        .withColumn("key_rows", F.lit(1).cast("bigint"))

    taken = links.select(*by, F.col("src_gst").alias("gst_key"), F.col("src_inv").alias("inv_key"),
                         F.col("src_rank").alias("sheet_rank"))
    taken_keys = taken.select(*key).distinct().withColumn("_key_taken", F.lit(True))
    b2_left = (b2_o.join(taken, [*key, "sheet_rank"], "left_anti")
               .join(taken_keys, key, "left")
               .withColumn("fuzzy_reason", F.lit(None).cast("string")))
    # siblings fill each other only when both 2B rows of the key remain
    b2_left = _use_siblings(b2_left, (F.col("b2_parts") == 2) & F.col("_key_taken").isNull())
    b2_left = b2_left.withColumn("key_rows", F.when(F.col("_key_taken").isNotNull(), F.lit(1).cast("bigint"))
                                 .otherwise(F.col("b2_parts"))).drop("_key_taken")
    b2_left = b2_left.withColumn("pr_exists", F.lit(False))

    return matched.unionByName(rescued, allowMissingColumns=True) \
        .unionByName(pr_left, allowMissingColumns=True) \
        .unionByName(b2_left, allowMissingColumns=True)


def _tax_differs(a: str) -> Column:
    pr = F.abs(N.round_rupee(F.coalesce(F.col(f"pr_{a}"), F.lit(0))))
    b2 = F.abs(N.round_rupee(F.coalesce(F.col(f"b2_{a}"), F.lit(0))))
    return pr != b2


def classify(rows: DataFrame) -> DataFrame:
    """Matched / Almost Matched / Not Matched with remarks and reasons."""
    has_pr = F.col("pr_exists")
    has_b2 = F.col("sheet").isNotNull()
    fuzzy = F.col("fuzzy_reason").isNotNull()
    problems = F.array_join(F.array(
        F.when(~F.col("pr_date").eqNullSafe(F.col("b2_date")), F.lit(REASON_DATE)),
        F.when(_tax_differs("cgst"), F.lit("CGST")),
        F.when(_tax_differs("sgst"), F.lit("SGST")),
        F.when(_tax_differs("igst"), F.lit("IGST")),
    ), "; ")
    mapping = (F.when(fuzzy, F.lit(ALMOST)).when(has_pr & ~has_b2, F.lit(NOT_MATCHED))
               .when(has_b2 & ~has_pr, F.lit(NOT_MATCHED)).when(problems != "", F.lit(ALMOST))
               .otherwise(F.lit(MATCHED)))
    remarks = (F.when(fuzzy, F.lit(REMARK_FUZZY)).when(has_pr & ~has_b2, F.lit(REMARK_MISSING_2B))
               .when(has_b2 & ~has_pr, F.lit(REMARK_MISSING_PR)).when(problems != "", F.lit(REMARK_MISMATCH))
               .otherwise(F.lit(REMARK_ALL_MATCHED)))
    reason = F.when(fuzzy, F.col("fuzzy_reason")).when(has_pr & has_b2, problems).otherwise(F.lit(""))
    return rows.withColumn("mapping", mapping).withColumn("remarks", remarks).withColumn("reason", reason)


def invoice_type(rows: DataFrame) -> DataFrame:
    """First non-empty of PR type, 2B type, credit / debit by the note type, 'Invoice' for B2B or a PR invoice."""
    note = F.lower(N.norm_text("b2_note_type"))
    t_pr = N.norm_text("pr_doc_type")
    t_b2 = N.norm_text("b2_inv_type")
    it = (F.when(t_pr != "", t_pr).when(t_b2 != "", t_b2)
          .when(note.contains("credit"), F.lit("Credit Note")).when(note.contains("debit"), F.lit("Debit Note"))
          .when(F.col("sheet") == "B2B", F.lit("Invoice"))
          .when(F.col("pr_exists"), F.lit("Invoice")).otherwise(F.lit("")))
    return rows.withColumn("invoice_type", it)


def show_cdnr_gstin(rows: DataFrame) -> DataFrame:
    """P5: on CDNR rows the shown 2B GSTIN is the GSTIN key."""
    return rows.withColumn("b2_gstin", F.when(F.col("sheet") == "B2B-CDNR", F.col("gst_key")).otherwise(F.col("b2_gstin")))


def pair_order() -> list[Column]:
    """Order of pair rows: key order, B2B before CDNR inside a key."""
    rank = F.when(F.col("fuzzy_reason").isNotNull() | F.col("sheet").isNull(), F.lit(0)).otherwise(F.col("sheet_rank"))
    return [F.col("gst_key"), F.col("inv_key"), rank]


def vendor_names(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A4: longest valid name per GSTIN, purchase register names first, then
    2B names; equal lengths keep the earliest (pair order)."""
    order = pair_order()
    pr = rows.select(*by, "gst_key", N.norm_text("pr_vendor_name").alias("name"), F.lit(0).alias("side"),
                     order[1].alias("o1"), order[2].alias("o2"))
    b2 = rows.select(*by, "gst_key", N.norm_text("b2_trade_name").alias("name"), F.lit(1).alias("side"),
                     order[1].alias("o1"), order[2].alias("o2"))
    names = pr.unionByName(b2).where(N.is_valid_name(F.col("name")))
    pick = F.struct((-F.length("name")).alias("l"), F.col("side"), F.col("o1"), F.col("o2"))
    return names.groupBy(*by, "gst_key").agg(F.min_by("name", pick).alias("vendor_name"))


def with_vendor_names(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Attach A4 names from a written table of one row per supplier: AQE
    broadcasts it by its bytes, or splits the partitions of large suppliers."""
    names = materialize(vendor_names(rows, by), "names")
    return rows.join(names, [*by, "gst_key"], "left").withColumn("vendor_name", F.coalesce(F.col("vendor_name"), F.lit("")))


PAIR_COLUMNS = ["pair_id", *KEY, "mapping", "remarks", "reason", "vendor_name", "invoice_type", "sheet",
                "sheet_rank", "key_rows", "fuzzy_reason", "pr_exists", *PR_VALUES, *B2_VALUES]


def status_lookup(pairs: DataFrame) -> DataFrame:
    """Key -> (mapping, remarks, reason) of the last pair with that key.

    A key has at most two pair rows (its B2B and CDNR parts, in that order),
    and every pair row knows how many rows its key has (``key_rows``), so
    the last row is found by a filter: no aggregation, no shuffle.
    """
    last = (F.col("key_rows") == 1) | (F.col("sheet_rank") == 1)
    return pairs.where(last).select(*KEY, "mapping", "remarks", "reason")


def recon_projection(pairs: DataFrame) -> DataFrame:
    """The Reconciliation sheet (ISO date text, keys first)."""
    return pairs.select(
        "gst_key", "inv_key", "invoice_type", "mapping", "remarks", "reason", "vendor_name",
        F.coalesce(F.col("b2_filing_period"), F.lit("")).alias("filing_period"),
        F.coalesce(F.col("pr_gstin"), F.lit("")).alias("pr_gstin"),
        F.coalesce(F.col("b2_gstin"), F.lit("")).alias("b2_gstin"),
        F.coalesce(F.col("pr_inv"), F.lit("")).alias("pr_inv"),
        F.coalesce(F.col("b2_inv"), F.lit("")).alias("b2_inv"),
        N.iso_date("pr_date").alias("pr_date"), N.iso_date("b2_date").alias("b2_date"),
        "pr_cgst", "b2_cgst", "pr_sgst", "b2_sgst", "pr_igst", "b2_igst")
