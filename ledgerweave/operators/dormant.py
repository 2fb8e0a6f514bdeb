"""Rules defined in the reference but never called there.

They are kept as table-wide jobs so a user of the old lookup-style
reconciliation or note classification can still run them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..sources.scratch import materialize
from .consolidate import KEY, first_non_null
from .pairing import ALMOST, MATCHED, NOT_MATCHED, REASON_DATE

# Texts of the lookup-style reconciliation and the debit-note words.
NO_KEY_REMARK = "no GSTIN+Invoice in PR"
NO_KEY_REASON = "missing GSTIN/Invoice in PR"
NO_MATCH_REMARK = "no GSTIN+Invoice match"
DEBIT_WORDS = r"\bdebit\b|\bdn\b|\bdr\b"


def lookup_reconcile(pr_lines: DataFrame, b2_lines: DataFrame) -> DataFrame:
    """Every purchase register row against the first 2B row of its key.

    The 2B side collapses to one row per key (first row in sheet order plus
    the candidate count) with a partial aggregation, then one left join.
    """
    b2 = b2_lines.where((F.col("gst_key") != "") & (F.col("inv_key") != ""))
    rank = F.when(F.col("sheet") == "B2B", F.lit(0)).otherwise(F.lit(1))
    order = F.struct(rank.alias("r"), F.col("row_no").alias("n"))
    first = F.struct("inv_date", "cgst", "sgst", "igst")
    cand = b2.groupBy(*KEY).agg(F.min_by(first, order).alias("b"), F.count(F.lit(1)).alias("n_cand"))
    # written: a join of two scans is one whose hot key AQE can split
    j = pr_lines.join(materialize(cand, "lookup"), KEY, "left")

    def differs(t):
        return F.abs(N.round_rupee(F.col(t))) != F.abs(N.round_rupee(F.col(f"b.{t}")))

    problems = F.array_join(F.array(
        F.when(~F.col("inv_date").eqNullSafe(F.col("b.inv_date")), F.lit(REASON_DATE)),
        F.when(differs("cgst"), F.lit("CGST")), F.when(differs("sgst"), F.lit("SGST")),
        F.when(differs("igst"), F.lit("IGST"))), "; ")
    multi = F.when(F.col("n_cand") > 1, F.concat(F.lit("multiple matches in 2B ("), F.col("n_cand").cast("string"),
                                                   F.lit(")")))
    no_key = (F.col("gst_key") == "") | (F.col("inv_key") == "")
    no_match = F.col("n_cand").isNull()
    mapping = (F.when(no_key, F.lit(NOT_MATCHED)).when(no_match, F.lit(NOT_MATCHED))
               .when(problems != "", F.lit(ALMOST)).otherwise(F.lit(MATCHED)))
    remarks = (F.when(no_key, F.lit(NO_KEY_REMARK)).when(no_match, F.lit(NO_MATCH_REMARK))
               .when(problems != "", F.lit("mismatch"))
               .otherwise(F.concat(F.lit("All fields matched"),
                                   F.coalesce(F.concat(F.lit(" ("), multi, F.lit(")")), F.lit("")))))
    reason = (F.when(no_key, F.lit(NO_KEY_REASON)).when(no_match, F.lit(""))
              .when(problems != "", F.concat_ws("; ", problems, multi)).otherwise(F.lit("")))
    return j.select("row_no", *KEY, mapping.alias("mapping"), remarks.alias("remarks"), reason.alias("reason"))


def classify_notes(b2_lines: DataFrame) -> DataFrame:
    """Note class (debit / credit / invoice) and the sign it implies."""
    word = F.lower(N.norm_text("note_type"))
    is_cdnr = F.col("sheet") == "B2B-CDNR"
    cls = F.when(is_cdnr, F.when(word.rlike(DEBIT_WORDS), F.lit("debit")).otherwise(F.lit("credit"))) \
        .otherwise(F.lit("invoice"))
    out = b2_lines.where(F.col("sheet").isin("B2B", "B2B-CDNR")).withColumn("note_class", cls)
    for a in ("taxable", "cgst", "sgst", "igst"):
        v = N.parse_amount(f"{a}_raw")
        out = out.withColumn(a, F.when(F.col("note_class") == "credit", -F.abs(v)).otherwise(F.abs(v)))
    return out


def note_type_by_key(classified: DataFrame, b2_cons: DataFrame) -> DataFrame:
    """First note class per key (sheet order) onto the consolidated CDNR rows."""
    cdnr = classified.where(F.col("sheet") == "B2B-CDNR")
    first = cdnr.groupBy(*KEY).agg(first_non_null("note_class").alias("note_class"))
    cons = b2_cons.where(F.col("sheet") == "B2B-CDNR").select(*KEY)
    return cons.join(first, KEY, "left").select(*KEY, F.coalesce(F.col("note_class"), F.lit("")).alias("note_class"))
