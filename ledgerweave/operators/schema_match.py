"""Finding the meaning of uploaded columns, as catalog-wide jobs.

The input is a catalog of uploaded headers (one row per table column) and,
for value profiling, the cells.  The role dictionary is a fixed, small
constant of the program (C13); it is compiled at plan time into column
expressions (``isin`` for equality, one alternation regex for "contains"
and one for "starts with"), so scoring is a narrow projection over the
catalog: no join against the dictionary, no pair enumeration.  Picking the
best column per (table, role) is one aggregation with ``max_by``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..sources.scratch import materialize
from .ordinal import first_n_per_group

# ---------------------------------------------------------------------------
# The role dictionary (candidate, avoid and penalty terms) that
# the column detection must share with the reconciliation rules.  Lists are in
# their natural order; "document no." and "invoice number" are two terms.
ROLE_LISTS: dict[str, list[str]] = {
    "invoice_2b": ["invoice details invoice number", "invoice number", "invoice no", "inv no", "inv number",
                   "invoice", "invoice details inv no", "invoice details document number", "note no",
                   "debit note no", "credit note no", "note number", "doc number", "doc no", "document number",
                   "document no."],
    "gstin_2b": ["gstin of supplier", "gstin", "gst no", "gst number", "gstn", "supplier gstin"],
    "gstin_cdnr": ["gstin of supplier", "gstin", "gst no", "gst number", "gstin number"],
    "date_2b": ["invoice details invoice date", "invoice date", "doc date", "document date", "date"],
    "note_no_2b": ["note no", "note number", "credit note no", "debit note no", "cn no", "dn no", "document number",
                   "document no."],
    "note_date_2b": ["note date", "document date", "doc date", "credit note date", "debit note date"],
    "note_type_2b": ["note type", "credit/debit note", "cr/dr", "type of note", "cd note type", "cr/dr note"],
    "inv_type": ["document type", "doc type", "invoice type", "inv type", "type", "type of transaction"],
    "cgst_2b": ["cgst", "central tax", "central tax amount", "cgst amount"],
    "sgst_2b": ["sgst", "state tax", "state/ut tax", "state tax amount", "sgst amount", "utgst", "utgst amount"],
    "igst_2b": ["igst", "integrated tax", "integrated tax amount", "igst amount"],
    "taxable_2b": ["taxable value", "taxable amount", "assessable value", "taxable"],
    "total_tax_2b": ["total tax", "total tax amount", "tax amount"],
    "invoice_value_2b": ["invoice value", "total invoice value", "value of invoice", "invoice total"],
    "cess_2b": ["cess", "cess amount"],
    "invoice_pr": ["vendor inv no", "vendor invoice no", "vendor invoice number", "supplier inv no",
                   "supplier invoice no", "supplier invoice number", "party invoice no", "party inv no", "bill no",
                   "bill number", "doc no", "doc number", "document number", "document no.", "invoice number",
                   "invoice no", "inv no", "inv number", "invoice", "doc no"],
    "gstin_pr": ["supplier gstin", "vendor gstin", "party gstin", "gstin of supplier", "gstin", "gst no",
                 "gst number", "gstn"],
    "date_pr": ["invoice date", "vendor invoice date", "supplier invoice date", "bill date", "doc date",
                "document date", "date"],
    "cgst_pr": ["cgst", "cgst amount", "central tax", "central tax amount", "cgst tax"],
    "sgst_pr": ["sgst", "sgst amount", "state tax", "state tax amount", "sgst tax"],
    "igst_pr": ["igst", "igst amount", "integrated tax", "integrated tax amount", "igst tax"],
    "taxable_pr": ["taxable value", "taxable amount", "assessable value", "taxable"],
    "total_tax_pr": ["total tax", "total tax amount", "tax amount"],
    "invoice_value_pr": ["invoice value", "total invoice value", "value of invoice", "invoice total"],
    "cess_pr": ["cess", "cess amount"],
    "avoid_doc_like_pr": ["voucher no", "voucher number"],
    "avoid_recipient_gstin_pr": ["our gstin", "recipient gstin", "buyer gstin"],
    "vendor_name_pr": ["vendor name", "supplier name", "party name", "name of supplier", "vendor", "supplier"],
    "trade_name_2b": ["trade or legal name", "trade/legal name", "trade name", "legal name", "supplier trade name",
                      "supplier legal name", "recipient trade name"],
    "gstr1_status_2b": ["gstr-1 filing status", "gstr1 filing status", "filing status", "filing status details",
                        "gstr1 status", "gstr-1 status", "status", "tax period", "return period", "period"],
}
IMPORT_TYPE_TERMS = ["purchase type", "transaction type", "nature of transaction", "type of purchase", "supply type",
                     "nature", "voucher type", "details"]
SUPPLIER_WORDS = ["supplier", "vendor", "party"]
NOT_SUPPLIER_WORDS = ["company", "recipient", "customer", "buyer", "our"]
INVOICE_SKIP_WORDS = ["gstin", "gst", "tax", "cgst", "sgst", "igst", "amount", "value", "taxable", "company",
                      "recipient", "buyer", "customer", "date", "period"]
REGEX_ROLES = {"note_number": r"\bnote\s*number\b", "note_date": r"\bnote\s*date\b", "igst": "igst|integrated",
               "cgst": "cgst|central", "sgst": "sgst|state|utgst"}
# Pools in the order they are tried.
FIRST_POOLS = {"igst": ["igst_2b"], "cgst": ["cgst_2b"], "sgst": ["sgst_2b"], "number": ["note_no_2b", "invoice_2b"],
               "day": ["note_date_2b", "date_2b"], "value": ["invoice_value_2b", "taxable_2b", "total_tax_2b"]}
NOTE_FILL_MIN = 0.30
PROFILE_SAMPLE = 500
# ---------------------------------------------------------------------------

# Role -> (candidate list, avoid list, penalty list) per table kind.
PR_ROLES = {
    "gstin": ("gstin_pr", None, "avoid_recipient_gstin_pr"),
    "invoice": ("invoice_pr", "avoid_doc_like_pr", None),
    "date": ("date_pr", None, None),
    "cgst": ("cgst_pr", None, None),
    "sgst": ("sgst_pr", None, None),
    "igst": ("igst_pr", None, None),
    "inv_type": ("inv_type", None, None),
}
PR_INVOICE_PENALTIES = ["company", "recipient", "gstin"]
B2_ROLES = {
    "invoice": ("invoice_2b", None, None),
    "gstin": ("gstin_2b", None, None),
    "date": ("date_2b", None, None),
    "cgst": ("cgst_2b", None, None),
    "sgst": ("sgst_2b", None, None),
    "igst": ("igst_2b", None, None),
    "note_no": ("note_no_2b", None, None),
    "note_date": ("note_date_2b", None, None),
    "note_type": ("note_type_2b", None, None),
    "inv_type": ("inv_type", None, None),
}
# Notes are found like invoices, under their own terms.
CDNR_ROLES = {**B2_ROLES, "gstin": ("gstin_cdnr", None, None)}
KIND_ROLES = {"PR": PR_ROLES, "2B": B2_ROLES, "CDNR": CDNR_ROLES}


def norm_term(s: str) -> str:
    """Header norm: lower, only [a-z0-9]."""
    return re.sub(r"[^a-z0-9]", "", s.strip().lower())


def _terms(list_name: str | None, extra: list[str] | None = None) -> list[str]:
    raw = (ROLE_LISTS[list_name] if list_name else []) + (extra or [])
    return [norm_term(t) for t in raw]


def header_norm(col: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(col)), "[^a-z0-9]", "")


def _any_contains(n: Column, terms: list[str]) -> Column:
    return n.rlike("(" + "|".join(sorted(set(terms))) + ")") if terms else F.lit(False)


def _any_starts(n: Column, terms: list[str]) -> Column:
    return n.rlike("^(" + "|".join(sorted(set(terms))) + ")") if terms else F.lit(False)


def role_score(n: Column, cands: list[str], avoid: list[str], penalties: list[str]) -> Column:
    """C2 score: +5 equal, +3 contains, +2 starts with (each once), +1 'inv',
    +1 'gst', -4 contains an avoid term, -3 contains a penalty term."""
    b = lambda c: c.cast("int")
    return (b(n.isin(*cands)) * 5 + b(_any_contains(n, cands)) * 3 + b(_any_starts(n, cands)) * 2
            + b(n.contains("inv")) + b(n.contains("gst"))
            - b(_any_contains(n, avoid)) * 4 - b(_any_contains(n, penalties)) * 3)


# ------------------------------------------------------------------- C1
def clean_headers(catalog: DataFrame) -> DataFrame:
    """Flatten two-level headers (drop empty, 'unnamed:*' and 'nan'
    parts, NBSP -> space, trim, join with a space); a flat header (no second
    part) keeps its name; soft name = collapsed whitespace, lower; the first
    column wins per soft name."""
    flat = F.col("part2").isNull()

    def part(c):
        s = F.trim(F.regexp_replace(F.col(c), N.NBSP, " "))
        keep = s.isNotNull() & (s != "") & (flat | (~F.lower(s).startswith("unnamed:") & (F.lower(s) != "nan")))
        return F.when(keep, s)

    col = F.concat_ws(" ", part("part1"), part("part2"))
    out = catalog.withColumn("column", col)
    soft = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.col("column"), N.NBSP, " "), r"\s+", " ")))
    return out.withColumn("soft", soft).withColumn("norm", header_norm(F.col("column")))


def soft_names(cleaned: DataFrame) -> DataFrame:
    """C1 soft map: soft name -> first original column (by position)."""
    return cleaned.groupBy("table_id", "soft").agg(F.min_by("column", "pos").alias("column"))


# ------------------------------------------------------------------- C2 / C3
def _explode_roles(cleaned: DataFrame, kind: str, roles: dict, extra_penalty: dict | None = None) -> DataFrame:
    n = F.col("norm")
    scored = []
    for role, (cand, avoid, pen) in roles.items():
        pens = _terms(pen) + [norm_term(x) for x in (extra_penalty or {}).get(role, [])]
        s = role_score(n, _terms(cand), _terms(avoid), pens)
        scored.append(F.struct(F.lit(role).alias("role"), s.alias("score")))
    return (cleaned.where(F.col("kind") == kind)
            .select("table_id", "pos", "column", F.explode(F.array(*scored)).alias("r"))
            .select("table_id", "pos", "column", "r.role", "r.score"))


def best_per_role(scored: DataFrame) -> DataFrame:
    """Best score wins, ties go to the earliest column; only scores > 0."""
    pick = F.struct(F.col("score"), (-F.col("pos")).alias("neg_pos"))
    return (scored.groupBy("table_id", "role")
            .agg(F.max_by("column", pick).alias("column"), F.max("score").alias("score"))
            .where(F.col("score") > 0))


def match_columns(cleaned: DataFrame, kinds: Sequence[str] = ("PR", "2B")) -> DataFrame:
    """C2 for every role of the table kinds: (table_id, kind, role, column, score)."""
    parts = [best_per_role(_explode_roles(cleaned, kind, KIND_ROLES[kind], {"invoice": PR_INVOICE_PENALTIES} if kind == "PR" else None))
             .withColumn("kind", F.lit(kind)) for kind in kinds]
    return reduce(DataFrame.unionByName, parts)


def _of_side(cleaned: DataFrame, kind: str) -> DataFrame:
    """The tables of one side: PR, or every 2B sheet."""
    return cleaned.where(F.col("kind") == "PR") if kind == "PR" else cleaned.where(F.col("kind") != "PR")


def pool_columns(cleaned: DataFrame, pools: Mapping[str, Sequence[Sequence[str]]], by_term: bool = False) -> DataFrame:
    """(table_id, role, column) from ordered pools of terms: the first pool
    with a hit gives the column, inside a pool the best score wins, then the
    earliest column.  Pool and score are one rank of one aggregation.

    ``by_term``: a header must hold a term of the pool; that it holds ``inv``
    or ``gst`` is no hit."""
    n = F.col("norm")

    def score(terms: list[str]) -> Column:
        points = role_score(n, terms, [], [])
        return F.when(_any_contains(n, terms), points).otherwise(0) if by_term else points

    scored = [F.struct(F.lit(role).alias("role"), F.lit(-k).alias("pool"), score([norm_term(t) for t in terms]).alias("score"))
              for role, lists in pools.items() for k, terms in enumerate(lists)]
    hits = cleaned.select("table_id", "pos", "column", F.explode(F.array(*scored)).alias("r")).where("r.score > 0")
    return hits.groupBy("table_id", F.col("r.role").alias("role")).agg(
        F.max_by("column", F.struct("r.pool", "r.score", -F.col("pos"))).alias("column"))


def match_by_regex(cleaned: DataFrame) -> DataFrame:
    """C4: first column whose name matches each fixed pattern (any case)."""
    hits = [F.struct(F.lit(k).alias("pattern"), F.col("column").rlike("(?i)" + p).alias("hit"))
            for k, p in REGEX_ROLES.items()]
    x = cleaned.select("table_id", "pos", "column", F.explode(F.array(*hits)).alias("h")).where("h.hit")
    return x.groupBy("table_id", F.col("h.pattern").alias("pattern")).agg(F.min_by("column", "pos").alias("column"))


def first_pool(cleaned: DataFrame) -> DataFrame:
    """C3 over the ordered pools of ``FIRST_POOLS`` (2B sheets); a tax column that no pool finds comes from the C4 pattern."""
    picks = pool_columns(_of_side(cleaned, "2B"), {r: [ROLE_LISTS[x] for x in lists] for r, lists in FIRST_POOLS.items()})
    rx = match_by_regex(cleaned).where(F.col("pattern").isin("igst", "cgst", "sgst")) \
        .select("table_id", F.col("pattern").alias("role"), F.col("column").alias("rx_column"))
    tables = _of_side(cleaned, "2B").select("table_id").distinct()
    roles = tables.select("table_id", F.explode(F.array(*[F.lit(r) for r in FIRST_POOLS])).alias("role"))
    out = roles.join(picks.select("table_id", "role", "column"), ["table_id", "role"], "left") \
        .join(rx, ["table_id", "role"], "left")
    return out.select("table_id", "role", F.coalesce("column", "rx_column").alias("column"))


# ------------------------------------------------------------------- C5 / C6 / C7
def match_by_keyword(cleaned: DataFrame) -> DataFrame:
    """ITC, reverse-charge and filing-date columns of 2B sheets (first hit by position)."""
    low = F.lower(F.trim(F.col("column")))
    n = F.regexp_replace(low, "[^a-z0-9]", "")
    rules = {
        "itc_availability": low.contains("itc availability"),
        "itc_available": low.contains("itc available"),
        "reverse_charge": low.contains("reverse charge") | low.contains("attract reverse charge"),
        "filing_date_exact": n.contains("date") & (n.contains("filing") | n.contains("gstr1") | n.contains("iff"))
        & ~n.contains("period"),
        "filing_date_loose": low.contains("filing") & low.contains("date") & ~low.contains("period"),
    }
    hits = [F.struct(F.lit(k).alias("rule"), v.alias("hit")) for k, v in rules.items()]
    x = _of_side(cleaned, "2B").select("table_id", "pos", "column", F.explode(F.array(*hits)).alias("h")) \
        .where("h.hit")
    firsts = x.groupBy("table_id").pivot("h.rule", list(rules)).agg(F.min_by("column", "pos"))
    return firsts.select(
        "table_id",
        F.coalesce("itc_availability", "itc_available").alias("itc_column"),
        F.col("reverse_charge").alias("reverse_charge_column"),
        F.coalesce("filing_date_exact", "filing_date_loose").alias("filing_date_column"),
        F.col("filing_date_loose").alias("prior_period_filing_column"))


def match_import_type(cleaned: DataFrame) -> DataFrame:
    """Type column of a sheet: C2 on the type terms, else the first name
    with 'type' and one of purchase / trans / nature."""
    terms = [norm_term(t) for t in IMPORT_TYPE_TERMS]
    n = F.col("norm")
    s = role_score(n, terms, [], [])
    picked = best_per_role(cleaned.select("table_id", "pos", "column", F.lit("type").alias("role"), s.alias("score")))
    low = F.lower(F.col("column"))
    fb = cleaned.where(low.contains("type") & (low.contains("purchase") | low.contains("trans") | low.contains("nature"))) \
        .groupBy("table_id").agg(F.min_by("column", "pos").alias("fallback"))
    tables = cleaned.select("table_id").distinct()
    return tables.join(picked.select("table_id", "column"), "table_id", "left").join(fb, "table_id", "left") \
        .select("table_id", F.coalesce("column", "fallback").alias("type_column"))


def _name_score(n: Column, cands: list[str], period_bonus: bool) -> Column:
    b = lambda c: c.cast("int")
    s = b(n.isin(*cands)) * 4 + b(_any_contains(n, cands)) * 2 + b(n.contains("name"))
    if period_bonus:
        return s + b(n.contains("period")) * 3
    return s - b(n.contains("date") | n.contains("period") | n.contains("month")) * 10


def match_name_column(cleaned: DataFrame) -> DataFrame:
    """Vendor-name column (both kinds) and filing-status column (2B).
    Names and candidates carry the side suffix, as in the pair table."""
    out = []
    for kind, suffix, lists, role, bonus in (
        ("PR", "_PR", ["vendor_name_pr"], "vendor_name", False),
        ("2B", "_2B", ["trade_name_2b", "vendor_name_pr"], "vendor_name", False),
        ("2B", "_2B", ["gstr1_status_2b"], "filing_status", True),
    ):
        cands = [norm_term(t + suffix) for lst in lists for t in ROLE_LISTS[lst]]
        n = header_norm(F.concat(F.col("column"), F.lit(suffix)))
        s = _name_score(n, cands, bonus)
        scored = _of_side(cleaned, kind).select("table_id", "pos", "column", F.lit(role).alias("role"), s.alias("score"))
        out.append(best_per_role(scored))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res.select("table_id", "role", "column", "score")


# ------------------------------------------------------------------- W3 / C8 / C9
def first_n_per_column(cells: DataFrame, n: int = PROFILE_SAMPLE) -> DataFrame:
    """The first ``n`` present values of every column, trimmed."""
    present = cells.where(F.col("value").isNotNull()).withColumn("value", N.trimmed("value"))
    return first_n_per_group(present, ["table_id", "pos"], [F.col("row_no")], n, salt_from=["row_no"])


def present_values(cells: DataFrame, cleaned: DataFrame, kind: str = "PR") -> DataFrame:
    """(table_id, pos, value): every present value, trimmed, of the tables of one kind."""
    tables = cleaned.where(F.col("kind") == kind).select("table_id").distinct()
    present = cells.where(F.col("value").isNotNull()).join(tables, "table_id", "left_semi")
    return present.select("table_id", "pos", N.trimmed("value").alias("value"))


def invoice_like(v: Column) -> Column:
    return (~v.rlike("(?i)" + N.GSTIN_PATTERN) & (F.length(v) >= 1) & (F.length(v) <= 30)
            & ~v.rlike("^[A-Za-z]+$") & ~v.rlike("^0+$") & ~v.rlike(r"^[-/\.]+$") & v.rlike(r"\d"))


def profile_shares(sample: DataFrame) -> DataFrame:
    """Share of GSTIN-like and invoice-like values per column, one aggregation."""
    n = F.count(F.lit(1))
    return sample.groupBy("table_id", "pos").agg(
        (F.sum(F.col("value").rlike("(?i)" + N.GSTIN_PATTERN).cast("int")) / n).alias("gstin_share"),
        (F.sum(invoice_like(F.col("value")).cast("int")) / n).alias("invoice_share"))


def _shares(sample_or_shares: DataFrame) -> DataFrame:
    if "gstin_share" in sample_or_shares.columns:
        return sample_or_shares
    return profile_shares(sample_or_shares)


def profile_gstin(cleaned: DataFrame, sample: DataFrame, prefer_supplier: bool = True) -> DataFrame:
    """Column whose values look most like GSTINs (> 0 wins, first on ties).
    ``sample`` may be the values or their ``profile_shares``."""
    share = _shares(sample).select("table_id", "pos", F.col("gstin_share").alias("share"))
    j = share.join(cleaned.select("table_id", "pos", "column", "norm"), ["table_id", "pos"])
    n = F.col("norm")
    adj = F.col("share")
    if prefer_supplier:
        adj = adj + F.when(_any_contains(n, SUPPLIER_WORDS), F.lit(0.2)).otherwise(F.lit(0.0))
    adj = adj - F.when(_any_contains(n, NOT_SUPPLIER_WORDS), F.lit(0.2)).otherwise(F.lit(0.0))
    scored = j.where(F.col("share") > 0).select("table_id", "pos", "column", F.lit("gstin").alias("role"),
                                               adj.alias("score"))
    return best_per_role(scored)


def profile_invoice(cleaned: DataFrame, sample: DataFrame) -> DataFrame:
    """Column whose values look most like invoice numbers,
    skipping names about tax ids, amounts, parties and dates."""
    share = _shares(sample).select("table_id", "pos", F.col("invoice_share").alias("share"))
    names = cleaned.where(~_any_contains(F.col("norm"), INVOICE_SKIP_WORDS)).select("table_id", "pos", "column")
    scored = share.join(names, ["table_id", "pos"]).select("table_id", "pos", "column", F.lit("invoice").alias("role"),
                                                          F.col("share").alias("score"))
    return best_per_role(scored)


# ------------------------------------------------------------------- C10 / C11 / C12
def derived_selections(cleaned: DataFrame) -> DataFrame:
    """What people typed in the column chooser for the derived uploads: every
    fourth purchase-register table names its invoice column with odd spacing."""
    t = cleaned.where((F.col("kind") == "PR") & (F.pmod("table_id", F.lit(4)) == 1)).select("table_id").distinct()
    return t.select("table_id", F.lit("invoice").alias("role"), F.lit("  bill   NO ").alias("choice"))


def resolve_roles(cleaned: DataFrame, sample: DataFrame, selections: DataFrame | None = None,
                  kinds: Sequence[str] = ("PR", "2B")) -> DataFrame:
    """person's choice (soft-name equal) -> C2 -> value profile (gstin,
    invoice of the purchase register); of notes the C4 patterns win over all.

    ``selections`` is (table_id, role, choice); without it the choices of the
    derived uploads count.  Values are read of the tables only in which
    neither a choice nor a name tells the column."""
    c2 = match_columns(cleaned, kinds).select("table_id", "kind", "role", F.col("column").alias("by_name"))
    sel = derived_selections(cleaned) if selections is None else selections
    soft_choice = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.col("choice"), N.NBSP, " "), r"\s+", " ")))
    chosen = (sel.withColumn("soft", soft_choice)
              .join(soft_names(cleaned), ["table_id", "soft"], "inner")
              .select("table_id", "role", F.col("column").alias("by_choice")))
    rx = match_by_regex(cleaned).where(F.col("pattern").isin("note_number", "note_date")).select(
        "table_id", F.when(F.col("pattern") == "note_number", F.lit("note_no")).otherwise(F.lit("note_date"))
        .alias("role"), F.col("column").alias("by_pattern"))
    tables = cleaned.select("table_id", "kind").distinct()
    roles_of = reduce(lambda e, kind: e.when(F.col("kind") == kind, F.array(*[F.lit(r) for r in KIND_ROLES[kind]])), kinds, F)
    grid = tables.select("table_id", "kind", F.explode(roles_of).alias("role"))
    named = (grid.join(c2, ["table_id", "kind", "role"], "left").join(chosen, ["table_id", "role"], "left"))
    unknown = named.where((F.col("kind") == "PR") & F.col("role").isin("gstin", "invoice")
                          & F.coalesce("by_choice", "by_name").isNull()).select("table_id").distinct()
    shares = profile_shares(sample.join(unknown, "table_id", "left_semi"))
    gv = profile_gstin(cleaned.where(F.col("kind") == "PR"), shares).select(
        "table_id", F.lit("gstin").alias("role"), F.col("column").alias("by_value"))
    iv = profile_invoice(cleaned.where(F.col("kind") == "PR"), shares).select(
        "table_id", F.lit("invoice").alias("role"), F.col("column").alias("by_value"))
    out = (named.join(gv.unionByName(iv), ["table_id", "role"], "left").join(rx, ["table_id", "role"], "left"))
    col = F.coalesce("by_pattern", "by_choice", "by_name", F.when(F.col("kind") == "PR", F.col("by_value")))
    return out.select("table_id", "kind", "role", col.alias("column"))


def best_note_column(cleaned: DataFrame, cells: DataFrame, resolved: DataFrame) -> DataFrame:
    """C11: when the note-number column is missing or under 30% filled, the
    fullest column whose name is exactly a note-number candidate."""
    filled = cells.groupBy("table_id", "pos").agg(
        F.avg((N.trimmed("value") != "").cast("double")).alias("fill"))
    cols = cleaned.select("table_id", "pos", "column").join(filled, ["table_id", "pos"], "left") \
        .withColumn("fill", F.coalesce("fill", F.lit(0.0)))
    primary = resolved.where(F.col("role") == "note_no").select("table_id", F.col("column").alias("primary"))
    pfill = primary.join(cols.select("table_id", F.col("column").alias("primary"), F.col("fill").alias("pfill")),
                         ["table_id", "primary"], "left")
    cand_rank = F.array_position(F.array(*[F.lit(t) for t in ROLE_LISTS["note_no_2b"]]), F.col("column"))
    exact = cols.where(cand_rank > 0).where(F.col("fill") > 0).groupBy("table_id").agg(
        F.max_by("column", F.struct(F.col("fill"), (-cand_rank).alias("r"))).alias("fullest"))
    out = pfill.join(exact, "table_id", "left")
    need = F.col("primary").isNull() | (F.coalesce(F.col("pfill"), F.lit(0.0)) < NOTE_FILL_MIN)
    return out.select("table_id", "primary", F.when(need, F.coalesce("fullest", "primary"))
                      .otherwise(F.col("primary")).alias("note_column"))


NUMERIC_POOLS = {"2B": ["taxable_2b", "total_tax_2b", "invoice_value_2b", "cess_2b"],
                 "PR": ["taxable_pr", "total_tax_pr", "invoice_value_pr", "cess_pr"]}


#: The amounts the pools stand for, in their order.
AMOUNT_ROLES = ["taxable", "total_tax", "invoice_value", "cess"]


def amount_columns(cleaned: DataFrame, by_term: bool = False) -> DataFrame:
    """(table_id, role, column) of the amounts besides the three taxes, as far as a table has them."""
    parts = [pool_columns(_of_side(cleaned, kind), {role: [ROLE_LISTS[lst]] for role, lst in zip(AMOUNT_ROLES, lists)}, by_term)
             for kind, lists in NUMERIC_POOLS.items()]
    return reduce(DataFrame.unionByName, parts)


def numeric_roles(cleaned: DataFrame, resolved: DataFrame) -> DataFrame:
    """The columns to sum: first hit of each amount pool, then the three
    tax columns when not already listed."""
    place = F.array_position(F.array(*[F.lit(a) for a in AMOUNT_ROLES]), F.col("role")).cast("int") - 1
    pools = amount_columns(cleaned).select("table_id", place.alias("k"), "column")
    taxes = resolved.where(F.col("role").isin("cgst", "sgst", "igst")).where(F.col("column").isNotNull()).select(
        "table_id", F.when(F.col("role") == "cgst", F.lit(4)).when(F.col("role") == "sgst", F.lit(5))
        .otherwise(F.lit(6)).alias("k"), "column")
    allc = pools.unionByName(taxes)
    firsts = allc.groupBy("table_id", "column").agg(F.min("k").alias("k"))
    return firsts.groupBy("table_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "column"))), lambda x: x["column"]), " | ")
        .alias("numeric_columns"))


def role_dictionary_usage(cleaned: DataFrame) -> DataFrame:
    """Every dictionary term with the number of catalog columns whose
    header norm equals it."""
    rows = [(lst, i, t, norm_term(t)) for lst, terms in ROLE_LISTS.items() for i, t in enumerate(terms)]
    spark = cleaned.sparkSession
    d = spark.createDataFrame(rows, "list_name string, pos int, term string, norm_term string")
    counts = cleaned.groupBy(F.col("norm").alias("norm_term")).agg(F.count(F.lit(1)).alias("n_columns"))
    return d.join(counts, "norm_term", "left").select(
        "list_name", "pos", "term", "norm_term", F.coalesce("n_columns", F.lit(0)).cast("bigint").alias("n_columns"))


# ------------------------------------------------------------------- roles to rows
def all_roles(cleaned: DataFrame, cells: DataFrame, selections: DataFrame) -> DataFrame:
    """(table_id, role, pos): the place of every role's column in every table, for tables of the kinds PR, 2B and CDNR.

    C10 with the choices handed in, C11 for the note column, C5-C7 and C12
    for the columns that nobody chooses.  In a note table the note's number
    and date stand for the invoice's.  ``cells`` is (table_id, pos, value).
    Headers and found roles (a row per column or role) are read several times,
    so they are written once.
    """
    kinds = tuple(KIND_ROLES)
    cleaned = materialize(cleaned, "headers")
    resolved = materialize(resolve_roles(cleaned, present_values(cells, cleaned), selections, kinds).where("column is not null"), "resolved")
    notes = cleaned.where(F.col("kind") == "CDNR")
    best = best_note_column(notes, cells.join(notes.select("table_id").distinct(), "table_id", "left_semi"),
                            resolved.where(F.col("kind") == "CDNR")).select("table_id", F.lit("note_no").alias("role"), F.col("note_column").alias("column"))
    mine = resolved.where(~((F.col("kind") == "CDNR") & F.col("role").isin("note_no", "invoice", "date"))).select("table_id", "role", "column")
    as_invoice = F.when(F.col("role") == "note_no", F.lit("invoice")).when(F.col("role") == "note_date", F.lit("date")).otherwise(F.col("role"))
    roles = materialize(mine.unionByName(best).join(cleaned.select("table_id", "kind").distinct(), "table_id").select(
        "table_id", F.when(F.col("kind") == "CDNR", as_invoice).otherwise(F.col("role")).alias("role"), "column"), "roles")
    named = match_name_column(cleaned).select(
        "table_id", F.when(F.col("role") == "vendor_name", F.lit("name")).otherwise(F.lit("filing_period")).alias("role"), "column")
    words = match_by_keyword(cleaned).select("table_id", F.expr(
        "stack(3, 'itc', itc_column, 'reverse_charge', reverse_charge_column, 'filing_date', filing_date_column) as (role, column)"))
    types = match_import_type(cleaned).select("table_id", F.lit("import_type").alias("role"), F.col("type_column").alias("column"))
    # a column that is summed is not a key, a date or one of the three taxes as well
    amounts = amount_columns(cleaned, by_term=True).join(roles.select("table_id", "column"), ["table_id", "column"], "left_anti")
    every = reduce(DataFrame.unionByName, [roles, named, words, types, amounts]).where("column is not null")
    places = cleaned.groupBy("table_id", "column").agg(F.min("pos").alias("pos"))
    return every.join(places, ["table_id", "column"]).select("table_id", "role", "pos")


def role_maps(roles: DataFrame) -> DataFrame:
    """(table_id, roles MAP<role, pos>): one row a table."""
    return roles.groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "pos"))).alias("roles"))


def land(rows: DataFrame, maps: DataFrame, landing: Mapping[str, str]) -> DataFrame:
    """The cells of any number of tables under the landing columns, by each table's own map.

    ``rows`` has (table_id, cells, ...); ``landing`` names the column of a
    role.  The maps are one row a table: AQE broadcasts them by their bytes
    or splits a large table's partition.
    """
    cell = {c: F.get("cells", F.try_element_at("roles", F.lit(role))) for role, c in landing.items()}
    return rows.join(maps, "table_id").select(*[c for c in rows.columns if c != "cells"], *[v.alias(c) for c, v in cell.items()])
