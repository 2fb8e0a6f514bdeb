"""Scalar rules against the value fixtures (FIXTURES.md section 4)."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerweave.functions import normalize as N


def _eval(spark, values, expr_fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(expr_fn(F.col("v"))).collect()]


INVOICE_CASES = [
    ("699/25-26", "699"), ("2025-2026/699", "699"), ("FY-2025-2026/7", "7"), ("INV/2025-2026", "INV"),
    ("INV/20252026", "INV"), ("INV-01-02", "INV"), ("INV/2012234", "INV"), ("FY25-26/699", "FY25-26/699"),
    ("2025-26/699", "2025-26/699"), ("INV/2025-26", "INV/2025-26"), ("2425-2526/1", "2425-2526/1"),
    ("225-226/9", "9"), ("000123", "123"), ("000", "0"), ("00A1", "A1"), ("0ABC", "ABC"), ("ab c/24-25", "ABC"),
    ("/25-26", ""),
]


def test_invoice_key(spark):
    got = _eval(spark, [a for a, _ in INVOICE_CASES], N.norm_invoice)
    assert got == [b for _, b in INVOICE_CASES]


def test_invoice_key_stepwise_equals_single_expression(spark):
    df = spark.createDataFrame([(a,) for a, _ in INVOICE_CASES], "v string")
    step = N.with_invoice_key(df.select(N.norm_text("v").alias("t")), "t", "k")
    assert [r.k for r in step.collect()] == [b for _, b in INVOICE_CASES]


def test_amounts(spark):
    cases = [("₹1,234.50", "1234.50"), ("(100)", "100.00"), ("100-", "0.00"), ("1e3", "1000.00"),
             ("1,00,000.0", "100000.00"), ("--5", "0.00"), ("1.2.3", "0.00"), ("nan", "0.00"), (None, "0.00"),
             ("2.675", "2.68"), ("1e17", "100000000000000000.00"), ("12345678901234567.89", "12345678901234567.89"),
             ("99999999999999999", "99999999999999999.00")]
    got = _eval(spark, [a for a, _ in cases], N.parse_amount)
    assert got == [Decimal(b) for _, b in cases]


def test_rupee_half_even(spark):
    got = _eval(spark, ["0.5", "1.5", "2.5", "-2.5"], lambda c: N.round_rupee(c.cast("decimal(18,2)")))
    assert got == [0, 2, 2, -2]


def test_dates(spark):
    cases = ["05-01-2024", "5/1/2024", "2024-01-05", "2024-01-05 00:00:00", "05-Jan-2024", "45292", "2024",
             "31-02-2024", ""]
    got = _eval(spark, cases, N.parse_date)
    d = datetime.date
    assert got == [d(2024, 1, 5)] * 5 + [d(2024, 1, 1), d(1905, 7, 16), None, None]


def test_date_layouts(spark):
    d = datetime.date(2024, 1, 5)
    cases = ["05-01-2024 00:00:00", "05/01/2024 10:30", "2024-01-05T00:00:00", "2024-01-05T10:30:00.250Z",
             "05-January-2024", "5 January 2024", "Jan 5, 2024", "January 5, 2024", "05-Jan-24", "2024/1/5"]
    assert _eval(spark, cases, N.parse_date) == [d] * len(cases)
    assert _eval(spark, ["Q1", "31/02/2024 10:00", "12:30", " "], N.parse_date) == [None] * 4


def test_month_layouts(spark):
    cases = ["012024", "202401", "15-Jan-2024", "2024-01-05", "Jan 2024", "January-2024", "01/2024", "2024-01",
             "Return 012024", "05/01/2024"]
    assert _eval(spark, cases, N.parse_month) == [datetime.date(2024, 1, 1)] * len(cases)
    assert _eval(spark, ["132024", "soon", ""], N.parse_month) == [None] * 3


def test_unicode_white_space(spark):
    assert _eval(spark, ["\u2003INV1\u3000", "\u2028INV1\x85", "I\u2009N V\u00a01"], N.norm_invoice) == ["INV1"] * 3
    assert _eval(spark, ["07AABC\u2009S0001F1ZA\u202f"], N.norm_gstin) == ["07AABCS0001F1ZA"]


def test_numbers_keep_their_decimals(spark):
    got = _eval(spark, ["0.125", "1,234.5", " NaN", "x", None, "\u20037\u3000"], N.coerce_number)
    assert got == [Decimal("0.125"), Decimal("1234.5"), 0, 0, 0, 7]


def test_totals_beyond_sixteen_digits(spark):
    from ledgerweave.operators.dashboard import sum_column

    df = spark.range(200).select(F.lit("x").alias("k"), F.lit("100000000000000.25").cast(N.MONEY).alias("v"))
    assert sum_column(df, ["v"], ["k"]).first().sum_v == Decimal("20000000000000050.00")


def test_note_type_names_the_invoice_type(spark):
    from ledgerweave.operators.pairing import invoice_type

    rows = [(None, None, "Credit Note (R)", "B2B-CDNR", False), (None, "", "debit", "B2B-CDNR", True),
            (None, "Regular", "debit", "B2B-CDNR", True), ("Bill", None, "credit", "B2B", True), (None, None, None, "B2B", False)]
    df = spark.createDataFrame(rows, "pr_doc_type string, b2_inv_type string, b2_note_type string, sheet string, pr_exists boolean")
    assert [r.invoice_type for r in invoice_type(df).collect()] == ["Credit Note", "Debit Note", "Regular", "Bill", "Invoice"]


def test_fuzzy_keys(spark):
    assert _eval(spark, ["07abozilb"], N.fuzzy_gstin) == ["07A802118"]
    assert _eval(spark, ["inv/25-26 .01"], N.fuzzy_invoice) == ["INV252601"]


def test_norm_text(spark):
    cases = [(" 1,234.00 ", "1234"), (" INV/1 ", "INV/1"), (None, ""), ("12.50", "12.50"), ("A.0", "A")]
    assert _eval(spark, [a for a, _ in cases], N.norm_text) == [b for _, b in cases]


def test_gstin_rules(spark):
    assert _eval(spark, [" 07aabcs0001f1z7 ", "07AABCS0001F1ZZ9", None], N.is_gstin) == [True, False, False]
    assert _eval(spark, ["07 aabcs0001F1Z7"], N.norm_gstin) == ["07AABCS0001F1Z7"]


def test_tax_period(spark):
    d = datetime.date
    df = spark.createDataFrame([(d(2024, 1, 12),), (d(2024, 1, 11),), (None,)], "v date")
    got = [r[0] for r in df.select(N.tax_period_text("v")).collect()]
    assert got == ["Jan 2024", "Dec 2023", ""]


def test_row_list(spark):
    from ledgerweave.operators.consolidate import row_numbers_by_key

    df = spark.createDataFrame([("G", "I", 10), ("G", "I", 9), ("G", "I", 2)], "gst_key string, inv_key string, row_no bigint")
    assert row_numbers_by_key(df, "rows").collect()[0]["rows"] == "2, 9, 10"
