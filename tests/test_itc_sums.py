"""The sums behind table 4: three a key and combination of answers, and 2B cells made only where they are asked for."""

import datetime
from decimal import Decimal

import pytest

from conftest import SF_SMALL
from ledgerweave.operators import itc
from ledgerweave.operators import lines as L
from ledgerweave.plans.reconcile import get_run

DAY = datetime.date(2024, 1, 20)
LINES = [  # gst_key, inv_key, sheet, is_import, rcm_yes, itc_no, filing_date, inv_date, igst, cgst, sgst
    ("G1", "1", "B2B", False, True, False, DAY, DAY, 1, 2, 3), ("G1", "1", "B2B", False, False, True, None, DAY, 10, 20, 30),
    ("G1", "1", "B2B-CDNR", False, False, False, None, None, -4, -5, -6), ("G2", "2", "B2B", True, False, False, DAY, DAY, 100, 0, 0),
    ("G2", "2", "IMPG", False, False, False, None, DAY, 1000, 0, 0), ("G2", "2", "B2B", False, False, False, DAY, DAY, 7, 8, 9),
    ("", "", "B2B", False, False, True, DAY, DAY, 70, 80, 90), (None, "3", "B2B-CDNR", False, True, True, DAY, None, 5, 5, 5),
]


@pytest.fixture(scope="module")
def books(spark):
    money = "decimal(38,2)"
    schema = ("gst_key string, inv_key string, sheet string, is_import boolean, rcm_yes boolean, itc_no boolean, filing_date date, "
              f"inv_date date, igst {money}, cgst {money}, sgst {money}")
    lines = spark.createDataFrame([(*r[:8], *map(Decimal, r[8:])) for r in LINES * 3], schema)
    status = spark.createDataFrame([("G1", "1", "Not Matched"), ("G2", "2", "Matched")], "gst_key string, inv_key string, mapping string")
    return lines, status


def test_sums_equal_plain_python(books):
    got = itc.filtered_sums(*books, "2024-03").first().asDict()
    on = {"b2b": lambda r: r[2] == "B2B" and not r[3], "cdnr": lambda r: r[2] == "B2B-CDNR"}
    keep = {"all": lambda r: True, "rcm_yes": lambda r: r[4], "itc_no": lambda r: r[5],
            "prior": lambda r: (r[6] or r[7]) is not None}
    want = {"imp_igst": 3 * sum(r[8] for r in LINES if r[2] == "IMPG" or (r[2] == "B2B" and r[3]))}
    for s, at in on.items():
        for f, ok in keep.items():
            for i, t in enumerate(itc.TAXES):
                want[f"{s}_{f}_{t}"] = 3 * sum(r[8 + i] for r in LINES if at(r) and ok(r))
                if f != "prior":
                    want[f"nm_{s}_{f}_{t}"] = 3 * sum(r[8 + i] for r in LINES if at(r) and ok(r) and r[0] == "G1")
    assert got == {k: Decimal(v) for k, v in want.items()}


def test_a_key_sends_three_sums(books):
    per_key = itc.per_key_sums(books[0], "2024-03")
    assert [f.name for f in per_key.schema if f.dataType.typeName() == "decimal"] == itc.TAXES


def test_an_amount_of_b2b_needs_no_other_cell(spark):
    """No projection makes the cell (the filter on blank rows names it, but stops at the first cell that is there)."""
    plan = get_run(spark, SF_SMALL).b2_lines.where("sheet = 'B2B'").select("cgst")._jdf.queryExecution().optimizedPlan().toString()
    assert "AS filing_period" not in plan and "AS trade_name" not in plan


def test_both_forms_of_the_2b_landing_have_the_same_rows(spark):
    from ledgerweave.sources import derived as D

    lines = get_run(spark, SF_SMALL).lines
    one, two = D.b2_landing(lines), D.b2_landing(lines, by_sheet=False)
    assert one.columns == two.columns and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


@pytest.mark.parametrize("text, hit", [("\u2003IMPORT of goods ", True), (" ", False), (None, False), ("Overseas\t", True), ("Local", False)])
def test_import_wording(spark, text, hit):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(L.is_import(df.t)).first()[0] is hit
