"""Books handed in by a caller: layouts, column choices, missing sheets."""

import pytest
from pyspark.sql import functions as F

from ledgerweave.plans.given import reconcile, resolve_columns, sheet_from_rows


def _rows(spark, cells):
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(cells)], "row_no long, cells array<string>")


PR = [["GST of party", "Inv ref", "Our GSTIN", "Bill Date", "CGST", "SGST", "IGST", "Taxable Value"],
      ["07AAACS0001F1ZA", "INV/1", "29AABCB0000A1Z5", "05-01-2024", "5", "5", "0", "100"],
      ["07AAACS0001F1ZA", "INV/2", "29AABCB0000A1Z5", "2024-01-06", "0", "0", "18", "100"]]
PORTAL = [["GSTR-2B"], [None], ["Supplies"], [None],
          ["GSTIN of supplier", "Invoice details", "Invoice details", "Tax Amount", "Tax Amount", "Tax Amount"],
          ["Unnamed: 0_level_1", "Invoice number", "Invoice Date", "Integrated Tax(₹)", "Central Tax(₹)", "State/UT Tax(₹)"],
          ["07AAACS0001F1ZA", "INV/1", "05-01-2024", "0", "5", "5"], ["07AAACS0001F1ZA", "INV/9", "07-01-2024", "1", "0", "0"]]


def test_layouts(spark):
    pr = sheet_from_rows(_rows(spark, PR), "flat")
    assert pr.columns == ["row_no", *PR[0]] and [r.row_no for r in pr.orderBy("row_no").collect()] == [2, 3]
    b2 = sheet_from_rows(_rows(spark, PORTAL), "portal")
    assert b2.columns == ["row_no", "GSTIN of supplier", "Invoice details Invoice number", "Invoice details Invoice Date",
                          "Tax Amount Integrated Tax(₹)", "Tax Amount Central Tax(₹)", "Tax Amount State/UT Tax(₹)"]
    assert [r.row_no for r in b2.orderBy("row_no").collect()] == [7, 8]


def test_given_books_are_reconciled(spark):
    pr, b2b = sheet_from_rows(_rows(spark, PR), "flat"), sheet_from_rows(_rows(spark, PORTAL), "portal")
    run = reconcile(pr, {"B2B": b2b}, choices={"PR": {"invoice": " inv  REF", "gstin": "GST of party"}})
    assert run.roles["PR"]["invoice"] == "Inv ref" and run.roles["PR"]["gstin"] == "GST of party"
    assert sorted((r.inv_key, r.sheet, r.mapping) for r in run.pairs.collect()) == [
        ("INV/1", "B2B", "Matched"), ("INV/2", None, "Not Matched"), ("INV/9", "B2B", "Not Matched")]
    with pytest.raises(ValueError, match="no sheet B2B"):
        reconcile(pr, {"B2B-CDNR": b2b})


def test_columns_found_by_values(spark):
    df = spark.createDataFrame([(i, f"07AAACS{i:04d}F1ZA", f"B-{i}x", "text") for i in range(20)],
                               "row_no long, c1 string, c2 string, c3 string")
    found = resolve_columns(df, "PR")
    assert found["gstin"] == "c1" and found["invoice"] == "c2"


def test_given_derived_books_give_the_same_pairs(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL

    got = E.queries()["reconcile_given"](spark, SF_SMALL)
    want = E.queries()["recon_projection"](spark, SF_SMALL).select("gst_key", "inv_key", "mapping", "remarks", "reason")
    assert got.select(*want.columns).exceptAll(want).count() == 0 and want.exceptAll(got.select(*want.columns)).count() == 0
    assert got.where(F.col("mapping") == "Matched").count() > 0


def _sheet(spark, head, *rows):
    return sheet_from_rows(_rows(spark, [head, *rows]), "flat")


G = "07AAACS0001F1ZA"
B2B_HEAD = ["GSTIN of supplier", "Invoice number", "Invoice Date", "Central Tax", "State Tax", "Integrated Tax", "Taxable Value"]
NOTE_HEAD = ["GSTIN of supplier", "Note number", "Note date", "Central Tax", "State Tax", "Integrated Tax", "Taxable Value"]


def test_a_note_without_a_date_takes_its_invoices(spark):
    """The CDNR part of a key has no date, its B2B sibling has."""
    pr = _sheet(spark, ["Supplier GSTIN", "Bill No", "Bill Date", "CGST", "SGST", "IGST", "Taxable Value"],
                [G, "INV/1", "05-01-2024", "5", "5", "0", "100"])
    b2b = _sheet(spark, B2B_HEAD, [G, "INV/1", "05-01-2024", "5", "5", "0", "100"])
    cdnr = _sheet(spark, NOTE_HEAD, [G, "INV/1", None, "5", "5", "0", "100"])
    pairs = {r.sheet: r for r in reconcile(pr, {"B2B": b2b, "B2B-CDNR": cdnr}).pairs.collect()}
    assert str(pairs["B2B-CDNR"].b2_date) == "2024-01-05"
    assert pairs["B2B-CDNR"].mapping == "Matched" and pairs["B2B"].mapping == "Matched"


def test_columns_of_notes_and_amounts(spark):
    """The note pattern wins over a choice, a sparse note column gives way to the fullest, optional amounts are summed."""
    pr = _sheet(spark, ["Supplier GSTIN", "Bill No", "Bill Date", "CGST", "SGST", "IGST", "Taxable Value", "Cess Amount"],
                [G, "CN1", "05-01-2024", "0", "0", "0", "100", "1.5"], [G, "CN1", "05-01-2024", "0", "0", "0", "100", "2"])
    b2b = _sheet(spark, [*B2B_HEAD, "Total Tax"], [G, "I1", "05-01-2024", "0", "0", "0", "1", "7"])
    cdnr = _sheet(spark, [*NOTE_HEAD, "Ref number"], [G, "CN1", "05-01-2024", "0", "0", "0", "200", "R9"])
    run = reconcile(pr, {"B2B": b2b, "B2B-CDNR": cdnr}, choices={"B2B-CDNR": {"note_no": "Ref number"}})
    assert run.roles["B2B-CDNR"]["invoice"] == "Note number" and run.roles["PR"]["cess"] == "Cess Amount"
    got = {(r.inv_key, r.sheet): r for r in run.pairs.collect()}
    assert float(got["CN1", "B2B-CDNR"].pr_cess) == 3.5 and got["CN1", "B2B-CDNR"].pr_total_tax is None
    assert float(got["I1", "B2B"].b2_total_tax) == 7
    sparse = _sheet(spark, ["GSTIN", "Note Number", "note no", "Note Date"], *[[G, None, f"C{i}", "05-01-2024"] for i in range(9)])
    assert resolve_columns(sparse, "2B", "B2B-CDNR")["invoice"] == "note no"


def test_tax_period_of_given_sheets(spark):
    """Of the filing date if the sheet has that column, else of the invoice date; an empty sheet has no roles."""
    pr = _sheet(spark, ["Supplier GSTIN", "Bill No", "Bill Date", "CGST", "SGST", "IGST", "Taxable Value"], [G, "I1", "05-01-2024", "0", "0", "0", "1"])
    plain = _sheet(spark, B2B_HEAD, [G, "I1", "05-01-2024", "0", "0", "0", "1"])
    filed = _sheet(spark, [*B2B_HEAD, "GSTR-1 Filing Date"], [G, "I1", "05-01-2024", "0", "0", "0", "1", "12-03-2024"], [G, "I2", "05-01-2024", "0", "0", "0", "1", None])
    empty = _sheet(spark, NOTE_HEAD)
    one = reconcile(pr, {"B2B": plain, "B2B-CDNR": empty})
    assert one.roles["B2B-CDNR"] == {} and [r.tax_period for r in one.b2b_comments.collect()] == ["Dec 2023"]
    assert one.cdnr_comments.count() == 0 and one.itc.count() == 13
    two = reconcile(pr, {"B2B": filed})
    assert {r.inv_key: r.tax_period for r in two.b2b_comments.collect()} == {"I1": "Mar 2024", "I2": ""}
    assert set(two.report()) == {"dashboard", "itc", "reconciliation", "pr_comments", "b2b_comments", "cdnr_comments"}


def test_runs_with_the_same_keys_stay_apart(spark):
    from ledgerweave.plans.given import Uploads

    heads = {"PR": ["Supplier GSTIN", "Bill No", "Bill Date", "CGST", "SGST", "IGST"], "2B": B2B_HEAD[:6]}
    catalog, rows = [], []
    for run in range(3):  # the same invoice; in run 1 the 2B side has it with another tax, in run 2 not at all
        for k, kind in enumerate(("PR", "2B")):
            order = list(range(6)) if run % 2 == 0 else [5, 3, 1, 0, 2, 4]
            catalog += [(2 * run + k, run, kind, p, heads[kind][i], None) for p, i in enumerate(order)]
            tax = "9" if kind == "2B" and run == 1 else "5"
            cells = [G, "INV/1" if kind == "PR" or run < 2 else "X7", "05-01-2024", tax, "5", "0"]
            rows.append((2 * run + k, 2, [cells[i] for i in order]))
    up = Uploads(spark.createDataFrame(catalog, "table_id long, run_id long, kind string, pos int, part1 string, part2 string"),
                 spark.createDataFrame(rows, "table_id long, row_no long, cells array<string>"),
                 spark.createDataFrame([], "table_id long, role string, choice string"))
    got = sorted((r.run_id, r.inv_key, r.mapping, r.reason) for r in up.pairs.collect())
    assert got == [(0, "INV/1", "Matched", ""), (1, "INV/1", "Almost Matched", "CGST"), (2, "INV/1", "Not Matched", ""), (2, "X7", "Not Matched", "")]
