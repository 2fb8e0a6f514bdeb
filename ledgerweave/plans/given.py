"""Reconciliation of books a caller hands in, one run or thousands at once.

The meaning of the columns is found for all tables together (a note pattern,
then a caller's choice, then names, then values), as one map of role to
column place per table; the cells of every table are projected to the
canonical landing columns by joining that map, and the stages of the derived
books run on them.  ``reconcile`` takes one purchase register and the sheets
of a GSTR-2B workbook, ``reconcile_files`` reads them from files, and
``Uploads`` takes any number of runs and keeps them apart in one plan.  Only
headers (one row per column) and roles are looked at on the driver, and by
``Uploads`` not even those.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comments as CM
from ..operators import consolidate as C
from ..operators import dashboard as DB
from ..operators import itc as ITC
from ..operators import lines as L
from ..operators import pairing as P
from ..operators import schema_match as SM
from ..sources import derived as D
from ..sources import files as X
from ..sources.scratch import materialize
from .reconcile import DEFAULT_RETURN_MONTH, Run

#: Layout -> (header rows, first data row) of a sheet.
LAYOUTS = {"flat": ((1,), 2), "portal": ((5, 6), 7)}

#: Role -> landing column of either book.
PR_LANDING = {"gstin": "gstin_raw", "invoice": "inv_raw", "date": "date_raw", "inv_type": "doc_type", "name": "vendor_name",
              "import_type": "purchase_type", "taxable": "taxable_raw", "cgst": "cgst_raw", "sgst": "sgst_raw",
              "igst": "igst_raw"}
B2_LANDING = {"gstin": "gstin_raw", "invoice": "inv_raw", "date": "date_raw", "inv_type": "inv_type", "note_type": "note_type",
              "name": "trade_name", "reverse_charge": "reverse_charge", "itc": "itc_availability",
              "filing_date": "filing_date_raw", "filing_period": "filing_period", "import_type": "supply_type",
              "taxable": "taxable_raw", "cgst": "cgst_raw", "sgst": "sgst_raw", "igst": "igst_raw"}
#: Amounts that a book carries only if it has the column.
MORE_LANDING = {a: f"{a}_raw" for a in L.MORE_AMOUNTS}
SHEETS = (D.SHEET_B2B, D.SHEET_CDNR, D.SHEET_IMPG)
#: Table kind of a sheet; a note sheet has its own terms.
KINDS = {"PR": "PR", D.SHEET_B2B: "2B", D.SHEET_CDNR: "CDNR", D.SHEET_IMPG: "2B"}


def sheet_from_rows(rows: DataFrame, layout: str) -> DataFrame:
    """(row_no, cells ARRAY<STRING>) of a raw sheet -> its data rows under their (flattened) headers.

    The header rows, one or two, are read on the driver.  A flat header keeps
    its names; of a two-level one the empty, ``unnamed:`` and ``nan`` parts go.
    """
    header_rows, first = LAYOUTS[layout]
    heads = {r["row_no"]: r["cells"] for r in rows.where(F.col("row_no").isin(*header_rows)).collect()}
    width = max((len(c) for c in heads.values()), default=0)

    def part(row: int, i: int) -> str:
        text = ((heads.get(row) or [])[i:i + 1] or [None])[0]
        text = (text or "").replace(" ", " ").strip()
        drop = len(header_rows) > 1 and (text.lower().startswith("unnamed:") or text.lower() == "nan")
        return "" if drop else text

    names = [" ".join(p for p in (part(r, i) for r in header_rows) if p) for i in range(width)]
    taken: dict[str, int] = {}
    columns = []
    for i, name in enumerate(names):  # of equal names the first keeps it
        taken[name] = taken.get(name, 0) + 1
        columns.append(F.get("cells", F.lit(i)).alias(name if name and taken[name] == 1 else f"column {i + 1}"))
    return rows.where(F.col("row_no") >= first).select("row_no", *columns)


class _Tables:
    """The tables of one run as rows of cells, with a catalog of their headers."""

    def __init__(self, tables: Mapping[str, DataFrame], choices: Mapping[str, Mapping[str, str]], row_no: str):
        spark = next(iter(tables.values())).sparkSession
        self.number = {book: i for i, book in enumerate(tables)}
        self.columns = {book: [c for c in df.columns if c != row_no] for book, df in tables.items()}
        # an empty sheet has no roles
        full = [book for book, df in tables.items() if self.columns[book] and not df.isEmpty()]
        catalog = spark.createDataFrame([(self.number[b], KINDS[b], i, c, None) for b in full for i, c in enumerate(self.columns[b])],
                                        "table_id long, kind string, pos int, part1 string, part2 string")
        self.cleaned = SM.clean_headers(catalog)
        self.choices = spark.createDataFrame([(self.number[b], role, text) for b, own in choices.items() if b in self.number for role, text in own.items()],
                                             "table_id long, role string, choice string")
        self.rows = {b: df.select(F.lit(self.number[b]).cast("long").alias("table_id"), F.col(row_no).cast("bigint").alias("row_no"),
                                  F.array(*[F.col(f"`{c}`").cast("string") for c in self.columns[b]]).cast("array<string>").alias("cells"))
                     for b, df in tables.items()}

    @cached_property
    def found(self) -> dict[str, dict[str, int]]:
        """book -> role -> place: a row per role, the plan's schema."""
        cells = [r.select("table_id", F.posexplode("cells").alias("pos", "value")) for r in self.rows.values()]
        out: dict[str, dict[str, int]] = {b: {} for b in self.number}
        books = list(self.number)
        for r in SM.all_roles(self.cleaned, reduce(DataFrame.unionByName, cells), self.choices).collect():
            out[books[r["table_id"]]][r["role"]] = r["pos"]
        return out

    def names(self) -> dict[str, dict[str, str]]:
        return {b: {role: self.columns[b][pos] for role, pos in own.items()} for b, own in self.found.items()}

    def landing(self, book: str, landing: Mapping[str, str]) -> DataFrame:
        own = self.found[book]
        return self.rows[book].select("row_no", *[(F.get("cells", F.lit(own[r])) if r in own else F.lit(None)).cast("string").alias(c)
                                                  for r, c in landing.items()])


def resolve_columns(df: DataFrame, kind: str, sheet: str | None = None, choices: Mapping[str, str] | None = None,
                    row_no: str = "row_no") -> dict[str, str]:
    """C10-C12 for one table: role -> column."""
    book = sheet or ("PR" if kind == "PR" else D.SHEET_B2B)
    return _Tables({book: df}, {book: choices or {}}, row_no).names()[book]


def _more(*found: Mapping[str, object]) -> dict[str, str]:
    return {a: c for a, c in MORE_LANDING.items() if any(a in f for f in found)}


class GivenRun(Run):
    """The stages of :class:`Run` over given books, and their report."""

    def __init__(self, pr: DataFrame, sheets: Mapping[str, DataFrame], choices: Mapping[str, Mapping[str, str]] | None = None,
                 return_month: str = DEFAULT_RETURN_MONTH, row_no: str = "row_no"):
        super().__init__(pr.sparkSession, "given", return_month)
        if D.SHEET_B2B not in sheets:
            raise ValueError(f"the 2B workbook has no sheet {D.SHEET_B2B}")
        self.books = {"PR": pr, **{s: sheets[s] for s in SHEETS if s in sheets}}
        self.tables = _Tables(self.books, choices or {}, row_no)
        self.roles = self.tables.names()
        for book in ("PR", D.SHEET_B2B):
            if (missing := {"gstin", "invoice"} - set(self.roles[book])) and not self.books[book].isEmpty():
                raise ValueError(f"{book}: no column for {', '.join(sorted(missing))}")

    @cached_property
    def pr_table(self) -> DataFrame:
        return materialize(L.typed_pr_lines(self.tables.landing("PR", PR_LANDING | _more(self.roles["PR"]))), "given-pr")

    @cached_property
    def b2_table(self) -> DataFrame:
        sheets = [s for s in SHEETS if s in self.books]  # a missing CDNR or IMPG sheet adds no row
        landing = B2_LANDING | _more(*(self.roles[s] for s in sheets))
        rows = [self.tables.landing(s, landing).withColumn("sheet", F.lit(s)) for s in sheets]
        return materialize(L.typed_b2_rows(reduce(DataFrame.unionByName, rows)), "given-2b")

    @property
    def b2_lines_whole(self) -> DataFrame:
        return self.b2_lines  # typed once and written

    # -- what is written back to the books --------------------------------
    @property
    def pr_comments(self) -> DataFrame:
        return CM.pr_comments(self.pr_raw, self.b2_lines, self.status)

    def _b2_comments(self, lines: DataFrame, sheet: str) -> DataFrame:
        """The tax period is that of the filing date if the sheet has such a column, else of the invoice date."""
        return CM.b2_comments(lines, self.pr_raw, self.status, "filing_date" in self.roles.get(sheet, {}))

    @property
    def b2b_comments(self) -> DataFrame:
        return self._b2_comments(self.b2b_raw, D.SHEET_B2B)

    @property
    def cdnr_comments(self) -> DataFrame:
        return self._b2_comments(self.cdnr_raw, D.SHEET_CDNR)

    @property
    def itc(self) -> DataFrame:
        return ITC.itc_table(self.b2_lines, self.status, self.return_month)

    def report(self) -> dict[str, DataFrame]:
        """The five tables of the report, for :func:`ledgerweave.sources.sinks.publish`."""
        return {"dashboard": DB.dashboard(self.pairs), "itc": self.itc, "reconciliation": P.recon_projection(self.pairs),
                "pr_comments": CM.pr_comments_sheet(self.pr_comments), "b2b_comments": CM.b2_comments_sheet(self.b2b_comments, signed=False),
                "cdnr_comments": CM.b2_comments_sheet(self.cdnr_comments, signed=True)}


def reconcile(pr: DataFrame, sheets: Mapping[str, DataFrame], choices: Mapping[str, Mapping[str, str]] | None = None,
              return_month: str = DEFAULT_RETURN_MONTH, row_no: str = "row_no") -> GivenRun:
    """Reconcile a purchase register with the sheets ``{"B2B": ..., "B2B-CDNR": ..., "IMPG": ...}``.

    Every table has text cells and a ``row_no`` column (:func:`sheet_from_rows`
    makes both from a raw sheet).  B2B is required.  ``choices`` names columns
    by table and role: ``{"PR": {"invoice": "Bill No"}}``.  The result has
    ``pairs``, ``status`` and the other stages of a run, the comments of every
    book, the ITC table and the ``report``.
    """
    return GivenRun(pr, sheets, choices, return_month, row_no)


def reconcile_files(spark: SparkSession, root: str, pr_workbook: str, b2_workbook: str, pr_kind: str = "csv", b2_kind: str = "cells",
                    layout: str = "portal", choices: Mapping[str, Mapping[str, str]] | None = None,
                    return_month: str = DEFAULT_RETURN_MONTH) -> GivenRun:
    """Reconcile two uploaded workbooks (:mod:`ledgerweave.sources.files`): the purchase register is its workbook's only or
    first sheet by name, flat; the sheets of the 2B workbook have the given layout."""
    def sheets(kind: str, workbook: str) -> tuple[DataFrame, list[str]]:
        rows = X.read_sheets(spark, root, kind).where(F.col("workbook") == workbook)
        return rows, sorted(r["sheet"] for r in rows.select("sheet").distinct().collect())

    pr, names = sheets(pr_kind, pr_workbook)
    b2, b2_names = sheets(b2_kind, b2_workbook)
    if not names:
        raise ValueError(f"no sheet in workbook {pr_workbook}")
    return reconcile(sheet_from_rows(pr.where(F.col("sheet") == names[0]), "flat"),
                     {s.strip(): sheet_from_rows(b2.where(F.col("sheet") == s), layout) for s in b2_names}, choices, return_month)


class Uploads:
    """Any number of runs reconciled in one plan, each on its own tables.

    ``catalog`` has (table_id, run_id, kind, pos, part1, part2), kind one of
    PR, 2B and CDNR; ``rows`` has (table_id, row_no, cells) without the header
    rows; ``choices`` has (table_id, role, choice).  Every key is joined, paired
    and named inside its run.
    """

    BY = ["run_id"]

    def __init__(self, catalog: DataFrame, rows: DataFrame, choices: DataFrame):
        self.catalog, self.rows, self.choices = catalog, rows, choices

    @cached_property
    def maps(self) -> DataFrame:
        """(table_id, run_id, kind, roles): one row a table, written."""
        cleaned = SM.clean_headers(self.catalog)
        cells = self.rows.select("table_id", F.posexplode("cells").alias("pos", "value"))
        roles = SM.role_maps(SM.all_roles(cleaned, cells, self.choices))
        return materialize(roles.join(self.catalog.select("table_id", "run_id", "kind").distinct(), "table_id"), "role-maps")

    def _landing(self, kinds: list[str], landing: Mapping[str, str]) -> DataFrame:
        maps = self.maps.where(F.col("kind").isin(*kinds))
        rows = self.rows.join(maps.select("table_id", "run_id", "kind"), "table_id")
        return SM.land(rows, maps.select("table_id", "roles"), landing | MORE_LANDING)

    @property
    def pr_lines(self) -> DataFrame:
        """Typed where they are read: a reader types the columns that it needs."""
        return L.typed_pr_lines(self._landing(["PR"], PR_LANDING))

    @property
    def b2_lines(self) -> DataFrame:
        sheet = F.when(F.col("kind") == "CDNR", F.lit(D.SHEET_CDNR)).otherwise(F.lit(D.SHEET_B2B))
        rows = self._landing(["2B", "CDNR"], B2_LANDING).withColumn("sheet", sheet)
        return L.typed_b2_lines(L.typed_b2_rows(rows))

    @cached_property
    def pairs(self) -> DataFrame:
        by = self.BY
        pr = C.consolidate_by_key(L.pr_clean(self.pr_lines), C.PR_FIRST, extra_keys=by)
        b2 = materialize(C.consolidate_by_key(L.matchable_2b(self.b2_lines), C.B2_FIRST, extra_keys=[*by, "sheet"]), "uploads-cons")
        joined = materialize(P.outer_join(P.suffix_pr(pr, by), P.suffix_2b(C.rescue_empty_inv_key(b2, by), by), by), "uploads-joined")
        rows = materialize(P.show_cdnr_gstin(P.invoice_type(P.classify(P.fuzzy_rescue(joined, by)))), "uploads-rows")
        return P.with_vendor_names(rows, by).select(*by, *P.PAIR_COLUMNS[1:])
