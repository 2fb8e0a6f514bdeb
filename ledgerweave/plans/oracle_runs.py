"""DuckDB reference SQL of the queries over many runs: the book's own SQL with the run in front of every key.

The SQL looks at no header: it takes each landing column for what it is, so
it tells whether the Spark side has found the columns.
"""

from __future__ import annotations

from ..sources import catalog as CT
from . import oracle as O

SHARED = ["gstin_raw", "inv_raw", "date_raw", "taxable_raw", "cgst_raw", "sgst_raw", "igst_raw"]
RUN = f"ok // {CT.ORDERS_PER_RUN}"


def _has(kind: str, column: str) -> str:
    """SQL: the run's sheet has the column."""
    layouts = CT.RUN_HEADERS[kind]
    hits = [str(i) for i, cols in enumerate(layouts) if any(c == column for _a, _b, c in cols)]
    return f"run_id % {len(layouts)} IN ({', '.join(hits)})" if hits else "FALSE"


def _landing() -> list[str]:
    def cell(kind: str, c: str) -> str:
        return f"CASE WHEN NOT blank AND {_has(kind, c)} THEN {c} END AS {c}"

    pr = f"""
pr_land AS (
  SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY {O.LINE_ORDER}) + 1 AS row_no,
         {", ".join(cell("PR", c) for c in O.PR_COLS)}
  FROM (SELECT {RUN} AS run_id, * FROM pr_land0)
)"""
    b2 = f"""
b2_run0 AS (
  SELECT {RUN} AS run_id, *, row_number() OVER (PARTITION BY {RUN}, sheet ORDER BY {O.LINE_ORDER}) + 6 AS row_no
  FROM b2_land0 WHERE sheet <> 'IMPG'
),
b2_land AS (
  SELECT run_id, sheet, row_no, {", ".join(cell("2B", c) for c in O.B2_COLS)} FROM b2_run0 WHERE sheet = 'B2B'
  UNION ALL
  SELECT run_id, sheet, row_no, {", ".join(cell("CDNR", c) for c in O.B2_COLS)} FROM b2_run0 WHERE sheet = 'B2B-CDNR'
)"""
    return [O.BASE, O.PR_LAND.replace("pr_land AS (", "whole_pr_land AS ("), pr, O.B2_LAND.replace("b2_land AS (", "whole_b2_land AS ("), b2]


def _lines() -> list[str]:
    def of_run(sql: str, first: str) -> str:
        key = f"{O.gstin_key('_g')} AS gst_key"
        keyed = f"CASE WHEN {O.gstin_key('_g')} = '' THEN '' ELSE CAST(run_id AS VARCHAR) || '#' || {O.gstin_key('_g')} END AS gst_key"
        assert key in sql and f"SELECT {first}" in sql
        return sql.replace(key, keyed).replace(f"SELECT {first}", f"SELECT run_id, {first}")

    cons = O.CONS.replace("row_number() OVER (ORDER BY gst_key, inv_key)", "row_number() OVER (PARTITION BY split_part(gst_key, '#', 1) ORDER BY gst_key, inv_key)")
    return [of_run(O.PR_LINES, "row_no, "), of_run(O.B2_LINES, "sheet, row_no, "), cons]


def _with(parts: list[str]) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


def land_sql() -> str:
    cols = ", ".join([*SHARED, "invoice_value_raw", "cess_raw"])
    return _with([*_landing(), *_lines()]) + f"""
SELECT CAST(run_id AS BIGINT) AS run_id, 'PR' AS sheet, CAST(row_no AS BIGINT) AS row_no, {cols}, vendor_name AS name, doc_type AS type FROM pr_lines
UNION ALL SELECT run_id, sheet, CAST(row_no AS BIGINT), {cols}, trade_name, inv_type FROM b2_lines"""


def pairs_sql() -> str:
    return _with([*_landing(), *_lines(), O.PAIRS]) + """
SELECT CAST(split_part(gst_key, '#', 1) AS BIGINT) AS run_id, split_part(gst_key, '#', 2) AS gst_key, inv_key, sheet, mapping, remarks, reason,
       vendor_name, invoice_type, pr_cgst, b2_cgst, b2_cess
FROM pairs"""
