"""Reference SQL (DuckDB dialect) for every registered query.

Written independently of the Spark jobs: plain window functions and
aggregates over the driver's tables, run single-node by the checker.  The
CTE fragments below build, in order: the derived landing books, the typed
lines, the consolidated books, the joined books and the ``pair`` table.
"""

from __future__ import annotations

from ..functions.normalize import FY_HEAD_PATTERN, FY_TAIL_PATTERN, GSTIN_PATTERN

LINE_ORDER = "ok, ln, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
PR_COLS = ["gstin_raw", "inv_raw", "date_raw", "doc_type", "vendor_name", "purchase_type",
           "taxable_raw", "cgst_raw", "sgst_raw", "igst_raw", "invoice_value_raw", "cess_raw"]
B2_COLS = ["gstin_raw", "inv_raw", "date_raw", "inv_type", "note_type", "trade_name", "reverse_charge",
           "itc_availability", "filing_date_raw", "filing_period", "supply_type",
           "taxable_raw", "cgst_raw", "sgst_raw", "igst_raw", "total_tax_raw", "invoice_value_raw", "cess_raw"]
AMOUNTS = ["taxable", "cgst", "sgst", "igst"]
PR_AMOUNTS = [*AMOUNTS, "invoice_value", "cess"]
B2_AMOUNTS = [*AMOUNTS, "total_tax", "invoice_value", "cess"]
MONEY = "DECIMAL(38,2)"


# ---------------------------------------------------------------- expressions
#: White space of Unicode text (\\s of the SQL engine is ASCII only).
WS = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def trim_ws(x: str) -> str:
    return f"regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), '^{WS}+|{WS}+$', '', 'g')"


def nt(x: str) -> str:
    """N1 as_text."""
    s = f"replace(coalesce(CAST({x} AS VARCHAR), ''), chr(160), ' ')"
    s = f"regexp_replace({s}, '^{WS}+|{WS}+$', '', 'g')"
    s = f"replace({s}, ',', '')"
    return f"regexp_replace({s}, '\\.0+$', '')"


def gstin_key(ntx: str) -> str:
    return f"regexp_replace(upper({ntx}), '{WS}+', '', 'g')"


def inv_steps(ntx: str) -> tuple[str, str]:
    """N3 as (intermediate, final(intermediate_name)); RE2 has no look-ahead."""
    v = f"regexp_replace(upper({ntx}), '{WS}+', '', 'g')"
    v = f"regexp_replace({v}, '(?i){FY_HEAD_PATTERN}', '')"
    v = f"regexp_replace({v}, '(?i){FY_TAIL_PATTERN}', '')"
    return v, "CASE WHEN regexp_matches({0}, '\\d') THEN regexp_replace({0}, '^0+([A-Z0-9])', '\\1') ELSE {0} END"


def inv_key_expr(x: str) -> str:
    """N3 over a raw column, as one nested expression (for small queries)."""
    v, fin = inv_steps(nt(x))
    return fin.format(f"({v})")


def parse_date(s: str) -> str:
    """N4 over a trimmed text (only the layouts the derived books use plus
    the day-first and serial forms)."""
    return (f"CASE WHEN {s} <> '' THEN coalesce("
            f"CAST(try_strptime({s}, '%d-%m-%Y') AS DATE), "
            f"CAST(try_strptime({s}, '%d/%m/%Y') AS DATE), "
            f"CASE WHEN regexp_full_match({s}, '\\d{{4,6}}') THEN DATE '1899-12-30' + CAST({s} AS INTEGER) END, "
            f"CAST(try_strptime({s}, '%Y-%m-%d') AS DATE)) END")


def parse_amount(ntx: str) -> str:
    return (f"coalesce(TRY_CAST({ntx} AS {MONEY}), "
            f"TRY_CAST(regexp_replace({ntx}, '[^0-9.\\-]', '', 'g') AS {MONEY}), CAST(0 AS {MONEY}))")


def lower_trim_nan(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, 'nan')), '^\\s+|\\s+$', '', 'g')"


def is_import(x: str) -> str:
    s = f"lower(regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g'))"
    terms = " OR ".join(f"contains({s}, '{t}')" for t in ("import of goods", "imported goods", "import", "overseas"))
    return f"({s} <> '' AND ({terms}))"


def is_total(x: str) -> str:
    s = f"lower({trim_ws(x)})"
    return f"({s} = 'total' OR starts_with({s}, 'total '))"


def is_gstin(x: str) -> str:
    return f"regexp_full_match({trim_ws(x)}, '(?i){GSTIN_PATTERN}')"


def fuzzy_g(x: str) -> str:
    return f"translate(upper({x}), 'OZILB', '02118')"


def fuzzy_i(x: str) -> str:
    return f"regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g')"


def money_text(x: str) -> str:
    return f"CAST(CAST({x} AS {MONEY}) AS VARCHAR)"


def tax_period_start(d: str) -> str:
    return f"date_trunc('month', CASE WHEN day({d}) >= 12 THEN {d} ELSE {d} - INTERVAL 1 MONTH END)::DATE"


# ---------------------------------------------------------------- landing
BASE = f"""
base0 AS (
  SELECT l.l_orderkey AS ok, l.l_linenumber AS ln, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice,
         l.l_shipdate, l.l_returnflag, l.l_linestatus, l.l_tax, s.s_name,
         '07' || chr(CAST(65 + v.vendor // 6760000 % 26 AS INTEGER)) || chr(CAST(65 + v.vendor // 260000 % 26 AS INTEGER))
           || chr(CAST(65 + v.vendor // 10000 % 26 AS INTEGER)) || 'CS' || lpad(CAST(v.vendor % 10000 AS VARCHAR), 4, '0')
           || 'F1Z' || CASE WHEN v.vendor % 2 = 0 THEN 'A' ELSE '7' END AS gstin,
         'INV/' || CAST(o.o_orderkey AS VARCHAR) AS inv,
         CAST(o.o_orderdate AS DATE) AS inv_date,
         (l.l_returnflag = 'R' AND o.o_orderkey % 4 = 1) AS is_cdnr,
         round(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))), 2) AS taxable0,
         v.vendor % 2 AS intra
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN (SELECT o_orderkey, o_orderkey % (SELECT greatest(count(*), 1) FROM supplier) AS vendor FROM orders) v
    ON v.o_orderkey = o.o_orderkey
  LEFT JOIN supplier s ON s.s_suppkey = v.vendor
),
base1 AS (SELECT *, round(taxable0 * CAST(l_tax AS DECIMAL(4,2)), 2) AS tax FROM base0),
base2 AS (
  SELECT *, CAST(taxable0 AS {MONEY}) AS taxable,
         CAST(CASE WHEN ok % 6 = 0 THEN round(taxable0 * CAST(0.01 AS DECIMAL(3,2)), 2) ELSE 0 END AS {MONEY}) AS cess,
         CAST(CASE WHEN intra = 0 THEN round(tax * CAST(0.5 AS DECIMAL(2,1)), 2) ELSE 0 END AS {MONEY}) AS cgst,
         CAST(CASE WHEN intra = 1 THEN tax ELSE 0 END AS {MONEY}) AS igst
  FROM base1
),
base AS (
  SELECT *, CAST(2 * cgst + igst + cess AS {MONEY}) AS total_tax,
         CAST(taxable + 2 * cgst + igst + cess AS {MONEY}) AS invoice_value
  FROM base2
)"""


def _pr_amt(x: str) -> str:
    return f"CASE WHEN ok % 19 = 0 THEN '₹' || {money_text(x)} ELSE {money_text(x)} END"


PR_LAND = f"""
pr_land0 AS (
  SELECT {LINE_ORDER},
    CASE WHEN ok % 997 = 0 AND ln = 1 THEN 'Total' WHEN ok % 43 = 0 AND ln = 2 THEN NULL
         WHEN ok % 41 = 0 THEN lower(substr(gstin, 1, 7)) || ' ' || substr(gstin, 8, 8)
         WHEN ok % 73 = 0 THEN substr(gstin, 1, 7) || chr(8201) || substr(gstin, 8, 8) ELSE gstin END AS gstin_raw,
    CASE WHEN is_cdnr THEN 'CN/' || CAST(ok AS VARCHAR) WHEN ok % 71 = 0 THEN chr(12288) || inv || chr(8195)
         WHEN ok % 5 = 0 THEN ' inv/' || CAST(ok AS VARCHAR) || '/24-25' ELSE inv END AS inv_raw,
    CASE WHEN ok % 7 = 0 THEN CAST(inv_date AS VARCHAR)
         WHEN ok % 9 = 0 THEN CAST(datediff('day', DATE '1899-12-30', inv_date) AS VARCHAR)
         ELSE strftime(inv_date, '%d-%m-%Y') END AS date_raw,
    CASE WHEN is_cdnr THEN 'Credit Note' WHEN ok % 3 = 1 THEN 'Tax Invoice' END AS doc_type,
    CASE WHEN ln % 3 = 0 THEN upper(s_name) WHEN ln % 3 = 1 THEN s_name || ' Traders'
         WHEN ok % 2 = 0 THEN gstin END AS vendor_name,
    CASE WHEN ok % 31 = 0 THEN 'Import of goods' ELSE 'Local' END AS purchase_type,
    {_pr_amt('taxable')} AS taxable_raw, {_pr_amt('cgst')} AS cgst_raw, {_pr_amt('cgst')} AS sgst_raw,
    {_pr_amt('igst')} AS igst_raw, CASE WHEN ln % 4 <> 0 THEN {_pr_amt('invoice_value')} END AS invoice_value_raw,
    {_pr_amt('cess')} AS cess_raw,
    (ok % 61 = 0 AND ln = 3) AS blank
  FROM base WHERE ok % 20 <> 3
),
pr_land AS (
  SELECT row_number() OVER (ORDER BY {LINE_ORDER}) + 1 AS row_no,
         {", ".join(f"CASE WHEN blank THEN NULL ELSE {c} END AS {c}" for c in PR_COLS)}
  FROM pr_land0
)"""

B2_LAND = f"""
b2_land0 AS (
  SELECT CASE WHEN is_cdnr THEN 'B2B-CDNR' ELSE 'B2B' END AS sheet, {LINE_ORDER},
    CASE WHEN ok % 17 = 0 THEN replace(gstin, 'F1Z', 'FIZ') ELSE gstin END AS gstin_raw,
    CASE WHEN is_cdnr AND ok % 47 = 0 THEN '/24-25' WHEN is_cdnr AND ok % 53 = 0 THEN inv WHEN is_cdnr THEN 'CN/' || CAST(ok AS VARCHAR)
         WHEN ok % 17 = 0 THEN 'INV-' || CAST(ok AS VARCHAR) ELSE inv END AS inv_raw,
    CASE WHEN is_cdnr AND ok % 53 = 0 AND ok % 3 = 0 THEN NULL
         ELSE strftime(CASE WHEN ok % 13 = 0 THEN inv_date + 1 ELSE inv_date END, '%d-%m-%Y') END AS date_raw,
    CASE WHEN is_cdnr AND ok % 8 = 1 THEN NULL
         WHEN is_cdnr THEN (CASE WHEN ok % 3 = 0 THEN 'Debit Note' ELSE 'Credit Note' END) ELSE 'Regular' END AS inv_type,
    CASE WHEN is_cdnr THEN (CASE WHEN ok % 3 = 0 THEN 'Debit Note' ELSE 'Credit Note' END) END AS note_type,
    CASE WHEN ok % 41 = 0 THEN gstin ELSE s_name END AS trade_name,
    CASE WHEN ok % 23 = 0 THEN 'Yes' ELSE 'No' END AS reverse_charge,
    CASE WHEN ok % 29 = 0 THEN 'No' ELSE 'Yes' END AS itc_availability,
    strftime(inv_date + 11, '%d-%m-%Y') AS filing_date_raw,
    strftime(inv_date + 11, '%b-%Y') AS filing_period,
    CASE WHEN NOT is_cdnr AND ok % 31 = 0 THEN 'Import of goods' ELSE 'Regular' END AS supply_type,
    {money_text("taxable * CASE WHEN is_cdnr THEN -1 ELSE 1 END")} AS taxable_raw,
    {money_text("(cgst + CASE WHEN ok % 11 = 0 THEN 5 ELSE 0 END) * CASE WHEN is_cdnr THEN -1 ELSE 1 END")} AS cgst_raw,
    {money_text("cgst * CASE WHEN is_cdnr THEN -1 ELSE 1 END")} AS sgst_raw,
    {money_text("igst * CASE WHEN is_cdnr THEN -1 ELSE 1 END")} AS igst_raw,
    {money_text("total_tax * CASE WHEN is_cdnr THEN -1 ELSE 1 END")} AS total_tax_raw,
    {money_text("invoice_value * CASE WHEN is_cdnr THEN -1 ELSE 1 END")} AS invoice_value_raw,
    {money_text("cess * CASE WHEN is_cdnr THEN -1 ELSE 1 END")} AS cess_raw,
    (ok % 67 = 0 AND ln = 2) AS blank
  FROM base WHERE ok % 20 <> 7
  UNION ALL
  SELECT 'IMPG' AS sheet, {LINE_ORDER},
    NULL, 'BOE' || CAST(ok AS VARCHAR) || '-' || CAST(ln AS VARCHAR), strftime(inv_date, '%d-%m-%Y'),
    NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Import of goods',
    {money_text("taxable")}, NULL, NULL, {money_text("tax")}, NULL, {money_text("taxable + tax")}, NULL, FALSE
  FROM base WHERE ok % 37 = 0 AND l_linestatus = 'O'
),
b2_land AS (
  SELECT sheet, row_number() OVER (PARTITION BY sheet ORDER BY {LINE_ORDER}) + 6 AS row_no,
         {", ".join(f"CASE WHEN blank THEN NULL ELSE {c} END AS {c}" for c in B2_COLS)}
  FROM b2_land0
)"""

# ---------------------------------------------------------------- typed lines
_INV_V, _INV_FIN = inv_steps("inv_orig")

PR_LINES = f"""
pr_lines0 AS (
  SELECT *, {nt('inv_raw')} AS inv_orig, {nt('gstin_raw')} AS _g, {trim_ws('date_raw')} AS _d,
         {", ".join(f"{nt(a + '_raw')} AS _{a}" for a in PR_AMOUNTS)}
  FROM pr_land
),
pr_lines1 AS (SELECT *, {_INV_V} AS _iv FROM pr_lines0),
pr_lines AS (
  SELECT row_no, {", ".join(PR_COLS)},
         {gstin_key('_g')} AS gst_key, {_INV_FIN.format('_iv')} AS inv_key, inv_orig,
         {parse_date('_d')} AS inv_date,
         {", ".join(f"{parse_amount('_' + a)} AS {a}" for a in PR_AMOUNTS)},
         {is_import('purchase_type')} AS is_import,
         ({is_total('gstin_raw')} OR {is_total('inv_raw')}) AS is_total
  FROM pr_lines1
)"""

_DEBIT_TEXT = "lower(concat_ws(' ', " + ", ".join(f"coalesce({c}, 'nan')" for c in B2_COLS + ["sheet"]) + "))"

B2_LINES = f"""
b2_lines0 AS (
  SELECT *, {nt('inv_raw')} AS inv_orig, {nt('gstin_raw')} AS _g, {trim_ws('date_raw')} AS _d,
         {trim_ws('filing_date_raw')} AS _fd,
         {", ".join(f"{parse_amount(nt(a + '_raw'))} AS _{a}" for a in B2_AMOUNTS)},
         (contains({_DEBIT_TEXT}, 'debit') OR contains({_DEBIT_TEXT}, ' dr ') OR contains({_DEBIT_TEXT}, ' dr.')) AS _debit
  FROM b2_land
  WHERE NOT ({" AND ".join(f"{c} IS NULL" for c in B2_COLS)})
),
b2_lines1 AS (SELECT *, {_INV_V} AS _iv FROM b2_lines0),
b2_lines AS (
  SELECT sheet, row_no, {", ".join(B2_COLS)},
         {gstin_key('_g')} AS gst_key, {_INV_FIN.format('_iv')} AS inv_key, inv_orig,
         {parse_date('_d')} AS inv_date, {parse_date('_fd')} AS filing_date,
         {", ".join(f"CASE WHEN sheet = 'B2B-CDNR' THEN (CASE WHEN _debit THEN abs(_{a}) ELSE -abs(_{a}) END) ELSE _{a} END AS {a}" for a in B2_AMOUNTS)},
         (sheet = 'B2B' AND {is_import('supply_type')}) AS is_import,
         ({is_total('gstin_raw')} OR {is_total('inv_raw')}) AS is_total,
         {lower_trim_nan('reverse_charge')} IN ('yes', 'y') AS rcm_yes,
         {lower_trim_nan('itc_availability')} IN ('no', 'n', 'ineligible') AS itc_no
  FROM b2_lines1
)"""

# ---------------------------------------------------------------- consolidation
def _first(c: str) -> str:
    return f"arg_min({c}, row_no) FILTER (WHERE {c} IS NOT NULL) AS {c}"


_PR_FIRST = ["gstin_raw", "inv_orig", "doc_type", "vendor_name", "purchase_type"]
_B2_FIRST = ["gstin_raw", "inv_orig", "inv_type", "note_type", "trade_name", "reverse_charge", "itc_availability",
             "filing_date_raw", "filing_period", "supply_type"]


def _cons_aggs(first: list[str], amounts: list[str]) -> str:
    sums = ", ".join(f"CAST(sum({a}) AS {MONEY}) AS {a}" for a in amounts)
    return (f"{sums}, min(inv_date) AS inv_date, {', '.join(_first(c) for c in first)}, "
            f"min(row_no) AS first_row, count(*) AS n_lines")


CONS = f"""
pr_cons AS (
  SELECT gst_key, inv_key, {_cons_aggs(_PR_FIRST, PR_AMOUNTS)}
  FROM pr_lines WHERE NOT is_import AND NOT is_total AND gst_key <> ''
  GROUP BY gst_key, inv_key
),
b2_cons0 AS (
  SELECT gst_key, inv_key, sheet, {_cons_aggs(_B2_FIRST, B2_AMOUNTS)}
  FROM b2_lines
  WHERE ((sheet = 'B2B' AND NOT is_import) OR sheet = 'B2B-CDNR') AND NOT is_total AND gst_key <> ''
  GROUP BY gst_key, inv_key, sheet
),
cdnr_pos AS (
  SELECT gst_key, inv_key, row_number() OVER (ORDER BY gst_key, inv_key) - 1 AS pos
  FROM b2_cons0 WHERE sheet = 'B2B-CDNR'
),
b2_cons AS (
  SELECT c.* REPLACE (CASE WHEN c.sheet = 'B2B-CDNR' AND c.inv_key = ''
                           THEN '__CDNR_ROW__' || CAST(p.pos AS VARCHAR) || '__' ELSE c.inv_key END AS inv_key)
  FROM b2_cons0 c LEFT JOIN cdnr_pos p
    ON c.sheet = 'B2B-CDNR' AND p.gst_key = c.gst_key AND p.inv_key = c.inv_key
)"""

# ---------------------------------------------------------------- pairing
PR_VALUES = ["pr_gstin", "pr_inv", "pr_date", *[f"pr_{a}" for a in PR_AMOUNTS], "pr_doc_type",
             "pr_vendor_name", "pr_first_row"]
B2_VALUES = ["b2_gstin", "b2_inv", "b2_date", *[f"b2_{a}" for a in B2_AMOUNTS], "b2_inv_type",
             "b2_note_type", "b2_trade_name", "b2_filing_period", "b2_first_row"]
# every 2B column that can be missing -> its column in the consolidated book
FILL = {"b2_gstin": "gstin_raw", "b2_inv": "inv_orig", "b2_date": "inv_date", "b2_inv_type": "inv_type",
        "b2_note_type": "note_type", "b2_trade_name": "trade_name", "b2_filing_period": "filing_period"}

_fill_matched = ", ".join(f"coalesce({c}, {c}__sib) AS {c}" for c in FILL)
_fill_left = ", ".join(f"CASE WHEN b2_parts = 2 AND NOT _key_taken THEN coalesce({c}, {c}__sib) ELSE {c} END AS {c}"
                       for c in FILL)

PAIRS = f"""
pr_s AS (
  SELECT gst_key, inv_key, TRUE AS pr_exists, gstin_raw AS pr_gstin, inv_orig AS pr_inv, inv_date AS pr_date,
         {", ".join(f"{a} AS pr_{a}" for a in PR_AMOUNTS)}, doc_type AS pr_doc_type,
         vendor_name AS pr_vendor_name, first_row AS pr_first_row
  FROM pr_cons
),
b2_s AS (
  SELECT gst_key, inv_key, sheet, CASE WHEN sheet = 'B2B' THEN 0 ELSE 1 END AS sheet_rank,
         gstin_raw AS b2_gstin, inv_orig AS b2_inv, inv_date AS b2_date, {", ".join(f"{a} AS b2_{a}" for a in B2_AMOUNTS)},
         inv_type AS b2_inv_type, note_type AS b2_note_type,
         trade_name AS b2_trade_name, filing_period AS b2_filing_period, first_row AS b2_first_row,
         count(*) OVER (PARTITION BY gst_key, inv_key) AS b2_parts,
         {", ".join(f"max({src}) OVER (PARTITION BY gst_key, inv_key) AS {c}__sib" for c, src in FILL.items())}
  FROM b2_cons
),
joined AS (
  SELECT * REPLACE (coalesce(pr_exists, FALSE) AS pr_exists)
  FROM pr_s FULL OUTER JOIN b2_s USING (gst_key, inv_key)
),
matched AS (
  SELECT * EXCLUDE ({", ".join(f"{c}__sib" for c in FILL)}) REPLACE ({_fill_matched}),
         CAST(NULL AS VARCHAR) AS fuzzy_reason
  FROM joined WHERE pr_exists AND sheet IS NOT NULL
),
pr_o AS (SELECT gst_key, inv_key, pr_exists, {", ".join(PR_VALUES)} FROM joined WHERE pr_exists AND sheet IS NULL),
b2_o AS (
  SELECT gst_key, inv_key, sheet, sheet_rank, {", ".join(B2_VALUES)}, b2_parts, {", ".join(f"{c}__sib" for c in FILL)}
  FROM joined WHERE NOT pr_exists AND sheet IS NOT NULL
),
pr_r AS (
  SELECT gst_key, inv_key, {fuzzy_g('gst_key')} AS fg, {fuzzy_i('inv_key')} AS fi,
         row_number() OVER (PARTITION BY {fuzzy_g('gst_key')}, {fuzzy_i('inv_key')} ORDER BY gst_key, inv_key) AS fifo
  FROM pr_o
),
b2_r AS (
  SELECT gst_key AS src_gst, inv_key AS src_inv, sheet_rank AS src_rank, {fuzzy_g('gst_key')} AS fg,
         {fuzzy_i('inv_key')} AS fi,
         row_number() OVER (PARTITION BY {fuzzy_g('gst_key')}, {fuzzy_i('inv_key')}
                            ORDER BY gst_key, inv_key, sheet_rank) AS fifo
  FROM b2_o
),
links AS (SELECT p.gst_key, p.inv_key, b.src_gst, b.src_inv, b.src_rank FROM pr_r p JOIN b2_r b USING (fg, fi, fifo)),
rescued AS (
  SELECT p.*, b.sheet, b.sheet_rank, {", ".join("b." + c for c in B2_VALUES)}, CAST(1 AS BIGINT) AS b2_parts,
         CASE WHEN concat_ws(', ', CASE WHEN p.gst_key <> l.src_gst THEN 'GSTIN' END,
                                   CASE WHEN p.inv_key <> l.src_inv THEN 'Invoice No' END) = '' THEN 'Typos'
              ELSE concat_ws(', ', CASE WHEN p.gst_key <> l.src_gst THEN 'GSTIN' END,
                                   CASE WHEN p.inv_key <> l.src_inv THEN 'Invoice No' END) END AS fuzzy_reason
  FROM pr_o p JOIN links l ON p.gst_key = l.gst_key AND p.inv_key = l.inv_key
  JOIN b2_o b ON b.gst_key = l.src_gst AND b.inv_key = l.src_inv AND b.sheet_rank = l.src_rank
),
pr_left AS (
  SELECT p.*, CAST(NULL AS VARCHAR) AS fuzzy_reason FROM pr_o p
  WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.gst_key = p.gst_key AND l.inv_key = p.inv_key)
),
b2_left0 AS (
  SELECT b.*, EXISTS (SELECT 1 FROM links l WHERE l.src_gst = b.gst_key AND l.src_inv = b.inv_key) AS _key_taken
  FROM b2_o b
  WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.src_gst = b.gst_key AND l.src_inv = b.inv_key
                                           AND l.src_rank = b.sheet_rank)
),
b2_left AS (
  SELECT * EXCLUDE (_key_taken, {", ".join(f"{c}__sib" for c in FILL)}) REPLACE ({_fill_left}),
         FALSE AS pr_exists, CAST(NULL AS VARCHAR) AS fuzzy_reason
  FROM b2_left0
),
rows0 AS (
  SELECT * FROM matched UNION ALL BY NAME SELECT * FROM rescued
  UNION ALL BY NAME SELECT * FROM pr_left UNION ALL BY NAME SELECT * FROM b2_left
),
rows1 AS (
  SELECT *,
    concat_ws('; ',
      CASE WHEN NOT (pr_date IS NOT DISTINCT FROM b2_date) THEN 'Invoice Date' END,
      {", ".join(f"CASE WHEN abs(round_even(coalesce(pr_{t}, 0), 0)) <> abs(round_even(coalesce(b2_{t}, 0), 0)) THEN '{t.upper()}' END" for t in ("cgst", "sgst", "igst"))}
    ) AS _problems,
    CASE WHEN fuzzy_reason IS NOT NULL OR sheet IS NULL THEN 0 ELSE sheet_rank END AS _o
  FROM rows0
),
rows2 AS (
  SELECT * EXCLUDE (_problems, b2_gstin),
    CASE WHEN fuzzy_reason IS NOT NULL THEN 'Almost Matched'
         WHEN pr_exists AND sheet IS NULL THEN 'Not Matched'
         WHEN sheet IS NOT NULL AND NOT pr_exists THEN 'Not Matched'
         WHEN _problems <> '' THEN 'Almost Matched' ELSE 'Matched' END AS mapping,
    CASE WHEN fuzzy_reason IS NOT NULL THEN 'mis-match'
         WHEN pr_exists AND sheet IS NULL THEN 'missing in 2B'
         WHEN sheet IS NOT NULL AND NOT pr_exists THEN 'missing in PR'
         WHEN _problems <> '' THEN 'mismatch' ELSE 'All fields matched' END AS remarks,
    CASE WHEN fuzzy_reason IS NOT NULL THEN fuzzy_reason
         WHEN pr_exists AND sheet IS NOT NULL THEN _problems ELSE '' END AS reason,
    CASE WHEN {nt('pr_doc_type')} <> '' THEN {nt('pr_doc_type')}
         WHEN {nt('b2_inv_type')} <> '' THEN {nt('b2_inv_type')}
         WHEN contains(lower({nt('b2_note_type')}), 'credit') THEN 'Credit Note'
         WHEN contains(lower({nt('b2_note_type')}), 'debit') THEN 'Debit Note'
         WHEN sheet = 'B2B' THEN 'Invoice' WHEN pr_exists THEN 'Invoice' ELSE '' END AS invoice_type,
    CASE WHEN sheet = 'B2B-CDNR' THEN gst_key ELSE b2_gstin END AS b2_gstin
  FROM rows1
),
names0 AS (
  SELECT gst_key, {nt('pr_vendor_name')} AS name, 0 AS side, inv_key AS o1, _o AS o2 FROM rows2
  UNION ALL
  SELECT gst_key, {nt('b2_trade_name')} AS name, 1 AS side, inv_key AS o1, _o AS o2 FROM rows2
),
names AS (
  SELECT gst_key, name AS vendor_name FROM (
    SELECT *, row_number() OVER (PARTITION BY gst_key ORDER BY length(name) DESC, side, o1, o2) AS rn
    FROM names0 WHERE name <> '' AND NOT {is_gstin('name')}) WHERE rn = 1
),
pairs AS (
  SELECT r.* EXCLUDE (_o), coalesce(n.vendor_name, '') AS vendor_name,
         row_number() OVER (ORDER BY r.gst_key, r.inv_key, r._o) - 1 AS pair_id
  FROM rows2 r LEFT JOIN names n ON r.gst_key = n.gst_key
),
status AS (
  SELECT gst_key, inv_key, arg_max(mapping, pair_id) AS mapping, arg_max(remarks, pair_id) AS remarks,
         arg_max(reason, pair_id) AS reason
  FROM pairs GROUP BY gst_key, inv_key
)"""

STAGES = {
    "landing": [BASE, PR_LAND, B2_LAND],
    "lines": [BASE, PR_LAND, B2_LAND, PR_LINES, B2_LINES],
    "cons": [BASE, PR_LAND, B2_LAND, PR_LINES, B2_LINES, CONS],
    "pairs": [BASE, PR_LAND, B2_LAND, PR_LINES, B2_LINES, CONS, PAIRS],
}


def with_stage(stage: str, *extra: str) -> str:
    """``WITH`` clause holding every CTE up to ``stage`` plus ``extra`` ones."""
    parts = [p.strip() for p in STAGES[stage]] + [e.strip() for e in extra]
    return "WITH " + ",\n".join(parts) + "\n"
