"""DuckDB reference SQL for the schema-discovery queries.

The dictionary and the header templates are the same fixed data the Spark
jobs use; the matching itself is written independently here with joins and
``EXISTS`` over the dictionary rows.
"""

from __future__ import annotations

from ..functions.normalize import GSTIN_PATTERN
from ..operators import schema_match as S
from ..sources import catalog as CT
from . import oracle as O


def _q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


_TMPL = ", ".join(f"({t}, {_q(kind)}, {p}, {_q(p1)}, {_q(p2)}, {_q(r)})"
                  for t, (kind, cols) in enumerate(CT.TEMPLATES) for p, (p1, p2, r) in enumerate(cols))
_DICT_ROWS = [(lst, i, term, S.norm_term(term)) for lst, terms in S.ROLE_LISTS.items() for i, term in enumerate(terms)]
_DICT_ROWS += [("pr_invoice_pen", i, t, S.norm_term(t)) for i, t in enumerate(S.PR_INVOICE_PENALTIES)]
_DICT_ROWS += [("import_type", i, t, S.norm_term(t)) for i, t in enumerate(S.IMPORT_TYPE_TERMS)]
_DICT = ", ".join(f"({_q(a)}, {b}, {_q(c)}, {_q(d)})" for a, b, c, d in _DICT_ROWS)

_ROLE_ROWS = []
for _role, (_c, _a, _p) in S.PR_ROLES.items():
    _ROLE_ROWS.append(("PR", _role, _c, _a, "pr_invoice_pen" if _role == "invoice" else _p))
for _role, (_c, _a, _p) in S.B2_ROLES.items():
    _ROLE_ROWS.append(("2B", _role, _c, _a, _p))
_ROLES = ", ".join("(" + ", ".join(_q(x) for x in row) + ")" for row in _ROLE_ROWS)

_ROLE_VALUE = {
    "gstin": "l.gstin", "buyer_gstin": _q(CT.BUYER_GSTIN), "invoice": "l.inv",
    "voucher": "'VCH/' || CAST(l.ok AS VARCHAR) || '/' || CAST(l.ln AS VARCHAR)",
    "date": "strftime(l.inv_date, '%d-%m-%Y')", "taxable": O.money_text("l.taxable"), "cgst": O.money_text("l.cgst"),
    "sgst": O.money_text("l.cgst"), "igst": O.money_text("l.igst"), "cess": O.money_text("0"),
    "invvalue": O.money_text("l.taxable + l.tax"), "name": "l.s_name", "ptype": "'Local'", "dtype": "'Tax Invoice'",
    "itype": "'Regular'", "place": "'Delhi'", "rcm": "'No'", "period": "strftime(l.inv_date + 11, '%b-%Y')",
    "filing_date": "strftime(l.inv_date + 11, '%d-%m-%Y')", "itc": "'Yes'", "ntype": "'Credit Note'",
    "note_no": "'CN/' || CAST(l.ok AS VARCHAR)", "note_date": "strftime(l.inv_date, '%d-%m-%Y')",
    "narration": "'Purchase of goods'", "sparse_note": "CASE WHEN l.ln = 1 THEN 'CN/' || CAST(l.ok AS VARCHAR) END",
}
_VALUE_CASE = "CASE m.role " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in _ROLE_VALUE.items()) + " END"

_PART = ("CASE WHEN trim(replace({0}, chr(160), ' ')) <> '' AND (part2 IS NULL "
         "OR (NOT starts_with(lower(trim(replace({0}, chr(160), ' '))), 'unnamed:') "
         "AND lower(trim(replace({0}, chr(160), ' '))) <> 'nan')) THEN trim(replace({0}, chr(160), ' ')) END")

CATALOG = f"""
tmpl AS (SELECT * FROM (VALUES {_TMPL}) v(t, kind, pos, part1, part2, role)),
cat_t AS (SELECT DISTINCT o_orderkey // {CT.ORDERS_PER_TABLE} AS table_id FROM orders),
catalog AS (SELECT c.table_id, m.kind, m.pos, m.part1, m.part2 FROM cat_t c JOIN tmpl m ON m.t = c.table_id % 6),
cleaned0 AS (SELECT *, concat_ws(' ', {_PART.format('part1')}, {_PART.format('part2')}) AS col FROM catalog),
cleaned AS (
  SELECT table_id, kind, pos, part1, part2, col,
         lower(trim(regexp_replace(replace(col, chr(160), ' '), '\\s+', ' ', 'g'))) AS soft,
         regexp_replace(lower(trim(col)), '[^a-z0-9]', '', 'g') AS norm
  FROM cleaned0
),
dict AS (SELECT * FROM (VALUES {_DICT}) d(list_name, pos, term, t)),
roles AS (SELECT * FROM (VALUES {_ROLES}) r(kind, role, cand, avoid, pen)),
scored AS (
  SELECT c.table_id, c.kind, c.pos, c.col, r.role,
    5 * (EXISTS (SELECT 1 FROM dict d WHERE d.list_name = r.cand AND d.t = c.norm))::INT
    + 3 * (EXISTS (SELECT 1 FROM dict d WHERE d.list_name = r.cand AND contains(c.norm, d.t)))::INT
    + 2 * (EXISTS (SELECT 1 FROM dict d WHERE d.list_name = r.cand AND starts_with(c.norm, d.t)))::INT
    + contains(c.norm, 'inv')::INT + contains(c.norm, 'gst')::INT
    - 4 * (EXISTS (SELECT 1 FROM dict d WHERE d.list_name = r.avoid AND contains(c.norm, d.t)))::INT
    - 3 * (EXISTS (SELECT 1 FROM dict d WHERE d.list_name = r.pen AND contains(c.norm, d.t)))::INT AS score
  FROM cleaned c JOIN roles r ON r.kind = c.kind
),
c2 AS (
  SELECT table_id, kind, role, col, score FROM (
    SELECT *, row_number() OVER (PARTITION BY table_id, role ORDER BY score DESC, pos) AS rn FROM scored)
  WHERE rn = 1 AND score > 0
),
base_t AS (
  SELECT b.*, b.ok // {CT.ORDERS_PER_TABLE} AS table_id,
         row_number() OVER (PARTITION BY b.ok // {CT.ORDERS_PER_TABLE} ORDER BY {O.LINE_ORDER}) + 1 AS row_no
  FROM base b
),
cells AS (SELECT l.table_id, m.pos, l.row_no, {_VALUE_CASE} AS value FROM base_t l JOIN tmpl m ON m.t = l.table_id % 6),
present AS (SELECT table_id, pos, {O.trim_ws('value')} AS value FROM cells WHERE value IS NOT NULL),
sample AS (
  SELECT table_id, pos, row_no, value FROM (
    SELECT table_id, pos, row_no, {O.trim_ws('value')} AS value,
           row_number() OVER (PARTITION BY table_id, pos ORDER BY row_no) AS rn
    FROM cells WHERE value IS NOT NULL) WHERE rn <= {S.PROFILE_SAMPLE}
)"""


def _words(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


PROFILES = f"""
gshare AS (
  SELECT table_id, pos, sum(regexp_full_match(value, '(?i){GSTIN_PATTERN}')::INT) / count(*) AS share
  FROM present GROUP BY table_id, pos
),
gv AS (
  SELECT table_id, col, score FROM (
    SELECT c.table_id, c.pos, c.col,
           (g.share + CASE WHEN {_words('c.norm', S.SUPPLIER_WORDS)} THEN 0.2 ELSE 0.0 END)
             - CASE WHEN {_words('c.norm', S.NOT_SUPPLIER_WORDS)} THEN 0.2 ELSE 0.0 END AS score,
           row_number() OVER (PARTITION BY c.table_id ORDER BY (g.share + CASE WHEN {_words('c.norm', S.SUPPLIER_WORDS)} THEN 0.2 ELSE 0.0 END)
             - CASE WHEN {_words('c.norm', S.NOT_SUPPLIER_WORDS)} THEN 0.2 ELSE 0.0 END DESC, c.pos) AS rn
    FROM gshare g JOIN cleaned c ON c.table_id = g.table_id AND c.pos = g.pos
    WHERE g.share > 0 AND c.kind = 'PR')
  WHERE rn = 1 AND score > 0
),
ishare AS (
  SELECT table_id, pos, sum((NOT regexp_full_match(value, '(?i){GSTIN_PATTERN}') AND length(value) BETWEEN 1 AND 30
                             AND NOT regexp_full_match(value, '[A-Za-z]+') AND NOT regexp_full_match(value, '0+')
                             AND NOT regexp_full_match(value, '[-/\\.]+') AND regexp_matches(value, '\\d'))::INT)
                        / count(*) AS share
  FROM present GROUP BY table_id, pos
),
iv AS (
  SELECT table_id, col, score FROM (
    SELECT c.table_id, c.col, i.share AS score,
           row_number() OVER (PARTITION BY c.table_id ORDER BY i.share DESC, c.pos) AS rn
    FROM ishare i JOIN cleaned c ON c.table_id = i.table_id AND c.pos = i.pos
    WHERE c.kind = 'PR' AND NOT {_words('c.norm', S.INVOICE_SKIP_WORDS)})
  WHERE rn = 1 AND score > 0
),
rx AS (
  {" UNION ALL ".join(f"SELECT table_id, '{k}' AS pattern, arg_min(col, pos) AS col FROM cleaned WHERE regexp_matches(col, '(?i){p}') GROUP BY table_id" for k, p in S.REGEX_ROLES.items())}
),
sel AS (
  SELECT DISTINCT table_id, 'invoice' AS role, lower(trim(regexp_replace('  bill   NO ', '\\s+', ' ', 'g'))) AS soft
  FROM cleaned WHERE kind = 'PR' AND table_id % 4 = 1
),
softmap AS (SELECT table_id, soft, arg_min(col, pos) AS col FROM cleaned GROUP BY table_id, soft),
grid AS (SELECT DISTINCT c.table_id, c.kind, r.role FROM cleaned c JOIN roles r ON r.kind = c.kind),
resolved AS (
  SELECT g.table_id, g.kind, g.role,
         coalesce(CASE WHEN g.role = 'note_no' THEN rxn.col WHEN g.role = 'note_date' THEN rxd.col END,
                  ch.col, c2.col,
                  CASE WHEN g.kind = 'PR' AND g.role = 'gstin' THEN gv.col
                       WHEN g.kind = 'PR' AND g.role = 'invoice' THEN iv.col END) AS col
  FROM grid g
  LEFT JOIN c2 ON c2.table_id = g.table_id AND c2.role = g.role AND c2.kind = g.kind
  LEFT JOIN (SELECT s.table_id, s.role, m.col FROM sel s JOIN softmap m ON m.table_id = s.table_id AND m.soft = s.soft) ch
    ON ch.table_id = g.table_id AND ch.role = g.role
  LEFT JOIN gv ON gv.table_id = g.table_id
  LEFT JOIN iv ON iv.table_id = g.table_id
  LEFT JOIN (SELECT * FROM rx WHERE pattern = 'note_number') rxn ON rxn.table_id = g.table_id
  LEFT JOIN (SELECT * FROM rx WHERE pattern = 'note_date') rxd ON rxd.table_id = g.table_id
)"""


def with_schema(*extra: str) -> str:
    return O.with_stage("landing", CATALOG, PROFILES, *extra)
