"""Cell normalisation rules (N1-N15) as native Column expressions.

Every rule is a JVM-side expression that stays inside whole-stage codegen;
no Python UDF is involved.  They are applied table-wide by the jobs in
``ledgerweave.operators``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reconciliation rules being reproduced.
# GSTIN layout, the financial-year head/tail patterns of invoice numbers and
# the fuzzy character folds are stated here once, in their natural order.
GSTIN_PATTERN = r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]$"
FY_HEAD_PATTERN = r"^(?:FY|FY-)?20?\d{2}[ \-\/]?20?\d{2}[/\-]"
FY_TAIL_PATTERN = r"([/\-]20?\d{2}[ \-\/]?20?\d{2}|[/\-]\d{2}[/\-]\d{2}|[/\-]\d{2}[\-]\d{2})$"
FUZZY_GSTIN_FROM = "OZILB"
FUZZY_GSTIN_TO = "02118"
EXCEL_EPOCH = "1899-12-30"
# Date texts tried after the day-first forms and the Excel serial number
# (ISO is read as ISO; see README, deliberate difference D1).
EXTRA_DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "d.M.yyyy", "d-M-yy", "d/M/yy")
WORD_DATE_FORMATS = ("d-MMM-yyyy", "d MMM yyyy", "d-MMMM-yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d-MMM-yy")
# ... of a date with a time of day
TIMED_DATE_FORMATS = ("d-M-yyyy", "d/M/yyyy", "yyyy-M-d", "d-MMM-yyyy")
# ---------------------------------------------------------------------------

NBSP = " "
MONEY = "decimal(38,2)"
#: Numbers of any column (N14): ten decimals.
NUMBER = "decimal(38,10)"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# White space of str.strip() and of \\s on Unicode text, as a character set.
WS = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
      "\u2028\u2029\u202f\u205f\u3000")


def strip_ws(col: Column) -> Column:
    """Whitespace removed at both ends (no regular expression)."""
    return F.btrim(col, F.lit(WS))


def drop_ws(col: Column) -> Column:
    """Every whitespace character removed (``re.sub(r'\\s+', '', s)``); only texts that may hold one (a character outside
    the printable ASCII range) are rebuilt."""
    return F.when(col.rlike("[^!-~]"), F.translate(col, WS, "")).otherwise(col)


def norm_text(col: Column | str) -> Column:
    """Null -> '', NBSP -> space, trim, drop commas, drop a trailing '.0+'.

    Character-level steps use ``replace``/``btrim`` (no regex, a text without
    the character is passed on as it is); the one regular expression only
    runs on texts ending in '0'.
    """
    s = F.coalesce(_c(col).cast("string"), F.lit(""))
    s = F.replace(strip_ws(F.replace(s, F.lit(NBSP), F.lit(" "))), F.lit(","), F.lit(""))
    return F.when(s.endswith("0"), F.regexp_replace(s, r"\.0+$", "")).otherwise(s)


def norm_gstin(col: Column | str) -> Column:
    """N1, upper case, no whitespace."""
    return drop_ws(F.upper(norm_text(col)))


def norm_invoice(col: Column | str) -> Column:
    """N1, upper, no whitespace, strip the FY head then the FY tail,
    then leading zeros (keeping one character) when a digit remains."""
    v = drop_ws(F.upper(norm_text(col)))
    v = F.regexp_replace(v, "(?i)" + FY_HEAD_PATTERN, "")
    v = F.regexp_replace(v, "(?i)" + FY_TAIL_PATTERN, "")
    return F.when(v.rlike(r"\d"), F.regexp_replace(v, r"^0+(?=[A-Z0-9])", "")).otherwise(v)


def trimmed(col: Column | str) -> Column:
    """Text with surrounding whitespace removed; missing -> ''."""
    return strip_ws(F.coalesce(_c(col).cast("string"), F.lit("")))


def with_invoice_key(df, text_col: str, out_col: str):
    """N3 applied over an N1-normalised column, in one projection.

    The three patterns leave a text alone that they do not match (leading
    zeros are only cut before another letter or digit).  Two of them can match
    after certain first letters alone, which are looked at first, and no
    intermediate text is a column that every row carries.
    """
    v = drop_ws(F.upper(F.col(text_col)))
    for pattern, firsts in (("(?i)" + FY_HEAD_PATTERN, "F2"), ("(?i)" + FY_TAIL_PATTERN, ""), (r"^0+(?=[A-Z0-9])", "0")):
        out = F.regexp_replace(v, pattern, "")
        v = F.when(F.substring(v, 1, 1).isin(*firsts), out).otherwise(v) if firsts else out
    return df.withColumn(out_col, v)


def parse_amount_text(nt: Column | str) -> Column:
    """N5 over an N1-normalised column."""
    s = _c(nt)
    return F.coalesce(s.try_cast(MONEY), F.regexp_replace(s, r"[^0-9.\-]", "").try_cast(MONEY), F.lit(0).cast(MONEY))


def unless_plain_amount(raw: str) -> Column:
    """N1 of the texts that are no number as they stand; null for the others, which need no cleaning."""
    return F.when(F.col(raw).try_cast(MONEY).isNull(), norm_text(raw))


def plain_or_parsed_amount(raw: str, cleaned: str) -> Column:
    """N5 over a raw column and what ``unless_plain_amount`` made of it."""
    return F.coalesce(F.col(raw).try_cast(MONEY), parse_amount_text(cleaned))


def amount_of_cell(raw: str) -> Column:
    """N5 over a raw column: a number as it stands is parsed once, any other text is cleaned first, a missing cell is 0."""
    c = F.col(raw)
    return F.coalesce(c.try_cast(MONEY), F.when(c.isNotNull(), parse_amount_text(norm_text(raw))), F.lit(0).cast(MONEY))


#: Text after the date: a time of day, with or without fractions and zone.
_TIME = r"[ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?( ?(Z|[+-]\d{2}:?\d{2}))?( ?[AaPp][Mm])?$"


def parse_date_text(s: Column | str) -> Column:
    """N4 over a trimmed text column.

    Each layout is only attempted when a cheap shape test (separator before
    a 4-digit year, letters, a colon, length of a serial number, ...) says it
    can match: a failed parse is far more expensive than the test.
    """
    s = _c(s)
    n = F.length(s)
    sep_at_year = F.substring(s, -5, 1)

    def day(fmt: str, text: Column = s) -> Column:
        return F.to_date(F.try_to_timestamp(text, F.lit(fmt)))

    # two-digit day and month: the ISO text is cast, without a formatter
    iso = F.concat(F.substring(s, 7, 4), F.lit("-"), F.substring(s, 4, 2), F.lit("-"), F.substring(s, 1, 2))
    tries = [
        F.when((n == 10) & (sep_at_year == "-") & s.rlike(r"^[0-9]{2}-[0-9]{2}-(?!0000)[0-9]{4}$"), iso.try_cast("date")),
        F.when(sep_at_year == "-", day("d-M-yyyy")),
        F.when(sep_at_year == "/", day("d/M/yyyy")),
        F.when((n >= 4) & (n <= 6) & s.rlike(r"^\d{4,6}$"),
               F.date_add(F.lit(EXCEL_EPOCH).cast("date"), s.cast("int"))),
        F.when(s.rlike("[A-Za-z]{3}"), F.coalesce(*[day(fmt) for fmt in WORD_DATE_FORMATS])),
    ]
    tries += [day(fmt) for fmt in EXTRA_DATE_FORMATS]
    bare = F.regexp_replace(s, _TIME, "")
    tries.append(F.when(s.contains(":"), F.coalesce(*[day(fmt, bare) for fmt in TIMED_DATE_FORMATS])))
    return F.when(s != "", F.coalesce(*tries))


def is_total_label(col: Column | str) -> Column:
    """F2 predicate: text (lower, trimmed) is 'total' or starts with 'total '."""
    s = F.lower(trimmed(col))
    return (s == F.lit("total")) | s.startswith("total ")


def parse_date(col: Column | str) -> Column:
    """Day-first text, Excel serial (4-6 digits), then other layouts; anything else is null."""
    return parse_date_text(trimmed(col))


def parse_amount(col: Column | str) -> Column:
    """N1; '' -> 0; a number; else keep [0-9.-] and retry; else 0 (rounded half-up from the text, D3)."""
    return parse_amount_text(norm_text(col))


def round_rupee(col: Column | str) -> Column:
    """Whole rupees, half to even (a decimal, so no amount overflows)."""
    return F.bround(_c(col), 0).cast("decimal(38,0)")


def display_date(col: Column | str) -> Column:
    """N7 display form dd-MM-yyyy, '' when missing."""
    return F.coalesce(F.date_format(_c(col), "dd-MM-yyyy"), F.lit(""))


def key_date(col: Column | str) -> Column:
    """N7 comparison key yyyyMMdd, '' when missing."""
    return F.coalesce(F.date_format(_c(col), "yyyyMMdd"), F.lit(""))


def iso_date(col: Column | str) -> Column:
    """N7 ISO text yyyy-MM-dd, '' when missing."""
    return F.coalesce(F.date_format(_c(col), "yyyy-MM-dd"), F.lit(""))


def concat_key(gstin: Column | str, inv: Column | str) -> Column:
    """N8: 'gstin|invoice'."""
    return F.concat_ws("|", _c(gstin), _c(inv))


def fuzzy_gstin(col: Column | str) -> Column:
    """Upper, then O->0, Z->2, I->1, L->1, B->8."""
    return F.translate(F.upper(_c(col)), FUZZY_GSTIN_FROM, FUZZY_GSTIN_TO)


def fuzzy_invoice(col: Column | str) -> Column:
    """Upper, keep [A-Z0-9]."""
    return F.regexp_replace(F.upper(_c(col)), r"[^A-Z0-9]", "")


def is_gstin(col: Column | str) -> Column:
    """The whole trimmed text is a GSTIN (any case)."""
    s = trimmed(col)
    return (F.length(s) == 15) & s.rlike("(?i)" + GSTIN_PATTERN)


def is_valid_name(col: Column | str) -> Column:
    """A name that is present and is not itself a GSTIN."""
    return (F.coalesce(_c(col), F.lit("")) != "") & ~is_gstin(col)


def tax_period_start(date_col: Column | str) -> Column:
    """Filing day >= 12 -> that month, else the month before (first day)."""
    d = _c(date_col)
    return F.trunc(F.when(F.dayofmonth(d) >= 12, d).otherwise(F.add_months(d, -1)), "MM")


def tax_period_text(date_col: Column | str) -> Column:
    """N12 text form 'MMM yyyy', '' when missing."""
    return F.coalesce(F.date_format(tax_period_start(date_col), "MMM yyyy"), F.lit(""))


def month_text(date_col: Column | str) -> Column:
    """N13 period form 'MMM-yyyy'."""
    return F.date_format(_c(date_col), "MMM-yyyy")


#: Month layouts tried before MMYYYY / YYYYMM tails and full dates.
MONTH_FORMATS = ("MMM yyyy", "MMMM yyyy", "M/yyyy", "M-yyyy", "yyyy-M", "yyyy/M", "MMM-yyyy", "MMMM-yyyy", "M yyyy",
                 "yyyy MMM", "yyyy MMMM")


def _may_match(s: Column, fmt: str) -> Column:
    """A layout without a name of a month reads no letter, one with a name needs some, and either needs its separator: a
    failed parse costs far more than these tests."""
    letters = s.rlike("[A-Za-z]")
    return s.contains(fmt.strip("My")) & (letters if "MMM" in fmt else ~letters)


_SHORT_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _short_month(s: Column) -> Column:
    """'Jan 2024' and 'Jan-2024' without a formatter, which costs some microseconds a text; null for any other text."""
    at = F.position(F.lower(F.substring(s, 1, 3)), F.lit(_SHORT_MONTHS))
    plain = s.rlike("^[A-Za-z]{3}[ -](?!0000)[0-9]{4}$") & (at % 3 == 1)
    return F.when(plain, F.make_date(F.substring(s, 5, 4).cast("int"), ((at + 2) / 3).cast("int"), F.lit(1)))


def parse_month(col: Column | str) -> Column:
    """N15: 'Jan 2024', '01/2024', '2024-01', '012024', '202401' or a full date -> first day of the month."""
    s = trimmed(col)
    digits = F.regexp_extract(s, r"(\d{6})$", 1)
    month_first = F.regexp_extract(digits, r"^(0[1-9]|1[0-2])((?:19|20)\d{2})$", 0)
    year_first = F.regexp_extract(digits, r"^((?:19|20)\d{2})(0[1-9]|1[0-2])$", 0)
    tail = F.coalesce(
        F.when(month_first != "", F.make_date(F.substring(digits, 3, 4).cast("int"), F.substring(digits, 1, 2).cast("int"), F.lit(1))),
        F.when(year_first != "", F.make_date(F.substring(digits, 1, 4).cast("int"), F.substring(digits, 5, 2).cast("int"), F.lit(1))))
    named = [F.when(_may_match(s, f), F.to_date(F.try_to_timestamp(s, F.lit(f)))) for f in MONTH_FORMATS]
    return F.coalesce(_short_month(s), *named, tail,
                      F.when(~s.rlike(r"^\d+$"), F.trunc(parse_date_text(s), "MM")))


def coerce_number(col: Column | str) -> Column:
    """Drop commas and the text 'nan' (any case), trim, number or 0.

    The number keeps its decimals (a rate of 0.125 stays 0.125).
    """
    s = F.coalesce(_c(col).cast("string"), F.lit(""))
    s = F.translate(s, ",", "")
    s = strip_ws(F.when(F.lower(s).contains("nan"), F.regexp_replace(s, "(?i)nan", "")).otherwise(s))
    return F.coalesce(s.try_cast(NUMBER), F.lit(0).cast(NUMBER))


#: Text that is a number, whole or not, in the notation of spreadsheets.
NUMBER_PATTERN = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"


def is_number(c: str) -> Column:
    """The text parses as a number (a suffix such as ``1D`` does not count, whatever the engine's cast takes)."""
    return F.col(c).rlike(NUMBER_PATTERN)
