"""Written periods as inclusive date intervals: struct<raw, kind, start, end>, dates as ISO strings.

Years, months and days are carried as integers and only printed at the end, so an impossible date that a document
prints (31 February) stays the string it is; compare them as strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import AT, SPACE, TO, col, found, let, lookup, squash

# Names of months.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6,
    "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11,
    "dec": 12, "december": 12,
}

_YEAR = r"\s*(?:of\s*)?(?:fy)?\s*'?(\d{4}|\d{2})"
QUARTER, HALF, MONTHS_TO_DATE = AT + r"q([1-4])" + _YEAR, AT + r"h([12])" + _YEAR, AT + r"(\d{1,2})\s*m" + _YEAR
ISO_DATE = AT + r"(\d{4})-(\d{1,2})-(\d{1,2})" + TO
DAY_FIRST = AT + r"(\d{1,2})(?:st|nd|rd|th)?\s+([a-z]+),?\s+(\d{4})" + TO
MONTH_FIRST = AT + r"([a-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})" + TO
DIGITS = AT + r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})" + TO
YEAR_ENDED = AT + r"(?:year|yr)\s+(?:ended|ending|end)" + TO
CALENDAR = AT + r"(?:cy|calendar\s+year)\s*'?(\d{4}|\d{2})"
SPANNING = r"(?:" + AT + r"fy|(?<![A-Za-z0-9_])(?=\d)|(?<=[A-Za-z0-9_])(?='))\s*'?(\d{4})\s*[-/]\s*(\d{2,4})" + TO
FISCAL = AT + r"fy\s*'?(\d{4}|\d{2})" + TO
BARE = r"^(?:in\s+|for\s+)?(\d{4})$"


def _iso(y: Column, m: Column, d: Column) -> Column:
    pad = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat_ws("-", y.cast("int").cast("string"), pad(m), pad(d))


def _int(c: Column, pattern: str, group: int) -> Column:
    return found(c, pattern, group).try_cast("int")


def expand_year(token: Column | str) -> Column:
    """Four digits as they are; two digits from 70 on are of the last century."""
    token = col(token)
    n = token.try_cast("int")
    return F.when(F.length(token) == 4, n).when(n >= 70, n + 1900).otherwise(n + 2000)


def months_span(label: Column, fy_start: Column, offset: Column, months: Column) -> tuple[Column, Column]:
    """Start and end of a window of months that begins offset months into the fiscal year that ends in year label."""
    span = let((label - F.when(fy_start == 1, 0).otherwise(1)) * 12 + fy_start - 1 + offset, lambda first: let(first + months - 1, lambda last: _span(first, last)))
    return span["start"], span["end"]


def _span(first: Column, last: Column) -> Column:
    year = F.floor(last / 12).cast("int")
    end = F.day(F.last_day(F.try_make_timestamp(year, (last % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")))
    return F.struct(_iso(F.floor(first / 12), first % 12 + 1, F.lit(1)).alias("start"), _iso(year, last % 12 + 1, end).alias("end"))


def fiscal_window(label: Column | str, fy_start: int | Column = 4, offset: int | Column = 0, months: int | Column = 12) -> Column:
    """struct<start, end>; a fiscal year is named for the year that it ends in."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    start, end = months_span(col(label), as_col(fy_start), as_col(offset), as_col(months))
    return F.struct(start.alias("start"), end.alias("end"))


def _clean(raw: Column) -> Column:
    low = F.regexp_replace(F.lower(squash(raw)), f"f\\.?{SPACE}*y\\.?", "fy")
    return squash(F.regexp_replace(low, "[\\u2010-\\u2015\\u2212]", "-"))


def _instant(s: Column) -> Column:
    """The first date in s, by form: ISO, day month year, month day year, day/month/year."""
    month = lambda pattern, g: lookup(MONTHS, F.coalesce(found(s, pattern, g), F.lit("")), "int")
    iso = _iso(_int(s, ISO_DATE, 1), _int(s, ISO_DATE, 2), _int(s, ISO_DATE, 3))
    day = _iso(_int(s, DAY_FIRST, 3), month(DAY_FIRST, 2), _int(s, DAY_FIRST, 1))
    named = _iso(_int(s, MONTH_FIRST, 3), month(MONTH_FIRST, 1), _int(s, MONTH_FIRST, 2))
    d, m = _int(s, DIGITS, 1), _int(s, DIGITS, 2)
    return (
        F.when(s.rlike(ISO_DATE), iso)
        .when(month(DAY_FIRST, 2).isNotNull(), day)
        .when(month(MONTH_FIRST, 1).isNotNull(), named)
        .when(m.between(1, 12) & d.between(1, 31), _iso(_int(s, DIGITS, 3), m, d))
    )


def parse_period(raw: Column | str, fy_start: int | Column = 4) -> Column:
    """The period that raw names; null if it names none. The first form that matches decides."""
    fy = fy_start if isinstance(fy_start, Column) else F.lit(fy_start)
    return let(col(raw), lambda r: let(_clean(r), lambda s: let(_instant(s), lambda date: _parsed(r, s, date, fy))))


def _parsed(raw: Column, s: Column, date: Column, fy: Column) -> Column:
    spanned = s.rlike(r"\d{4}\s*-\s*\d{2,4}")

    def within(pattern: str) -> Column:
        token = found(s, pattern, 2)
        return expand_year(token) + F.when((F.length(token) == 4) & spanned, 1).otherwise(0)

    def make(kind: str, start: Column, end: Column) -> Column:
        return F.struct(squash(raw).alias("raw"), F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"))

    zero, year = F.lit(0), F.lit(12)
    y, m = F.split_part(date, F.lit("-"), F.lit(1)).try_cast("int"), F.split_part(date, F.lit("-"), F.lit(2)).try_cast("int")
    ended = y + F.when((m >= fy) & (fy != 1), 1).otherwise(0)
    calendar, bare = expand_year(found(s, CALENDAR, 1)), _int(s, BARE, 1)
    whole = lambda n: (_iso(n, F.lit(1), F.lit(1)), _iso(n, F.lit(12), F.lit(31)))
    to_date = _int(s, MONTHS_TO_DATE, 1)
    return (
        F.when(s.rlike(QUARTER), make("quarter", *months_span(within(QUARTER), fy, (_int(s, QUARTER, 1) - 1) * 3, F.lit(3))))
        .when(s.rlike(HALF), make("half_year", *months_span(within(HALF), fy, (_int(s, HALF, 1) - 1) * 6, F.lit(6))))
        .when(to_date.between(1, 12), make("range", *months_span(within(MONTHS_TO_DATE), fy, zero, to_date)))
        .when(date.isNotNull() & s.rlike(YEAR_ENDED), make("fiscal_year", *months_span(ended, fy, zero, year)))
        .when(date.isNotNull(), make("instant", date, date))
        .when(s.rlike(CALENDAR), make("calendar_year", *whole(calendar)))
        .when(s.rlike(SPANNING), make("fiscal_year", *months_span(_int(s, SPANNING, 1) + 1, fy, zero, year)))
        .when(s.rlike(FISCAL), make("fiscal_year", *months_span(expand_year(found(s, FISCAL, 1)), fy, zero, year)))
        .when(bare.between(1900, 2100), make("calendar_year", *whole(bare)))
    )


def compare_periods(a: Column | str, b: Column | str) -> Column:
    """MISSING, EQUAL, BOUNDARY, A_CONTAINS_B, B_CONTAINS_A, DISJOINT or OVERLAP."""
    return let(col(a), lambda x: let(col(b), lambda y: _compared(x, y)))


def _compared(a: Column, b: Column) -> Column:
    a0, a1, b0, b1 = a["start"], a["end"], b["start"], b["end"]
    closes = ((a0 == a1) & (b0 != b1) & (a0 == b1)) | ((b0 == b1) & (a0 != a1) & (b0 == a1))
    return (
        F.when(a.isNull() | b.isNull(), "MISSING")
        .when((a0 == b0) & (a1 == b1), "EQUAL")
        .when(closes, "BOUNDARY")
        .when((a0 <= b0) & (a1 >= b1), "A_CONTAINS_B")
        .when((b0 <= a0) & (b1 >= a1), "B_CONTAINS_A")
        .when((a1 < b0) | (b1 < a0), "DISJOINT")
        .otherwise("OVERLAP")
    )


def period_months(p: Column | str) -> Column:
    return let(col(p), _months)


def _months(p: Column) -> Column:
    part = lambda c, k: F.split_part(c, F.lit("-"), F.lit(k)).try_cast("int")
    return part(p["end"], 1) * 12 + part(p["end"], 2) - part(p["start"], 1) * 12 - part(p["start"], 2) + 1


def period_label(p: Column | str) -> Column:
    return let(col(p), lambda p: F.coalesce(F.concat(p["raw"], F.lit(" ["), p["start"], F.lit(" → "), p["end"], F.lit("]")), F.lit("unscoped")))
