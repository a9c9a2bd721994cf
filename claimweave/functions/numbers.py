"""Numeric literals, scales, currencies and units, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import AT, SPACE, TO, col, let, lookup, squash

NUMBER = r"\d[\d,]*(?:\.\d+)?|\.\d+"

# Scale words.
SCALES = {
    "hundred": 1e2,
    "thousand": 1e3, "k": 1e3,
    "lakh": 1e5, "lac": 1e5, "lakhs": 1e5, "lacs": 1e5,
    "million": 1e6, "millions": 1e6, "mn": 1e6, "mln": 1e6, "m": 1e6,
    "crore": 1e7, "crores": 1e7, "cr": 1e7,
    "billion": 1e9, "billions": 1e9, "bn": 1e9, "b": 1e9,
    "lakh crore": 1e12, "lac crore": 1e12, "trillion": 1e12, "tn": 1e12, "tr": 1e12,
}
# Names of currencies.
CURRENCIES = {
    "₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "rupees": "INR", "rupee": "INR",
    "$": "USD", "us$": "USD", "usd": "USD", "dollars": "USD",
    "€": "EUR", "eur": "EUR",
    "£": "GBP", "gbp": "GBP",
}
# Units, each with its base unit and factor.
UNITS = {
    "%": ("%", 1.0), "percent": ("%", 1.0), "percentage": ("%", 1.0), "pct": ("%", 1.0), "per cent": ("%", 1.0),
    "bps": ("%", 0.01), "bp": ("%", 0.01), "basis points": ("%", 0.01), "percentage points": ("%", 1.0), "pp": ("%", 1.0),
    "days": ("days", 1.0), "day": ("days", 1.0), "months": ("months", 1.0), "years": ("years", 1.0),
    "count": ("count", 1.0), "units": ("count", 1.0),
    "tonnes": ("kg", 1000.0), "tonne": ("kg", 1000.0), "mt": ("kg", 1000.0), "kg": ("kg", 1.0),
    "km": ("m", 1000.0), "m2": ("m2", 1.0), "sq ft": ("m2", 0.092903), "sqft": ("m2", 0.092903),
}


def parse_numeric_literal(raw: Column | str) -> Column:
    """The first number in raw; negative behind a minus sign, or with ( before it and ) after its beginning."""

    def signed(raw: Column, at: Column, size: Column) -> Column:
        before, rest = F.substr(raw, F.lit(1), at - 1), F.substr(raw, at)
        minus = before.rlike(f"-{SPACE}*$") | (before.contains("(") & rest.contains(")"))
        return F.when(size < float("inf"), F.when(minus, -size).otherwise(size))

    size = lambda raw: F.replace(F.regexp_extract(raw, NUMBER, 0), F.lit(",")).try_cast("double")
    return let(col(raw), lambda r: let(F.regexp_instr(r, F.lit(NUMBER)), lambda at: let(size(r), lambda n: signed(r, at, n))))


def numbers_in(text: Column | str) -> Column:
    """All numbers in text, without signs."""
    return F.transform(F.regexp_extract_all(col(text), F.lit(NUMBER), F.lit(0)), lambda m: F.replace(m, F.lit(",")).try_cast("double"))


def _key(c: Column) -> Column:
    return F.lower(squash(F.coalesce(c, F.lit(""))))


def normalize_number(number: Column | str, raw: Column | str, unit: Column | str, scale: Column | str, currency: Column | str) -> Column:
    """struct<value, unit> in base units; null without a number. An unknown unit is its own base, an unknown scale 1."""
    number = col(number)
    size = F.when(F.isnan(number) | F.abs(number).isin(float("inf")), None).otherwise(number)
    size = F.coalesce(size, parse_numeric_literal(raw)) * F.coalesce(lookup(SCALES, _key(col(scale)), "double"), F.lit(1.0))

    def based(size: Column, unit: Column, code: Column) -> Column:
        factor = lookup({k: v[1] for k, v in UNITS.items()}, unit, "double")
        base = lookup({k: v[0] for k, v in UNITS.items()}, unit)
        value = F.when(code.isNull(), size * F.coalesce(factor, F.lit(1.0))).otherwise(size)
        return F.when(size.isNotNull(), F.struct(value.alias("value"), F.coalesce(code, base, F.nullif(unit, F.lit("")), F.lit("count")).alias("unit")))

    code = lambda unit: lookup(CURRENCIES, F.coalesce(F.nullif(_key(col(currency)), F.lit("")), unit))
    return let(size, lambda n: let(_key(col(unit)), lambda u: let(code(u), lambda c: based(n, u, c))))


def units_comparable(a: Column | str, b: Column | str) -> Column:
    return col(a) == col(b)


def _grouped(value: Column, digits: int, groups: str) -> Column:
    """value rounded half away from zero to at most digits decimals, with group separators."""

    def shown(scaled: Column) -> Column:
        whole = F.floor(scaled / 10**digits).cast("decimal(38,0)").cast("string")
        part = F.rtrim(F.lpad((scaled % 10**digits).cast("decimal(38,0)").cast("string"), digits, "0"), F.lit("0"))
        sign = F.when((value < 0) & (scaled > 0), "-").otherwise("")
        return F.concat(sign, F.regexp_replace(whole, groups, ","), F.rtrim(F.concat(F.lit("."), part), F.lit(".")))

    return let(F.floor(F.abs(value) * 10**digits + 0.5).cast("decimal(38,0)"), shown)


#: Where separators stand: every three digits, or three and then every two.
WESTERN, INDIAN = r"(?<=\d)(?=(?:\d{3})+$)", r"(?<=\d)(?=(?:\d\d)*\d{3}$)"


def format_normalized(value: Column | str, unit: Column | str) -> Column:
    """Readable magnitude: rupees in crore or lakh with two decimals, anything else with three."""

    def shown(v: Column, unit: Column) -> Column:
        size = F.abs(v)
        by = F.when(size >= 1e7, 1e7).when(size >= 1e5, 1e5).otherwise(1.0)
        word = F.when(size >= 1e7, " crore").when(size >= 1e5, " lakh").otherwise("")
        rupees = F.concat(F.lit("₹"), let(v / by, lambda x: _grouped(x, 2, INDIAN)), word)
        tail = F.when(unit == "%", unit).when(unit == "", "").otherwise(F.concat(F.lit(" "), unit))
        return F.when(unit == "INR", rupees).otherwise(F.concat(_grouped(v, 3, WESTERN), tail))

    return let(col(value), lambda v: let(col(unit), lambda u: shown(v, u)))


# How documents print scale words.
SCALE_FORMS = {
    "crore": ["crore", "cr"], "lakh": ["lakh", "lac"], "million": ["million", "mn", "mln"], "billion": ["billion", "bn"], "thousand": ["thousand", "k"],
}


def value_text(kind: Column | str, raw: Column | str, scale: Column | str, unit: Column | str, currency: Column | str) -> Column:
    """The printed value, with the scale and the currency or unit that it doesn't show itself."""
    text = squash(col(raw))
    low, word = F.lower(text), F.lower(squash(F.coalesce(col(scale), F.lit(""))))
    forms = lookup({k: "|".join(v) for k, v in SCALE_FORMS.items()}, word)
    shows_scale = (word == "") | F.regexp_like(low, F.concat(F.lit(AT + "(?:"), F.coalesce(forms, F.concat(F.lit("\\Q"), word, F.lit("\\E"))), F.lit(")" + TO)))
    of = F.coalesce(col(currency), col(unit), F.lit(""))
    money = text.rlike("[₹$€£]") | low.rlike(AT + "(?:rs|inr|usd|eur|gbp)" + TO)
    shows_unit = (F.instr(low, F.lower(of)) > 0) | (of == "") | (F.lower(of).isin("inr", "usd") & money)
    full = F.concat_ws(" ", text, F.when(~shows_scale, col(scale)), F.when(~shows_unit, of))
    return F.when(col(kind) == "number", full).otherwise(col(raw))
