"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript's \s and str.strip() see it; Java's \s is ASCII only.
SPACE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
#: ASCII word boundaries: before and after a word. Java's \b also counts letters beyond ASCII.
AT, TO = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), with value evaluated once however often fn uses it."""
    return F.transform(F.array(value), fn)[0]


def _literal(x) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else f"{x}D" if isinstance(x, float) else str(x)


def lookup(table: dict, key: Column, kind: str = "string") -> Column:
    """table[key], null for unknown keys."""
    entries = ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({entries})"), key).cast(kind)


def squash(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match; null if there is none or the group took no part."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def words_at(words, before: str = AT, after: str = TO) -> str:
    return before + "(?:" + "|".join(words) + ")" + after
