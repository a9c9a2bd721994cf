"""Locating quotes in page text and judging whether they support a claim, as column expressions.

Offsets count characters from 0; an end is exclusive. Looser tiers match with a regular expression made from the quote,
so offsets come from the page itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SPACE, col, let, squash
from ..functions.numbers import numbers_in, parse_numeric_literal
from ..functions.text import normalize_text

#: Lines that a scattered quote may be gathered from.
SCATTER_LINES = 3
# Words that say how a value is printed, not what it is.
NOT_IDENTIFYING = ["rs", "inr", "usd", "eur", "gbp", "cr", "crore", "crores", "lakh", "lakhs", "mn", "bn", "million", "billion", "thousand", "and", "the", "for", "per"]


def _spot(method: str, start: Column, end: Column) -> Column:
    return F.struct(F.lit(method).alias("method"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def _spaced(text: Column) -> Column:
    """A pattern for text with any white space between its words."""
    quoted = F.regexp_replace(text, "([^\\p{L}\\p{N}\\s])", "\\\\$1")
    return F.regexp_replace(quoted, f"{SPACE}+", f"{SPACE.replace(chr(92), chr(92) * 2)}+")


def _by_pattern(method: str, page: Column, pattern: Column) -> Column:
    """Where pattern first matches page; null if it doesn't."""
    at = F.regexp_instr(page, pattern)
    return F.when(at > 0, _spot(method, at - 1, at - 1 + F.length(F.regexp_substr(page, pattern))))


def _fold(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def _folded(page: Column, quote: Column) -> Column:
    """Where the letters and digits of the quote, eight at least, follow each other, whatever lies between them."""

    def spot(at: Column, size: Column) -> Column:
        # Characters with a letter or digit of ASCII in their lower case, so that places count characters of the page.
        letters = lambda chars: F.filter(F.sequence(F.lit(0), F.size(chars) - 1), lambda k: F.get(chars, k).rlike("[A-Za-z0-9\u0130\u212a]"))
        return let(let(F.split(page, ""), letters), lambda p: _spot("folded", F.get(p, at - 1), F.get(p, at + size - 2) + 1))

    hit = lambda q: let(F.when(F.length(q) >= 8, F.instr(_fold(page), q)), lambda at: F.when(at > 0, spot(at, F.length(q))))
    return let(_fold(quote), hit)


def significant_tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9.]*"), F.lit(0)), lambda t: F.length(t) >= 2)


def _scattered(page: Column, quote: Column) -> Column:
    """The fewest consecutive lines, at most SCATTER_LINES, that hold all tokens of the quote; the earliest of those."""

    def inside(want: Column, lines: Column) -> Column:
        def run(size: int) -> Column:
            starts = F.sequence(F.lit(0), F.greatest(F.size(lines) - size, F.lit(0)))
            has = lambda k: F.size(F.array_except(want, significant_tokens(F.array_join(F.slice(lines, k + 1, F.lit(size)), " ")))) == 0
            place = lambda k: F.coalesce(F.aggregate(F.slice(lines, F.lit(1), k), F.lit(0), lambda n, x: n + F.length(x) + 1), F.lit(0))
            spot = lambda k: let(place(k), lambda n: _spot("scattered", n, n + F.length(F.array_join(F.slice(lines, k + 1, F.lit(size)), "\n"))))
            return F.when(F.size(lines) >= size, let(F.get(F.filter(starts, has), F.lit(0)), lambda k: F.when(k.isNotNull(), spot(k))))

        return F.when(F.size(want) >= 2, F.coalesce(*[run(n) for n in range(1, SCATTER_LINES + 1)]))

    return let(significant_tokens(quote), lambda want: let(F.split(page, "\n"), lambda lines: inside(want, lines)))


def anchored(page: Column, quote: Column) -> Column:
    """From the quote's first three words to its last three, unless that is three times as long as the quote."""

    def inside(words: Column) -> Column:
        head, tail = F.array_join(F.slice(words, 1, 3), " "), F.array_join(F.slice(words, F.size(words) - 2, F.lit(3)), " ")
        pattern = F.concat(F.lit("(?isu)(?="), _spaced(head), F.lit(").*?"), _spaced(tail))
        near = lambda hit: F.length(squash(F.substr(page, hit["start"] + 1, hit["end"] - hit["start"]))) - 1 < 3 * F.length(squash(quote))
        return F.when(F.size(words) >= 4, let(_by_pattern("anchored", page, pattern), lambda hit: F.when(near(hit), hit)))

    return let(F.filter(F.split(squash(quote), " "), lambda w: F.length(w) > 1), inside)


def trimmed(quote: Column | str) -> Column:
    return F.regexp_replace(col(quote), f"^{SPACE}+|{SPACE}+$", "")


#: Characters whose upper case has another lower case than they have, with that one: both count as the same letter.
TWINS = {c: c.upper().lower() for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) == 1 and len(c.upper().lower()) == 1 and c.upper().lower() != c.lower()}


def _caseless(text: Column) -> Column:
    """text in lower case, with as many characters as before."""
    return F.translate(F.lower(F.translate(text, "\u0130", "i")), "".join(TWINS), "".join(TWINS.values()))


def near(page: Column, quote: Column) -> Column:
    """The tiers that a search for the trimmed quote settles: exact, whitespace, caseless.

    Where white space doesn't count, page and quote are compared with single spaces, and the runs of the page's white
    space before a place tell where it was. No pattern is made from a quote: a long one would exhaust the matcher's stack.
    """
    spaces = lambda text: F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    single = lambda text: F.regexp_replace(text, f"{SPACE}+", " ")

    def spot(method: str, at: Column, wide: Column, q: Column) -> Column:
        # How much longer the first n runs are than single spaces.
        more = lambda n: F.aggregate(F.slice(F.regexp_extract_all(page, F.lit(f"{SPACE}+"), F.lit(0)), F.lit(1), n), -n, lambda size, run: size + F.length(run))
        before = lambda n: _spot(method, at - 1 + more(n), at - 1 + F.length(q) + more(n + spaces(q)))
        return F.when(at > 0, let(spaces(F.substr(wide, F.lit(1), at - 1)), before))

    def looser(wide: Column, q: Column) -> Column:
        return F.coalesce(let(F.instr(wide, q), lambda at: spot("whitespace", at, wide, q)), let(F.instr(_caseless(wide), _caseless(q)), lambda at: spot("caseless", at, wide, q)))

    at = F.instr(page, quote)
    return F.coalesce(F.when(at > 0, _spot("exact", at - 1, at - 1 + F.length(quote))), let(single(page), lambda wide: let(single(quote), lambda q: looser(wide, q))))


def locate(page: Column | str, quote: Column | str) -> Column:
    """struct<method, start, end> of the quote: exact, whitespace, caseless, folded, scattered, anchored; null if absent."""
    inside = lambda page, q: F.when(F.length(q) >= 3, F.coalesce(near(page, q), _folded(page, q), _scattered(page, q), anchored(page, q)))
    return let(col(page), lambda p: let(trimmed(quote), lambda q: inside(p, q)))


def widen_to_lines(page: Column, start: Column, end: Column) -> Column:
    """struct<start, end> of the printed lines around a range."""
    before = F.substr(page, F.lit(1), start)
    first = F.when((start == 0) & page.startswith("\n"), 1).otherwise(start - F.length(F.substring_index(before, "\n", -1)))
    rest = F.substr(page, F.greatest(end, F.lit(1)))
    stop = F.instr(rest, F.lit("\n"))
    last = F.when(stop > 0, F.greatest(end, F.lit(1)) + stop - 2).otherwise(F.length(page))
    return F.struct(first.cast("int").alias("start"), last.cast("int").alias("end"))


def has_identifying_context(span: Column) -> Column:
    return F.lower(span).rlike(f"(?<![a-z])(?!(?:{'|'.join(NOT_IDENTIFYING)})(?![a-z]))[a-z]{{3,}}")


def value_appears(kind: Column, raw: Column, quote: Column) -> Column:
    """A number's magnitude among the quote's numbers; a text's normal form, or four fifths of its words, in the quote."""
    size = lambda want: F.exists(numbers_in(quote), lambda n: (n == want) | (F.abs(n - want) < 1e-6 * F.greatest(n, want)))
    number = let(F.abs(parse_numeric_literal(raw)), lambda want: want.isNotNull() & size(want))

    def words(want: Column, have: Column) -> Column:
        mine, theirs = F.split(want, " "), F.split(have, " ")
        share = F.size(F.filter(mine, lambda w: F.array_contains(theirs, w))) / F.size(mine)
        return (want != "") & (have.contains(want) | (share >= 0.8))

    # An ASCII letter or digit stays in a normal form.
    text = F.when(raw == quote, raw.rlike("[A-Za-z0-9]") | (normalize_text(raw) != "")).otherwise(let(normalize_text(raw), lambda want: let(normalize_text(quote), lambda have: words(want, have))))
    return F.coalesce(F.when(kind == "number", number).otherwise(text), F.lit(False))


def _status(name: str, method: Column | None = None, place: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(
        F.lit(name).alias("status"), (method if method is not None else F.lit("none")).alias("method"),
        (place["start"] if place is not None else none).alias("start"), (place["end"] if place is not None else none).alias("end"),
    )


def page_not_found() -> Column:
    return _status("page_not_found")


def quote_not_found() -> Column:
    return _status("quote_not_found")


def judged_lines(lines: Column, place: Column, hit: Column, quote: Column, kind: Column, raw: Column) -> Column:
    """The status of a claim whose quote was found at hit, within lines at place."""
    return (
        F.when(~has_identifying_context(lines), _status("quote_lacks_context", hit["method"], hit))
        .when(~value_appears(kind, raw, quote), _status("value_not_in_quote", hit["method"], place))
        .otherwise(_status("grounded", hit["method"], place))
    )


def judged(page: Column, hit: Column, quote: Column, kind: Column, raw: Column) -> Column:
    """The status of a claim whose quote was looked for in page and found at hit, or nowhere."""
    lined = lambda line: judged_lines(F.substr(page, line["start"] + 1, line["end"] - line["start"]), line, hit, quote, kind, raw)
    return F.when(hit.isNull(), quote_not_found()).otherwise(let(widen_to_lines(page, hit["start"], hit["end"]), lined))


def ground(page: Column | str, quote: Column | str, kind: Column | str, raw: Column | str) -> Column:
    """struct<status, method, start, end>; status is the first that holds.

    page_not_found, quote_not_found, quote_lacks_context (offsets of the quote), value_not_in_quote, grounded (offsets
    of its lines).
    """
    quote, kind, raw = col(quote), col(kind), col(raw)
    page = F.coalesce(col(page), F.lit(""))
    return let(page, lambda p: F.when(p == "", page_not_found()).otherwise(let(locate(p, quote), lambda hit: judged(p, hit, quote, kind, raw))))


def boxes_for_range(spans: Column | str, start: Column | str, end: Column | str) -> Column:
    """array<struct<x, y, w, h>>: one box per printed line of the spans (s, e, x, y, w, h) that touch a range."""

    def merged(hits: Column) -> Column:
        bucket = lambda s: F.floor(s["y"] / 4 + 0.5)
        rows = F.array_distinct(F.transform(hits, bucket))

        def box(own: Column) -> Column:
            low = lambda c: F.array_min(F.transform(own, c))
            high = lambda c: F.array_max(F.transform(own, c))
            corner = F.struct(low(lambda s: s["x"]).alias("x"), low(lambda s: s["y"]).alias("y"))
            size = lambda at: F.struct(at["x"].alias("x"), at["y"].alias("y"), (high(lambda s: s["x"] + s["w"]) - at["x"]).alias("w"), (high(lambda s: s["y"] + s["h"]) - at["y"]).alias("h"))
            return let(corner, size)

        return F.transform(rows, lambda row: let(F.filter(hits, lambda s: bucket(s) == row), box))

    # The range is evaluated once, not for every span.
    touching = lambda at: F.filter(col(spans), lambda s: (s["e"] > at["start"]) & (s["s"] < at["end"]))
    return let(F.struct(col(start).alias("start"), col(end).alias("end")), lambda at: let(touching(at), merged))


def ground_claims(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """claims with a grounding struct, by their pages (document_id, page_number, text)."""
    text = pages.select("document_id", "page_number", F.col("text").alias("__page"))
    joined = claims.join(text, ["document_id", "page_number"], "left")
    return joined.withColumn("grounding", ground("__page", "quote", "value_kind", "value_raw")).drop("__page")
