"""Grounding of many claims through indexes of their pages, each built once for all claims of a page.

Spark brings the claims of a page together, a few hundred at a time, and takes the page's text to them. Of a text there
are built, when the first quote needs them: the text with single spaces and in one case (whitespace and caseless quotes),
its letters and digits (folded), an inverted file of the words of its lines (scattered). What those don't find is looked
for by its first and last words (anchored). Whether a place supports its claim is judged by column expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate, islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import grounding as G
from .work import save

PAGE = ["document_id", "page_number"]
#: Claims of a page that are located together at most, and rows of pages and claims that Python unpacks at a time.
TOGETHER, ROWS = 256, 256
#: White space as columns.SPACE has it.
_WHITE = " \t\n\x0b\x0c\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: White space that isn't a single space.
_WIDE = re.compile(f"[{_WHITE}]{{2,}}|[{_WHITE[1:]}]")
_TWIN, _TWINS = re.compile(f"[{''.join(G.TWINS)}]"), str.maketrans(G.TWINS)
#: Characters that have a letter or digit of ASCII in their lower case, one each.
_LETTERS, _OTHERS = re.compile("[A-Za-z0-9\u0130\u212a]+"), re.compile("[^A-Za-z0-9\u0130\u212a]+")
_TOKEN = re.compile("[a-z0-9][a-z0-9.]+")


def _caseless(text: str) -> str:
    """text in lower case, with as many characters as before."""
    low = text.lower() if text.isascii() else text.replace("\u0130", "i").lower()
    return low if text.isascii() or not _TWIN.search(low) else low.translate(_TWINS)


class _Page:
    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def single(self) -> tuple[str, list[int], list[int]]:
        """The text with single spaces; places in it behind which the text has more white space, and how much more in all."""
        parts, places, more, done, size = [], [], [0], 0, 0
        for m in _WIDE.finditer(self.text):
            parts += [self.text[done : m.start()], " "]
            size += m.start() - done + 1
            done = m.end()
            if done - m.start() > 1:
                places.append(size)
                more.append(more[-1] + done - m.start() - 1)
        return "".join([*parts, self.text[done:]]), places, more

    @cached_property
    def caseless(self) -> str:
        return _caseless(self.single[0])

    @cached_property
    def runs(self) -> list[str]:
        return _LETTERS.findall(self.text)

    @cached_property
    def folded(self) -> str:
        return "".join(self.runs).replace("\u0130", "i").lower()

    @cached_property
    def letters(self) -> tuple[list[int], list[int]]:
        """Of each run of letters and digits its place among them, and how many other characters are before it."""
        others = list(accumulate(map(len, _OTHERS.findall(self.text)), initial=0))
        return list(accumulate(map(len, self.runs), initial=0)), others if _LETTERS.match(self.text) else others[1:]

    @cached_property
    def words(self) -> dict[str, list[int]]:
        """The lines of each word, ascending."""
        held: dict[str, list[int]] = {}
        for k, line in enumerate(self.text.lower().split("\n")):
            for word in set(_TOKEN.findall(line)):
                held.setdefault(word, []).append(k)
        return held

    def _place(self, start: int, end: int) -> tuple[int, int]:
        """The place in the text of a place between single spaces, which begins and ends without one."""
        _, places, more = self.single
        return start + more[bisect_left(places, start + 1)], end + more[bisect_left(places, end)]

    def _scattered(self, quote: str) -> tuple[int, int] | None:
        words = _TOKEN.findall(quote.lower())
        held = [self.words.get(word) for word in set(words)]
        if len(words) < 2 or None in held:
            return None
        held.sort(key=len)
        lines = self.text.split("\n")
        for size in range(1, G.SCATTER_LINES + 1):
            for k in sorted({k for line in held[0] for k in range(line - size + 1, line + 1) if 0 <= k <= len(lines) - size}):
                if all((n := bisect_left(own, k)) < len(own) and own[n] < k + size for own in held):
                    start = sum(len(line) + 1 for line in lines[:k])
                    return start, start + sum(len(line) + 1 for line in lines[k : k + size]) - 1
        return None

    def _anchored(self, quote: str) -> tuple[int, int] | None:
        words = [word for word in quote.split(" ") if len(word) > 1]
        start = self.caseless.find(_caseless(" ".join(words[:3]))) if len(words) >= 4 else -1
        tail = _caseless(" ".join(words[-3:]))
        end = self.caseless.find(tail, start) + len(tail) if start >= 0 else -1
        return self._place(start, end) if start >= 0 and end >= start + len(tail) and end - start - 1 < 3 * len(quote) else None

    def find(self, quote: str) -> tuple[str, int, int] | None:
        """Method, start, end of a trimmed quote, by the first tier that finds it."""
        if (at := self.text.find(quote)) >= 0:
            return "exact", at, at + len(quote)
        quote = _WIDE.sub(" ", quote)
        if (at := self.single[0].find(quote)) >= 0:
            return "whitespace", *self._place(at, at + len(quote))
        if (at := self.caseless.find(_caseless(quote))) >= 0:
            return "caseless", *self._place(at, at + len(quote))
        letters = "".join(_LETTERS.findall(quote)).replace("\u0130", "i").lower()
        if len(letters) >= 8 and (at := self.folded.find(letters)) >= 0:
            folds, others = self.letters
            first, last = (others[bisect_left(folds, x + 1) - 1] for x in (at, at + len(letters) - 1))
            return "folded", at + first, at + len(letters) + last
        if (place := self._scattered(quote)) is not None:
            return "scattered", *place
        if (place := self._anchored(quote)) is not None:
            return "anchored", *place
        return None

    def hit(self, quote: str | None) -> dict | None:
        """Where a quote is, and the printed lines around it."""
        quote = (quote or "").strip(_WHITE)
        found = self.find(quote) if len(quote) >= 3 else None
        if found is None:
            return None
        method, start, end = found
        first = 1 if start == 0 and self.text.startswith("\n") else self.text.rfind("\n", 0, start) + 1
        last = self.text.find("\n", max(end, 1) - 1)
        last = last if last >= 0 else len(self.text)
        return {"method": method, "start": start, "end": end, "first": first, "last": last, "lines": self.text[first:last]}


_HITS = pa.list_(pa.struct([("method", pa.string()), *[(name, pa.int32()) for name in ("start", "end", "first", "last")], ("lines", pa.string())]))


def hits(rows: DataFrame, text: str, claims: str) -> DataFrame:
    """rows without the column text and with hits: where the field quote of each of the array claims is in text, and the lines around it; null for what isn't found."""
    kept = [c for c in rows.columns if c != text]
    hit = T.StructType().add("method", "string").add("start", "integer").add("end", "integer").add("first", "integer").add("last", "integer").add("lines", "string")
    schema = T.StructType([rows.schema[c] for c in kept]).add("hits", T.ArrayType(hit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                told = batch.column(claims)
                quotes, sizes = iter(told.flatten().field("quote").to_pylist()), pc.list_value_length(told).to_pylist()
                found = [list(map(_Page(page).hit, islice(quotes, size or 0))) for page, size in zip(batch.column(text).to_pylist(), sizes)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found, _HITS)], names=[*kept, "hits"])

    return rows.withColumn(text, F.coalesce(text, F.lit(""))).mapInArrow(run, schema)


def ground_by_index(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """claims with a grounding struct, as ground_claims gives it; pages (document_id, page_number, text) has one row per page.

    Claims without a page, or whose page has no text, are page_not_found; null and short quotes are quote_not_found.
    Rows that repeat a claim get a grounding each. Further columns of claims are kept. A page with more than TOGETHER claims
    is read once for each so many, so no task or row has to hold all of them.
    """
    rows = save(claims.withColumn("__claim", F.monotonically_increasing_id()), "claims")
    part = F.floor(F.col("__claim") / TOGETHER).alias("__part")
    own = F.struct(*[c for c in claims.columns if c not in PAGE])
    groups = rows.groupBy(*PAGE, part).agg(F.collect_list(own).alias("__claims")).drop("__part")
    text = pages.select(*PAGE, F.col("text").alias("__page"))
    found = groups.join(text, PAGE, "left").withColumn("__empty", F.coalesce("__page", F.lit("")) == "")
    each = hits(found, "__page", "__claims").select(*PAGE, "__empty", F.inline(F.arrays_zip("__claims", "hits")))
    each = each.select(*PAGE, "__empty", "__claims.*", F.col("hits").alias("__hit"))
    return each.withColumn("grounding", F.when(F.col("__empty"), G.page_not_found()).otherwise(_judged(F.col("__hit")))).select(*claims.columns, "grounding")


def _judged(hit: Column) -> Column:
    return F.when(hit.isNull(), G.quote_not_found()).otherwise(G.judged_lines(hit["lines"], F.struct(hit["first"].alias("start"), hit["last"].alias("end")), hit, F.col("quote"), F.col("value_kind"), F.col("value_raw")))
