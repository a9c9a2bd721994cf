"""Page text to extraction units: running headers, headings, captions, salience and segmentation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SPACE, col, let, words_at

#: Sizes in characters: a page unit is closed at SOFT; a page beyond HARD is cut into blocks of BLOCK; LEAST is kept.
SOFT, HARD, BLOCK, LEAST = 9_000, 14_000, 4_000, 24
CAPTION_LINE = 100
HEADINGS, CAPTIONS = 4, 2

# Words of scale and basis captions, and of lines worth reading.
_SCALE = r"(?:crores?|lakhs?|lacs?|millions?|billions?|thousands?|mn|bn|cr)"
_SCALE_AFTER = r"(?:crores?|lakhs?|millions?|billions?|thousands?)"
_CURRENCY = r"(?:₹|rs\.?|inr|usd|us\$|\$|€|£)"
BASIS_WORDS = ["consolidated", "standalone", "unconsolidated", "combined", "restated", r"pro\s*forma", r"seasonally\s+adjusted", "annualised", "annualized", "provisional", "revised", "projected", "estimated"]
SIGNAL_WORDS = ["director", "chairman", "chairperson", "chief", "officer", "ceo", "cfo", "managing", "secretary", "auditor", "appoint", "resign", "retire", "ceased", "vacat", "incorporat", r"registered\s+office", r"corporate\s+office", "address", "situated", "premises", "promoter", "subsidiar", "acquir", "merger", "amalgamat", "headquarter", "located"]
DATE_WORDS = [r"fy\s*'?\d{2,4}", r"q[1-4]\s*fy", r"\d{4}\s*-\s*\d{2,4}", "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

SCALE_CAPTION = f"(?i){_CURRENCY}\\s*(?:in\\s+)?{_SCALE}(?![A-Za-z0-9_])|" + words_at([r"amounts?", "figures", "values"], after="") + rf"\s+(?:are\s+)?in\s+[a-z₹$.\s]{{0,24}}{_SCALE_AFTER}(?![A-Za-z0-9_])"
BASIS_CAPTION = "(?i)" + words_at(BASIS_WORDS)
SALIENT = r"(?i)\d|" + words_at(SIGNAL_WORDS) + "|" + words_at(DATE_WORDS)
NUMBERED = r"^\d+(\.\d+)*[.)]?\s+\S"


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def is_heading(line: Column | str) -> Column:
    """Short, no sentence end, and in capitals, numbered, or three fifths of its words capitalised."""

    def of(t: Column) -> Column:
        words = F.split(t, f"{SPACE}+")
        letters = F.regexp_replace(t, "[^A-Za-z]", "")
        titled = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]"))) / F.size(words) >= 0.6
        shape = (letters == F.upper(letters)) | t.rlike(NUMBERED) | titled
        return (t != "") & (F.length(t) <= 90) & ~t.rlike("[.;]$") & (F.size(words) <= 12) & (F.length(letters) >= 3) & shape

    return let(strip(line), of)


def scale_caption(line: Column | str) -> Column:
    return F.nullif(strip(F.regexp_extract(strip(line), SCALE_CAPTION, 0)), F.lit(""))


def basis_caption(line: Column | str) -> Column:
    return let(strip(line), lambda t: F.when(F.length(t) <= CAPTION_LINE, F.nullif(F.lower(F.regexp_extract(t, BASIS_CAPTION, 0)), F.lit(""))))


def first_unique(values: Column | str, n: int) -> Column:
    """The first n values that differ beyond case."""
    kept = F.filter(col(values), lambda v, k: ~F.exists(F.slice(col(values), F.lit(1), k), lambda w: F.lower(w) == F.lower(v)))
    return F.slice(kept, 1, n)


def is_salient(text: Column | str) -> Column:
    return col(text).rlike(SALIENT)


def running_headers(pages: DataFrame) -> DataFrame:
    """document_id, line, pages: lines among the first or last three of at least half (and three) of five pages or more."""
    lines = F.transform(F.split("text", "\n"), strip)
    edges = F.array_distinct(F.concat(F.slice(lines, 1, 3), F.when(F.size(lines) >= 3, F.slice(lines, -3, 3)).otherwise(lines)))
    sizes = pages.groupBy("document_id").agg(F.count("*").alias("n")).filter("n >= 5")
    seen = pages.select("document_id", F.explode(edges).alias("line")).filter(F.length("line").between(8, 120))
    counted = seen.groupBy("document_id", "line").agg(F.count("*").alias("pages")).filter("pages >= 3")
    return counted.join(sizes, "document_id").filter(F.col("pages") >= F.floor(F.col("n") * 0.5)).select("document_id", "line", "pages")


_SCALE_RE, _BASIS_RE, _SALIENT_RE = (re.compile(p.replace("(?i)", ""), re.I | re.A) for p in (SCALE_CAPTION, BASIS_CAPTION, SALIENT))


def _heading(t: str) -> bool:
    words, letters = t.split(), re.sub("[^A-Za-z]", "", t)
    if len(t) > 90 or t[-1] in ".;" or len(words) > 12 or len(letters) < 3:
        return False
    return letters.isupper() or bool(re.match(NUMBERED, t)) or sum("A" <= w[0] <= "Z" for w in words) >= 0.6 * len(words)


def _first(values: list[str], n: int) -> list[str]:
    return list({v.lower(): v for v in reversed(values)}.values())[::-1][:n]


def page_units(text: str, boilerplate: set[str]) -> Iterator[dict]:
    """Units of one page: headings stay in the text of a whole page, and close a unit where the page is cut into blocks."""
    whole = len(text) <= HARD
    limit = SOFT if whole else BLOCK
    headings, scales, bases, lines, start, at, size = [], [], [], [], 0, 0, 0

    def unit(end: int) -> Iterator[dict]:
        body = "\n".join(lines).strip()
        lines.clear()
        if len(body) >= LEAST:
            captions = _first(scales, CAPTIONS) + _first(bases, CAPTIONS)
            yield {"char_start": start, "char_end": end, "text": body, "headings": headings[-HEADINGS:], "captions": captions, "salient": bool(_SALIENT_RE.search(body))}

    for line in text.split("\n"):
        here, t = at, line.strip()
        at += len(line) + 1
        if not t or t in boilerplate:
            continue
        if m := _SCALE_RE.search(t):
            scales.append(m[0].strip())
        if len(t) <= CAPTION_LINE and (m := _BASIS_RE.search(t)):
            bases.append(m[0].strip().lower())
        heading = _heading(t)
        if heading and not whole:
            headings.append(t)  # the unit that it closes lists it too
            yield from unit(here)
            start = here
            continue
        if not lines:
            start, size = here, -1
        lines.append(line)
        size += len(line) + 1
        if heading:
            headings.append(t)
        elif size >= limit:
            yield from unit(at)
    if lines:
        yield from unit(at)


def segment(pages: DataFrame) -> DataFrame:
    """Units of all pages (document_id, page_number, text): document_id, page_number, unit, and the unit's columns."""
    headers = running_headers(pages).groupBy("document_id").agg(F.collect_set("line").alias("headers"))
    joined = pages.select("document_id", "page_number", "text").join(headers, "document_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                {"document_id": d, "page_number": n, "unit": k, **u}
                for d, n, text, h in zip(batch["document_id"], batch["page_number"], batch["text"], batch["headers"])
                for k, u in enumerate(page_units(text or "", set(h) if h is not None else set()))
            ]
            yield pd.DataFrame(out, columns=["document_id", "page_number", "unit", "char_start", "char_end", "text", "headings", "captions", "salient"])

    kinds = dict(pages.dtypes)
    return joined.mapInPandas(run, f"document_id {kinds['document_id']}, page_number {kinds['page_number']}, unit int, char_start int, char_end int, text string, headings array<string>, captions array<string>, salient boolean")


def render_prompt(title: Column | str, page: Column | str, headings: Column | str, captions: Column | str, text: Column | str) -> Column:
    """A unit with its context, for an extractor."""
    some = lambda label, c, sep: F.when(F.size(col(c)) > 0, F.concat(F.lit(label), F.array_join(col(c), sep)))
    return F.concat_ws(
        "\n", F.concat(F.lit("DOCUMENT: "), F.nullif(col(title), F.lit(""))), F.concat(F.lit("PAGE: "), col(page).cast("string")),
        some("SECTION CONTEXT: ", headings, " > "), some("SCOPE CAPTIONS ON THIS PAGE: ", captions, " | "), F.lit(""), F.lit("PAGE EXCERPT:"), col(text),
    )


#: Items of a page.
ITEM = ["str", "x", "y", "width", "height", "page_height"]
#: Pages that are laid out at a time.
PAGES = 256


def layout_pages(items: DataFrame, tolerance: float = 3.0, widest_gap: int = 12) -> DataFrame:
    """Text and spans of pages from positioned items (document_id, page, str, x, y, width, height, page_height).

    Items whose heights differ by at most tolerance from a line's first item share the line; gaps become spaces.
    """
    item = F.struct("str", *[F.col(c).cast("double").alias(c) for c in ITEM[1:]])
    return layout_items(items.groupBy("document_id", "page").agg(F.collect_list(item).alias("items")), tolerance, widest_gap)


def layout_items(pages: DataFrame, tolerance: float = 3.0, widest_gap: int = 12) -> DataFrame:
    """layout_pages of pages (document_id, page, items) whose items are an array of structs."""
    kinds = dict(pages.dtypes)
    span = pa.struct([("s", pa.int32()), ("e", pa.int32()), *[(c, pa.float64()) for c in "xywh"]])
    padding = pa.array([" " * k for k in range(widest_gap + 1)])

    def laid(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = batch.column("items")
        items = told.flatten()
        sizes = np.asarray(pc.fill_null(pc.utf8_length(items.field("str")), 0))
        page = np.repeat(np.arange(len(told)), np.asarray(pc.fill_null(pc.list_value_length(told), 0)))
        x, y, width, height, top = (np.asarray(pc.fill_null(items.field(c), np.nan)) for c in ITEM[1:])
        order = np.lexsort((x, -y, page))
        order = order[sizes[order] > 0]
        # Where the height changes, an item may begin a line: it does if it is too far from the line's first.
        p, level = page[order], y[order]
        begins = np.r_[True, (p[1:] != p[:-1]) | (level[1:] != level[:-1])][: len(order)]
        own, first = -1, 0.0
        for k in np.flatnonzero(begins):
            if p[k] == own and abs(first - level[k]) <= tolerance:
                begins[k] = False
            else:
                own, first = p[k], level[k]
        line = np.cumsum(begins)
        order = order[np.lexsort((x[order], line))]
        x, y, width, height, top, n = x[order], y[order], width[order], height[order], top[order], sizes[order]
        with np.errstate(all="ignore"):
            gaps = np.trunc((x - np.r_[0.0, (x + width)[:-1]][: len(x)]) / (width / n) + 0.5)
        gaps = np.where(begins | ~(width > 0), 0, np.clip(np.nan_to_num(gaps), 0, widest_gap)).astype(np.int64)
        ends = np.r_[begins[1:], True][: len(order)]
        taken = np.cumsum(gaps + n + ends)
        edges = np.searchsorted(p, np.arange(len(told) + 1))
        start = taken - ends - n - np.repeat(np.r_[0, taken][edges[:-1]], np.diff(edges))
        height = np.where(height == 0, 10.0, np.abs(height))
        spans = pa.StructArray.from_arrays([pa.array(c) for c in (start.astype(np.int32), (start + n).astype(np.int32), x, top - y - height, width, height)], fields=list(span))
        words = pc.binary_join_element_wise(padding.take(pa.array(gaps)), items.field("str").take(pa.array(order)), pa.array(["", "\n"]).take(pa.array(ends.astype(np.int64))), "")
        edges = pa.array(edges.astype(np.int32))
        columns = [batch.column("document_id"), batch.column("page"), pc.binary_join(pa.ListArray.from_arrays(edges, words), ""), pa.ListArray.from_arrays(edges, spans)]
        return pa.RecordBatch.from_arrays(columns, names=["document_id", "page_number", "text", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                yield laid(batch.slice(at, PAGES))

    return pages.select("document_id", "page", "items").mapInArrow(run, f"document_id {kinds['document_id']}, page_number {kinds['page']}, text string, spans array<struct<s:int,e:int,x:double,y:double,w:double,h:double>>")
