"""Grounding through indexes of pages against the tiers as expressions."""

import random

from pyspark.sql import functions as F

from claimweave.functions.columns import SPACE
from claimweave.operators.grounding import ground_claims, locate
from claimweave.operators.locating import _WHITE, TOGETHER, ground_by_index, hits

CLAIM = "document_id string, page_number int, quote string, value_kind string, value_raw string, note string"
PAGES = "document_id string, page_number int, text string"


def both(spark, claims, pages):
    claims, pages = spark.createDataFrame(claims, CLAIM), spark.createDataFrame(pages, PAGES)
    shown = lambda df: sorted(map(str, df.select(*claims.columns, "grounding").collect()))
    got = ground_by_index(claims, pages)
    assert shown(got) == shown(ground_claims(claims, pages))
    return [r.grounding for r in got.collect()]


def test_every_tier_of_many_claims_a_page(spark):
    draw = random.Random(3)
    words = "alpha Beta gamma(1) de-lta 12.5 1,204 the net İx Kelvin straße 東京 ok".split()
    pages, claims = [], []
    for n in range(12):
        lines = [" ".join(draw.choices(words, k=draw.randint(0, 9))) for _ in range(draw.randint(1, 7))]
        pages.append((f"d{n % 3}", n, draw.choice(["\n", "\n\n"]).join(lines)))
        for line in lines:
            own = line.split()
            quotes = [line, line.replace(" ", "   "), line.upper(), line.replace(" ", " - "), " ".join(own[::-1]), " ".join([*own[:3], "zzqx", *own[-3:]]), "  ", line[2:9], " ".join(own[:2] * 2)]
            claims += [(f"d{n % 3}", n, q, draw.choice(["number", "text"]), draw.choice(["12.5", "alpha", q]), "x") for q in quotes]
    found = both(spark, claims, pages)
    assert {g.method for g in found} == {"exact", "whitespace", "caseless", "folded", "scattered", "anchored", "none"}
    assert {g.status for g in found} == {"grounded", "quote_not_found", "quote_lacks_context", "value_not_in_quote"}


def test_nulls_missing_pages_and_repeats(spark):
    pages = [("a", 1, "one two three\nfour"), ("a", 2, None), ("a", 3, ""), (None, 1, "one two three")]
    claims = [("a", 1, "four", "text", "four", None), ("a", 1, "four", "text", "four", None), ("a", 1, None, "text", None, None), ("a", 1, "fo", "text", "fo", None)]
    claims += [("a", 1, "three one", None, "three one", None), ("a", 2, "one two", "text", "one", None), ("a", 3, "one two", "text", "one", None), ("b", 1, "one two", "text", "one", None), (None, 1, "one two", "text", "one", None), ("a", None, "one two", "text", "one", None)]
    statuses = sorted(g.status for g in both(spark, claims, pages))
    assert statuses == ["grounded"] * 3 + ["page_not_found"] * 5 + ["quote_not_found"] * 2
    assert both(spark, [], pages) == [] and {g.status for g in both(spark, claims, [])} == {"page_not_found"}


def test_a_long_page_and_a_window_of_three_lines(spark):
    page = "\n".join(f"row {k} of the table holds value{k}" for k in range(3_000))
    claims = [("a", 1, "value2000 value2002 table", "text", "value2000", None), ("a", 1, "value10 value13", "text", "value10", None), ("a", 1, "TABLE-HOLDS-VALUE2999", "text", "table", None)]
    found = {g.method: g for g in both(spark, claims, [("a", 1, page)])}
    assert page[found["scattered"].start : found["scattered"].end].count("\n") == 2 and page[found["folded"].start :].endswith("value2999")
    assert found["none"].status == "quote_not_found"


def test_a_very_long_quote(spark):
    """Longer than what the stack of a pattern matcher bears."""
    words = [f"word{k} of" for k in range(6_000)]
    page = "start\n" + "  \t".join(words) + " the end"
    claims = [("a", 1, q, "text", "word3", None) for q in (" ".join(words), " ".join(words).upper(), " - ".join(words), " ".join(words) + " zzqx")]
    found = [r.grounding for r in ground_by_index(spark.createDataFrame(claims, CLAIM), spark.createDataFrame([("a", 1, page)], PAGES)).collect()]
    assert sorted(g.method for g in found) == ["caseless", "folded", "none", "whitespace"]
    assert {page[g.start : g.end] for g in found if g.method != "none"} == {page[6:]}


def test_letters_of_other_cases(spark):
    pages = [("a", 1, "alpha İx ΟΔΟΣ  x Straße ſome\nbeta"), ("a", 2, "\n one ΟΔΟΣ  two")]
    claims = [("a", 1, "ALPHA ix οδος X STRAßE some", "text", "alpha", "x"), ("a", 2, "one οδος two", "text", "one", "x")]
    rows = spark.createDataFrame(claims, CLAIM).join(spark.createDataFrame(pages, PAGES), ["document_id", "page_number"])
    found = {r.page_number: (r.l.method, r.text[r.l.start : r.l.end]) for r in rows.select("page_number", "text", locate("text", "quote").alias("l")).collect()}
    assert found == {1: ("caseless", "alpha İx ΟΔΟΣ  x Straße ſome"), 2: ("caseless", "one ΟΔΟΣ  two")}


def test_a_page_is_taken_to_its_claims_once(spark):
    """Not once for each claim; claims beyond TOGETHER share it with so many others each."""
    pages = [("a", 1, "one two three\nfour five"), ("b", 1, "six  seven eight\n\nnine")]
    claims = [("a", 1, f"four five {k % 3}" if k % 2 else "two  THREE", "text", "four", str(k)) for k in range(2 * TOGETHER)] + [("b", 1, "SEVEN eight nine", "text", "eight", "x")]
    found = both(spark, claims, pages)
    assert sum(g.method == "caseless" for g in found) == TOGETHER + 1
    read = spark.sparkContext.accumulator(0)

    def counted(text):
        read.add(1)
        return text

    texts = spark.createDataFrame(pages, PAGES).withColumn("text", F.udf(counted, "string")("text"))
    joined = spark.createDataFrame(claims, CLAIM).coalesce(1).groupBy("document_id").agg(F.collect_list(F.struct("quote")).alias("claims")).join(texts, "document_id")
    rows = hits(joined, "text", "claims").collect()
    assert read.value == 2 and sorted(len(r.hits) for r in rows) == [1, 2 * TOGETHER]


def test_hits_of_nulls_and_lines_around_them(spark):
    rows = spark.createDataFrame([(1, "\nalpha\n beta\n", ["alpha", None, "  be ", "ALPHA  BETA", "x"]), (2, None, ["alpha"]), (3, "alpha", None)], "id int, text string, quotes array<string>").select("id", "text", F.transform("quotes", lambda q: F.struct(q.alias("quote"))).alias("claims"))
    got = {r.id: [h and (h.method, h.start, h.end, h.first, h.last, h.lines) for h in r.hits] for r in hits(rows, "text", "claims").collect()}
    assert got == {1: [("exact", 1, 6, 1, 6, "alpha"), None, None, ("caseless", 1, 12, 1, 12, "alpha\n beta"), None], 2: [None], 3: []}


def test_white_space_and_letters_are_those_of_the_expressions(spark):
    white = spark.range(1).select(F.regexp_replace(F.lit("".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x10000)]))), SPACE, "").alias("c")).first().c
    assert set(_WHITE) == {chr(k) for k in [*range(1, 0xD800), *range(0xE000, 0x10000)]} - set(white)
