"""Grounding statuses, methods, offsets and boxes."""

import pytest
from pyspark.sql import functions as F

from claimweave.operators import grounding as G

PAGE = """Consolidated Statement of Profit and Loss
                               FY24        FY23
Revenue from operations      8,141.7     7,225.3
Other income                   249.20      304.9
Pin-code reach (1)     18,793
Total equity            9,177         9,145
Loss narrowed to Rs. (452 Cr) in the year."""

CASES = [
    (PAGE, "Revenue from operations      8,141.7     7,225.3", "number", "8,141.7", "grounded", "exact"),
    (PAGE, "Revenue from operations 8,141.7", "number", "8,141.7", "grounded", "whitespace"),
    (PAGE, "revenue FROM operations 8,141.7", "number", "8,141.7", "grounded", "caseless"),
    (PAGE, "Other income 249.20", "number", "249.2", "grounded", "whitespace"),
    (PAGE, "Total equity            9,177         9,145", "number", "9,145", "grounded", "exact"),
    (PAGE, "Loss narrowed to Rs. (452 Cr)", "number", "Rs. (452 Cr)", "grounded", "exact"),
    (PAGE, "Pin-code reach(1) 18,793", "number", "18,793", "grounded", "folded"),
    (PAGE, "Revenue from operations 9,999.9", "number", "9,999.9", "quote_not_found", "none"),
    (PAGE, "Other income                   249.20", "number", "9,999.9", "value_not_in_quote", "exact"),
    (PAGE, "8", "number", "8", "quote_not_found", "none"),
    ("Costs as % of revenue\n34.1%\n18.8%", "34.1%", "number", "34.1%", "quote_lacks_context", "exact"),
    ("Gateways 111\nHubs 2", "Gateways 111", "number", "111", "grounded", "exact"),
    ("Revenue\nRs. 8,142 Cr\nGrowth", "Rs. 8,142 Cr", "number", "8,142", "quote_lacks_context", "exact"),
    ("Alpha beta  10  20  30", "Alpha beta 30", "number", "30", "grounded", "scattered"),
    ("The office is at 12 Long Road, in the city of Pune today", "office is at 12 Long–Road in city of Pune", "text", "Pune", "grounded", "scattered"),
    ("", "anything", "number", "1", "page_not_found", "none"),
    (None, "anything", "number", "1", "page_not_found", "none"),
    ("Mr. A resigned as director", "Mr. A resigned", "categorical", "Resigned!", "grounded", "exact"),
]


def test_statuses(spark):
    df = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(CASES)], "k int, page string, quote string, kind string, raw string")
    got = df.select("k", "page", "quote", G.ground("page", "quote", "kind", "raw").alias("g")).orderBy("k").collect()
    assert [(r.g.status, r.g.method) for r in got] == [c[4:] for c in CASES]
    for r in got:
        if r.g.status == "grounded":
            assert r.page[r.g.start : r.g.end].count("\n") <= 2 and "\n" not in (r.page[r.g.start - 1 : r.g.start].replace("\n", ""))


def test_offsets(spark):
    df = spark.createDataFrame([(PAGE, "Other income 249.20"), (PAGE, "Pin-code reach(1) 18,793"), ("one two THREE  four five\nsix", "one two xx four five"), ("aa bb cc q x dd ee ff", "aa bb cc qx dd ee ff")], "page string, quote string")
    got = [(r.page[r.l.start : r.l.end], r.l.method) if r.l else None for r in df.select("page", G.locate("page", "quote").alias("l")).collect()]
    assert got[0] == ("Other income                   249.20", "whitespace")
    assert got[1] == ("Pin-code reach (1)     18,793", "folded")
    assert got[2] is None
    assert got[3] is not None


def test_anchored(spark):
    page = "the net profit of the group (after tax) rose to twelve lakh rupees only"
    quote = "the net profit of that grouping rose to twelve lakh rupees only"
    row = spark.createDataFrame([(page, quote)], "p string, q string").select(G.locate("p", "q").alias("l")).first().l
    assert row.method == "anchored" and page[row.start : row.end] == page


@pytest.mark.parametrize("start,end,boxes", [(0, 18, [(10.0, 100.0, 105.0)]), (0, 26, [(10.0, 100.0, 105.0), (10.0, 120.0, 40.0)]), (500, 600, [])])
def test_boxes(spark, start, end, boxes):
    spans = [(0, 7, 10.0, 100.0, 40.0, 10.0), (8, 18, 55.0, 100.0, 60.0, 10.0), (19, 26, 10.0, 120.0, 40.0, 10.0)]
    df = spark.createDataFrame([(spans,)], "spans array<struct<s:int,e:int,x:double,y:double,w:double,h:double>>")
    got = df.select(G.boxes_for_range("spans", F.lit(start), F.lit(end)).alias("b")).first().b
    assert [(b.x, b.y, b.w) for b in got] == boxes


def test_folding_keeps_places_behind_letters_that_grow(spark):
    page = "İİ list\nPin-code reach (1)   18,793\nend"
    df = spark.createDataFrame([(page, "Pin-code reach(1) 18,793"), ("Kelvin İx pin–code", "kelvin ix-pin code")], "page string, quote string")
    a, b = (r.l for r in df.select(G.locate("page", "quote").alias("l")).collect())
    assert page[a.start : a.end] == "Pin-code reach (1)   18,793" and a.method == "folded"
    assert (b.start, b.end) == (0, 18) and b.method == "folded"
