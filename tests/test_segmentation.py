"""Headings, captions, salience, running headers, units and layout."""

from pyspark.sql import functions as F

from claimweave.operators import segmentation as S


def flags(spark, fn, lines):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string")
    return [r.v for r in df.select("k", fn("line").alias("v")).orderBy("k").collect()]


def test_lines(spark):
    lines = ["CONSOLIDATED STATEMENT", "2.1 Overview of", "Revenue From Operations", "We grew in the quarter.", "a b c d e f g h i j k l m", "12", "", "lower case words here"]
    want = [True, True, True, False, False, False, False, False]
    assert flags(spark, S.is_heading, lines) == want
    assert [bool(x) and S._heading(x) for x in lines] == want
    assert flags(spark, S.scale_caption, ["(Rs. in crore)", "orders in lakhs", "amounts are in INR millions", "nothing"]) == ["Rs. in crore", "rs in lakhs", "amounts are in INR millions", None]
    assert flags(spark, S.basis_caption, ["Consolidated results", "x" * 90 + " consolidated", "PRO FORMA"]) == ["consolidated", None, "pro forma"]
    assert flags(spark, S.is_salient, ["He was appointed.", "The director left.", "x 1", "in Mar", "quiet words"]) == [False, True, True, True, False]


def test_first_unique(spark):
    df = spark.createDataFrame([(["A", "a", "B", "C"],)], "v array<string>")
    assert df.select(S.first_unique("v", 2)).first()[0] == ["A", "B"]
    assert S._first(["A", "a", "B", "C"], 2) == ["A", "B"]


def test_running_headers(spark):
    head = "Annual Report 2023-24"
    six = [("d", k, (head if k < 3 else f"page {k} title") + f"\nbody {k} one\nbody {k} two\nbody {k} three\nlast {k}\n") for k in range(6)]
    few = [("e", k, head + "\nbody\n") for k in range(4)]
    pages = spark.createDataFrame(six + few, "document_id string, page_number int, text string")
    assert [(r.document_id, r.line, r.pages) for r in S.running_headers(pages).collect()] == [("d", head, 3)]
    units = S.segment(pages).filter("document_id = 'd'").orderBy("page_number").collect()
    assert all(head not in u.text for u in units)


def test_units(spark):
    page = "INTRODUCTION HERE\n(Rs. in crore)\nRevenue was 10 in the year, up from 9.\n\n" + "tail"
    big = "FIRST PART\n" + "\n".join(f"line number {k} of the first part" for k in range(300)) + "\nSECOND PART\n" + "\n".join(f"line number {k} of the second part" for k in range(300))
    pages = spark.createDataFrame([("d", 1, page), ("d", 2, big), ("d", 3, "short"), ("d", 4, None)], "document_id string, page_number int, text string")
    rows = S.segment(pages).orderBy("page_number", "unit").collect()
    one = [r for r in rows if r.page_number == 1]
    assert len(one) == 1 and one[0].captions == ["Rs. in crore"] and one[0].headings == ["INTRODUCTION HERE"] and one[0].salient
    assert one[0].char_start == 0 and "INTRODUCTION HERE" in one[0].text
    two = [r for r in rows if r.page_number == 2]
    assert len(two) > 4 and all("PART" not in r.text for r in two)
    assert two[0].headings == ["FIRST PART"] and two[-1].headings == ["FIRST PART", "SECOND PART"]
    assert not [r for r in rows if r.page_number > 2]
    text = spark.createDataFrame(one).select(S.render_prompt(F.lit("T"), "page_number", "headings", "captions", "text").alias("p")).first().p
    assert text.startswith("DOCUMENT: T\nPAGE: 1\nSECTION CONTEXT: INTRODUCTION HERE\nSCOPE CAPTIONS ON THIS PAGE: Rs. in crore\n\nPAGE EXCERPT:\n")


def test_layout(spark):
    items = [("d", 1, "Revenue", 10.0, 700.0, 35.0, 10.0, 800.0), ("d", 1, "8,141", 95.0, 701.0, 25.0, 10.0, 800.0), ("d", 1, "Next", 10.0, 650.0, 20.0, 10.0, 800.0), ("d", 1, "", 1.0, 1.0, 1.0, 1.0, 800.0)]
    df = spark.createDataFrame(items, "document_id string, page int, str string, x double, y double, width double, height double, page_height double")
    row = S.layout_pages(df).first()
    assert row.text == "Revenue" + " " * 10 + "8,141\nNext\n"
    assert [(s.s, s.e, s.y) for s in row.spans] == [(0, 7, 90.0), (17, 22, 89.0), (23, 27, 140.0)]
