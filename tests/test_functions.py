"""Golden values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from claimweave.functions import numbers as N
from claimweave.functions import periods as P
from claimweave.functions import text as T
from claimweave.functions import vectors as V


def each(spark, rows, schema, *columns):
    """Rows of columns evaluated over rows, in order."""
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + schema)
    return [tuple(r)[1:] for r in df.select("k", *columns).orderBy("k").collect()]


LITERALS = [("1,23,456.78", 123456.78), ("8,141.7", 8141.7), ("(1,234)", -1234.0), ("(249.20)", -249.2), ("₹ 8,141.7", 8141.7), ("Rs. 2,194", 2194.0), ("not applicable", None), ("reach (1) 18,793", -1.0), ("−5", 5.0), ("- 5", -5.0), (".5", 0.5), ("Rs. (452 Cr)", -452.0), ("", None), (None, None)]


def test_numeric_literals(spark):
    got = each(spark, [(r,) for r, _ in LITERALS], "raw string", N.parse_numeric_literal("raw"))
    assert [g[0] for g in got] == [e for _, e in LITERALS]


NUMBERS = [
    ((1.0, "1", None, "crore", "INR"), (1e7, "INR")),
    ((1.0, "1", None, "lakh", "INR"), (1e5, "INR")),
    ((1.0, "1", None, "Lakh  Crore", "INR"), (1e12, "INR")),
    ((25.0, "25", "bps", None, None), (0.25, "%")),
    ((42.0, "42", "parsecs", None, None), (42.0, "parsecs")),
    ((float("nan"), "n/a", None, None, None), None),
    ((5.0, "5", "Cr", None, None), (5.0, "cr")),
    ((5.0, "5", "Cr", None, "INR"), (5.0, "INR")),
    ((None, "(7)", "", "", "₹"), (-7.0, "INR")),
    ((3.0, "3", None, None, None), (3.0, "count")),
    ((2.0, "2", "km", "gross", None), (2000.0, "m")),
]


def test_normalize_number(spark):
    got = each(spark, [a for a, _ in NUMBERS], "number double, raw string, unit string, scale string, currency string", N.normalize_number("number", "raw", "unit", "scale", "currency"))
    for (g,), (_, e) in zip(got, NUMBERS):
        assert (g is None and e is None) or (g.unit == e[1] and g.value == pytest.approx(e[0]))


def test_formats(spark):
    rows = [(8.1417e10, "INR", "₹8,141.7 crore"), (-4516080000.0, "INR", "₹-451.61 crore"), (1.5e5, "INR", "₹1.5 lakh"), (1.2345678e12, "INR", "₹1,23,456.78 crore"), (0.25, "%", "0.25%"), (1234567.8915, "kg", "1,234,567.892 kg"), (0.125, "%", "0.125%")]
    got = each(spark, [r[:2] for r in rows], "v double, u string", N.format_normalized("v", "u"))
    assert [g[0] for g in got] == [r[2] for r in rows]


def test_value_text(spark):
    rows = [("number", "Rs. 127 Cr", "crore", None, "INR", "Rs. 127 Cr"), ("number", "8,141.7", "crore", None, "INR", "8,141.7 crore INR"), ("number", "34.1%", None, "%", None, "34.1%"), ("categorical", "resigned", None, None, None, "resigned")]
    got = each(spark, [r[:5] for r in rows], "kind string, raw string, scale string, unit string, currency string", N.value_text("kind", "raw", "scale", "unit", "currency"))
    assert [g[0] for g in got] == [r[5] for r in rows]


FY24 = ("2023-04-01", "2024-03-31")
PERIODS = [
    *[(x, 4, "fiscal_year", *FY24) for x in ("FY24", "FY2024", "FY 2024", "F.Y. 2024", "2023-24", "FY2023-24", "for the year ended March 31, 2024", "fourth quarter of FY24", "year ended December 31, 2023")],
    *[(x, 4, "fiscal_year", "2024-04-01", "2025-03-31") for x in ("2024-25", "FY2024/25", "2024-03")],
    ("Q1 FY24", 4, "quarter", "2023-04-01", "2023-06-30"),
    ("Q3FY24", 4, "quarter", "2023-10-01", "2023-12-31"),
    ("Q4 FY24", 4, "quarter", "2024-01-01", "2024-03-31"),
    ("Q4 FY2023-24", 4, "quarter", "2024-01-01", "2024-03-31"),
    ("H1FY25", 4, "half_year", "2024-04-01", "2024-09-30"),
    ("H2 FY25", 4, "half_year", "2024-10-01", "2025-03-31"),
    ("9M FY24", 4, "range", "2023-04-01", "2023-12-31"),
    *[(x, 4, "instant", "2024-03-31", "2024-03-31") for x in ("as at March 31, 2024", "as on 31 March 2024", "31st March, 2024", "2024-03-31", "31/03/2024")],
    *[(x, 4, "calendar_year", "2024-01-01", "2024-12-31") for x in ("CY2024", "calendar year 2024", "Q4 CY24")],
    *[(x, 4, None, None, None) for x in ("consolidated", "", None, "Mar '24", "13/45/2024")],
    ("FY2024", 10, "fiscal_year", "2023-10-01", "2024-09-30"),
    ("FY2024", 1, "fiscal_year", "2024-01-01", "2024-12-31"),
    ("FY 23-24", 4, "fiscal_year", "2022-04-01", "2023-03-31"),
    ("half year ended September 30, 2023", 4, "instant", "2023-09-30", "2023-09-30"),
    ("31 February 2024", 4, "instant", "2024-02-31", "2024-02-31"),
    ("2024-13-45", 4, "instant", "2024-13-45", "2024-13-45"),
    ("for 1999", 4, "calendar_year", "1999-01-01", "1999-12-31"),
    ("FY 2023–24", 4, "fiscal_year", *FY24),
    ("Q2 FY71", 4, "quarter", "1970-07-01", "1970-09-30"),
]


def test_periods(spark):
    p = P.parse_period("raw", F.col("fy"))
    got = each(spark, [r[:2] for r in PERIODS], "raw string, fy int", p["kind"], p["start"], p["end"])
    assert [(r[0], *g) for g, r in zip(got, PERIODS)] == [(r[0], *r[2:]) for r in PERIODS]


RELATIONS = [("FY24", "Q4 FY24", "A_CONTAINS_B"), ("Q4 FY24", "FY24", "B_CONTAINS_A"), ("FY24", "2023-24", "EQUAL"), ("FY24", "FY25", "DISJOINT"), ("FY24", None, "MISSING"), ("FY23", "March 31, 2023", "BOUNDARY"), ("FY24", "31 March 2023", "DISJOINT"), ("H1FY25", "9M FY25", "B_CONTAINS_A"), ("CY2023", "FY24", "OVERLAP"), (None, None, "MISSING")]


def test_period_relations(spark):
    got = each(spark, [r[:2] for r in RELATIONS], "a string, b string", P.compare_periods(P.parse_period("a"), P.parse_period("b")))
    assert [g[0] for g in got] == [r[2] for r in RELATIONS]


def test_period_months_and_labels(spark):
    got = each(spark, [("FY24",), ("Q4 FY24",), ("H1FY25",), (None,)], "a string", P.period_months(P.parse_period("a")), P.period_label(P.parse_period("a")))
    assert [g[0] for g in got] == [12, 3, 6, None]
    assert got[0][1] == "FY24 [2023-04-01 → 2024-03-31]" and got[3][1] == "unscoped"


TEXTS = [
    (T.normalize_person_name, "Mr. Sahil Barua", "barua sahil"),
    (T.normalize_person_name, "Barua, Sahil", "barua sahil"),
    (T.normalize_org_name, "Delhivery Limited", "delhivery"),
    (T.normalize_org_name, "Delhivery Pvt. Ltd.", "delhivery"),
    (T.normalize_org_name, "The Company", "the company"),
    (T.normalize_address, "12 MG Rd., Bangalore", "12 mahatma gandhi road bengaluru"),
    (T.normalize_address, "Plot No. 5, Sector-44, Gurgaon", "plot 5 sector 44 gurugram"),
    (T.normalize_categorical, "Resigned w.e.f. 31.01.2024", "resigned"),
    (T.normalize_categorical, "Resigned with effect from 31 January 2024", "resigned"),
    (T.normalize_subject, "Bank of India", "bank of india"),
    (T.normalize_subject, "The Company", "the company"),
    (T.normalize_subject, "Nation_3 Limited", "nation 3"),
    (T.normalize_subject, "The NATION_3 Ltd.", "the nation 3"),
    (T.normalize_subject, "Dr.", "dr"),
    (T.normalize_text, "Crédit  Agricole’s ﬁrst ½", "credit agricole s first 1 2"),
    (T.normalize_text, None, ""),
    (T.title_from_filename, "up_mttm32ve980roy_note.pdf", "Note"),
    (T.title_from_filename, "a/02-delhivery-annual-report-fy24-excerpt.pdf", "Delhivery Annual Report Fy24 Excerpt"),
]


@pytest.mark.parametrize("fn,raw,want", TEXTS)
def test_texts(spark, fn, raw, want):
    assert each(spark, [(raw,)], "raw string", fn("raw")) == [(want,)]


def test_hints_and_similarity(spark):
    rows = [("12 MG Rd.", "registered office address", "12 mahatma gandhi road"), ("Mr. B A", "name of director", "a b"), ("X Ltd", "bank", "x"), ("Resigned!", "officer status", "resigned"), ("A & B", "revenue", "a b")]
    got = each(spark, [r[:2] for r in rows], "v string, h string", T.normalize_by_hint("v", "h"))
    assert [g[0] for g in got] == [r[2] for r in rows]
    rows = [("revenue from operations", "revenue from operations", 1.0), ("revenue from operations", "total income", 0.0), ("revenue from operations", "revenue operations", 0.8), ("india bank", "bank india", 1.0), ("", "x", 0.0)]
    got = each(spark, [r[:2] for r in rows], "a string, b string", T.text_similarity("a", "b"))
    assert [g[0] for g in got] == [r[2] for r in rows]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 2.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0, 1.0, 5.0], [1.0, 1.0], 1.0)]
    got = each(spark, [r[:2] for r in rows], "a array<float>, b array<float>", V.cosine("a", "b"))
    assert [g[0] for g in got] == pytest.approx([r[2] for r in rows])
