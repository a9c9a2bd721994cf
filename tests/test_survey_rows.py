
import pytest
from pyspark.sql import functions as F

from claimweave.functions import numbers as N
from claimweave.functions import periods as P
from claimweave.functions import text as T
from claimweave.operators import segmentation as S

FISCAL = lambda raw: P.parse_period(F.lit(raw))
ROWS = {
    "Z8 intervals are inclusive": (lambda: FISCAL("FY24")["end"], "2024-03-31"),
    "Z9 spelled quarters are whole years": (lambda: FISCAL("first half of FY25")["kind"], "fiscal_year"),
    "Z10 two-digit spans end a year early": (lambda: FISCAL("FY 23-24")["end"], "2023-03-31"),
    "Z11 year and month are a span": (lambda: FISCAL("2024-03")["end"], "2025-03-31"),
    "Z12 half year ended is an instant": (lambda: FISCAL("half year ended September 30, 2023")["kind"], "instant"),
    "Z12 quarter ended is an instant": (lambda: FISCAL("quarter ended June 30, 2023")["kind"], "instant"),
    "Z13 year ended in December": (lambda: FISCAL("year ended December 31, 2023")["end"], "2024-03-31"),
    "Z14 two-digit years of months": (lambda: FISCAL("Mar '24")["kind"], None),
    "Z15 impossible dates survive": (lambda: FISCAL("2024-13-45")["start"], "2024-13-45"),
    "Z16 the first number counts": (lambda: N.parse_numeric_literal(F.lit("reach (1) 18,793")), -1.0),
    "Z16 a typographic minus doesn't": (lambda: N.parse_numeric_literal(F.lit("−5")), 5.0),
    "Z17 similarity is blind to order": (lambda: T.text_similarity(F.lit("India Bank"), F.lit("Bank India")), 1.0),
    "Z26 a scale as unit is a unit": (lambda: N.normalize_number(F.lit(5.0), F.lit("5"), F.lit("Cr"), F.lit(None), F.lit(None))["unit"], "cr"),
    "Z27 stems need a word of their own": (lambda: S.is_salient(F.lit("He resigned and was appointed to subsidiaries")), False),
    "Z28 no boundary before a currency": (lambda: S.scale_caption(F.lit("orders in lakhs")), "rs in lakhs"),
}


@pytest.mark.parametrize("row", ROWS)
def test_row(spark, row):
    column, want = ROWS[row]
    assert spark.range(1).select(column()).first()[0] == want


def test_z22_a_long_page_has_several_units():
    page = "\n".join(f"line {k} with some words that fill the page" for k in range(280))
    assert 9_000 < len(page) < 14_000 and len(list(S.page_units(page, set()))) == 2
