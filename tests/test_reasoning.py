"""Comparisons and verdicts of hand-made pairs."""

import pytest
from pyspark.sql import functions as F

from claimweave.functions.periods import parse_period
from claimweave.operators import blocking
from claimweave.operators.reasoning import FACT
from claimweave.plans.reconcile import judged_pairs, relations, updated_relations

BASE = dict(document_id="d1", page_number=1, subject="Acme Ltd", predicate="revenue", value_kind="number", value_raw="8,141.7", value_iso=None, value_id=None, period="FY24", asserted_as_of="2024-08-08", basis=["consolidated"], normalized_number=8.1417e10, normalized_unit="INR", confidence=0.9)
STATE = dict(value_kind="categorical", value_raw="active", value_id="v1", normalized_number=None, normalized_unit=None, basis=[], predicate="status", period="FY22", asserted_as_of="2022-05-10")


def facts(spark, rows):
    fields = [f.split(" ")[0] for f in FACT.replace(":string,", ":string;").split(", ")]
    out = []
    for k, r in enumerate(rows):
        r = BASE | dict(fact_seq=k, id=f"f{k}", fact_type="quantity", canonical_subject_id="s", canonical_predicate_id="p") | r
        out.append(tuple(r[f] for f in fields))
    schema = FACT.replace("struct<raw:string,kind:string,start:string,end:string>", "string")
    return spark.createDataFrame(out, schema).withColumn("period", parse_period("period"))


def other(**kw):
    return dict(document_id="d2", normalized_number=9e10) | kw


PAIRS = [
    ({}, dict(document_id="d2"), None, "CORROBORATES", "R1", None, 0.91),
    ({}, other(period="Q4 FY24"), None, "RECONCILED", "R4-period", "period", 0.82),
    ({}, other(basis=["standalone"]), None, "RECONCILED", "R4-entityScope", "entityScope", 0.82),
    ({}, other(normalized_unit="USD", period="Q4 FY24"), None, "RECONCILED", "R0-units", "unit", 0.58),
    ({}, other(basis=["consolidated", "restated"]), None, "RECONCILED", "R4-basis", "basis", 0.82),
    (dict(basis=[]), other(basis=["projection"]), None, "RECONCILED", "R4-basis", "basis", 0.82),
    (STATE, STATE | dict(document_id="d2", value_raw="resigned", value_id="v2", asserted_as_of="2024-08-08"), "exclusive", "SUPERSEDED", "R6-state-changed", "vintage", 0.82),
    (STATE, STATE | dict(document_id="d2", value_raw="resigned", value_id="v2"), "exclusive", "CONTRADICTS", "R8", None, 0.86),
    ({}, other(), None, "CONTRADICTS", "R8", None, 0.86),
    ({}, other(asserted_as_of="2022-05-10"), None, "CONTRADICTS", "R8", None, 0.67),
    ({}, dict(document_id="d2", period="FY23"), None, "UNRELATED", "R2", "period", 0.29),
    (dict(normalized_unit="%", normalized_number=34.1), dict(normalized_unit="%", normalized_number=18.8), None, "UNRELATED", "R7b-same-page-breakdown", "predicate", 0.24),
    (dict(period="Q1 FY23"), other(period="Q2 FY23"), None, "UNRELATED", "R4-different-times", "period", 0.19),
    ({}, other(period=None), None, "UNRELATED", "R4-unscoped", "period", 0.19),
    ({}, dict(document_id="d2", period="March 31, 2024"), None, "CORROBORATES", "R1b-boundary-period", "period", 0.72),
    (dict(period=None), dict(document_id="d2", period=None), None, "UNRELATED", "R2", "period", 0.29),
    (dict(basis=["member:a"]), other(basis=["member:b"]), None, "UNRELATED", "R-different-entities", "entityScope", 0.19),
    (STATE | dict(period=None), STATE | dict(document_id="d2", value_raw="chair", value_id="v3", period=None, basis=["consolidated"]), "compatible", "CORROBORATES", "R3", None, 0.67),
    (dict(basis=["segment:acme ltd"]), dict(document_id="d2", basis=[]), None, "CORROBORATES", "R1", None, 0.91),
    (dict(basis=["segment:express"]), other(basis=[]), None, "RECONCILED", "R4-entityScope", "entityScope", 0.82),
    ({}, dict(document_id="d2", value_kind="categorical"), None, "UNRELATED", "R0", None, 0.19),
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [dict(canonical_subject_id=f"s{k}") | side for k, (a, b, *_) in enumerate(PAIRS) for side in (a, b)]
    edges = spark.createDataFrame([("v1", "v2", "exclusive"), ("v3", "v1", "compatible")], "a string, b string, kind string")
    return {int(r.canonical_subject_id[1:]): r.j for r in judged_pairs(facts(spark, rows), edges).collect()}


@pytest.mark.parametrize("k", range(len(PAIRS)))
def test_verdicts(judged, k):
    d = judged[k].decision
    assert (d.verdict, d.rule_id, d.axis, d.confidence) == PAIRS[k][3:]
    assert sorted(x.dimension for x in judged[k].deltas) == ["basis", "entityScope", "period", "predicate", "unit", "vintage"]
    assert all(len(x.note) > 10 for x in judged[k].deltas) and d.explanation


def test_documented_rules(spark):
    rows = [{}, other(basis=["consolidated", "restated"])]
    f = facts(spark, rows)
    assert [r.j.decision.rule_id for r in judged_pairs(f, rules="documented").collect()] == ["R5-restated"]


NUMBERS = [(11.50, 11.55, "%", "SAME"), (11.5, 11.6, "%", "DIFFERENT"), (1000.0, 1004.0, "INR", "SAME"), (1000.0, 1010.0, "INR", "DIFFERENT"), (0.0, 0.0, "INR", "SAME"), (0.0, 5.0, "INR", "DIFFERENT"), (100.0, 1000.0, "INR", "DIFFERENT"), (None, 1.0, "INR", "UNKNOWN")]


def test_numbers(spark):
    rows = [dict(canonical_subject_id=f"s{k}", normalized_number=x, normalized_unit=u, document_id=d) for k, (a, b, u, _) in enumerate(NUMBERS) for x, d in ((a, "d1"), (b, "d2"))]
    got = {int(r.canonical_subject_id[1:]): r.j.value for r in judged_pairs(facts(spark, rows)).collect()}
    assert [got[k].relation for k in range(len(NUMBERS))] == [n[3] for n in NUMBERS]
    assert got[4].ratio == 1 and got[5].ratio == float("inf") and "10x" in got[6].detail


def test_pairs_and_caps(spark):
    """The cap's early choice of facts gives the pairs of a plain nested loop."""
    rows = [dict(fact_seq=k, document_id=f"d{k % 3}", canonical_subject_id="big" if k < 60 else None if k < 64 else "one") for k in range(65)]
    f = facts(spark, rows)
    got = {(r.a_seq, r.b_seq) for r in blocking.block_pairs(f, cap=500).collect()}
    want = [(i, j) for i in range(60) for j in range(i + 1, 60) if i % 3 != j % 3][:500] + [(i, j) for i in range(60, 64) for j in range(i + 1, 64)]
    assert got == set(want)
    assert blocking.block_pairs(f, cap=None).count() == 60 * 59 // 2 - 3 * 190 + 6
    assert sorted((r.members for r in blocking.blocks(f).collect())) == [4, 60]


def test_batches_give_the_same_relations(spark):
    rows = [dict(fact_seq=k, document_id=f"d{k}", canonical_subject_id=f"s{k % 2}", normalized_number=1e6 + (k // 4) * 1e5) for k in range(12)]
    f = facts(spark, rows)
    whole = {tuple(r) for r in relations(f).select("id", "verdict").collect()}
    first, second = f.filter("fact_seq < 5"), f.filter("fact_seq >= 5")
    split = updated_relations(relations(first), f, second)
    assert {tuple(r) for r in split.select("id", "verdict").collect()} == whole and whole
