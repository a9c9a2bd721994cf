"""Measures that contain others."""

import random

from claimweave.operators.subsumption import closure, subsumed_pairs


def test_closure(spark):
    rng = random.Random(1)
    edges = {(rng.randint(0, 25), rng.randint(0, 25)) for _ in range(30)} | {(k, k + 1) for k in range(50, 90)} | {(3, 3)}
    ways = {(a, b) for a, b in edges if a != b}
    while True:
        more = ways | {(a, d) for a, b in ways for c, d in ways if b == c and a != d}
        if more == ways:
            break
        ways = more
    rows = [(str(a), str(b), "subsumes") for a, b in edges] + [("x", "y", "exclusive")]
    got = closure(spark.createDataFrame(rows, "a string, b string, kind string")).collect()
    assert len(got) == len(ways) and {(int(r.broader), int(r.narrower)) for r in got} == ways
    assert closure(spark.createDataFrame([], "a string, b string, kind string")).collect() == []


def test_pairs(spark):
    facts = [(1, "all", "s", "d"), (2, "part", "s", "d"), (3, "piece", "s", "d"), (4, "all", "t", "d"), (5, "part", "t", "e"), (6, "part", "s", "e"), (7, "other", "s", "d"), (8, "all", None, "d"), (9, "piece", None, "d")]
    table = spark.createDataFrame(facts, "fact_seq long, canonical_predicate_id string, canonical_subject_id string, document_id string")
    edges = spark.createDataFrame([("all", "part", "subsumes"), ("part", "piece", "subsumes"), ("all", "other", "exclusive")], "a string, b string, kind string")
    told = lambda **k: {(r.canonical_predicate_id, r.canonical_subject_id, r.a_seq, r.b_seq, r.broader) for r in subsumed_pairs(table, edges, **k).collect()}
    want = {("all", "s", 1, 2, "a"), ("all", "s", 1, 6, "a"), ("all", "s", 1, 3, "a"), ("part", "s", 2, 3, "a"), ("part", "s", 3, 6, "b"), ("all", "t", 4, 5, "a"), ("all", None, 8, 9, "a")}
    assert told() == want
    assert told(cap=1) == want - {("all", "s", 1, 6, "a"), ("part", "s", 3, 6, "b")}
