"""The shortlist by matrices of batches against scores of all pairs."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimweave.functions.vectors import cosine
from claimweave.operators import nearest, registry
from claimweave.plans import cases, reads  # noqa: F401 - register their queries
from claimweave.plans import queries as core

SCHEMA = "namespace string, normal long, embedding array<float>"


def all_pairs(labels, entries, least, top=3):
    other = entries.select("namespace", F.col("normal").alias("entry"), F.col("embedding").alias("__other"))
    scored = labels.join(other, "namespace").filter("normal <> entry").withColumn("score", cosine("embedding", "__other"))
    scored = scored if least is None else scored.filter(F.col("score") >= least)
    best = Window.partitionBy("namespace", "normal").orderBy(F.desc("score"), "entry")
    return scored.select("namespace", "normal", "entry", "score").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def rows():
    """Copies in groups, near copies, lengths that differ, zeros, nulls, NaN and infinity."""
    draw = random.Random(5)
    own = [[draw.gauss(0, 1) for _ in range(12)] for _ in range(40)]
    odd = [None, [], [0.0] * 12, [1.0, None, *[0.5] * 10], [float("nan"), *[1.0] * 11], [float("inf"), *[1.0] * 11], own[0][:5], own[1] + [3.0]]
    out = []
    for k in range(900):
        v = draw.choice(odd) if draw.random() < 0.1 else list(draw.choice(own))
        if v and None not in v and draw.random() < 0.3:
            v[draw.randrange(len(v))] += 1e-6
        out.append((draw.choice("xxxy"), k, v))
    return [*out, ("z", 5_000, own[0]), (None, 5_001, own[0]), ("x", None, own[0]), ("x", 7, own[0]), ("x", 7, own[0]), ("x", 8, own[1])]


@pytest.mark.parametrize("least", [None, 0.72])
def test_as_scores_of_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(nearest, "LABELS", 16)
    e = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    q = e.filter("normal % 10 < 2")
    got, want = registry.shortlist(q, e, least=least, block=70), all_pairs(q, e, least)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_names_without_labels_and_without_entries(spark):
    e = spark.createDataFrame([("p", f"e{k}", [1.0, k / 10]) for k in range(30)], "namespace string, normal string, embedding array<double>")
    assert sorted(map(str, registry.shortlist(e, e, least=0.99).collect())) == sorted(map(str, all_pairs(e, e, 0.99).collect()))
    assert registry.shortlist(e.limit(0), e).count() == registry.shortlist(e, e.limit(0)).count() == 0


def test_a_task_returns_its_best_alone(spark):
    """Not a row for each pair of a label and an entry."""
    e = spark.createDataFrame([("x", k, [1.0, k / 100]) for k in range(600)], SCHEMA).repartition(2)
    found = nearest.nearest(nearest.Vectors(*e.filter("normal < 10").toArrow().combine_chunks().to_batches()[0].columns), e.toArrow().to_batches(), None, 3)
    assert len(found[0]) == 30


@pytest.mark.parametrize("name", ["adjudicated_labels", "shortlist_cut"])
def test_queries_score_no_pairs_by_expressions(spark, name):
    """Tasks find their best by matrices; no row is made for each pair of a label and an entry."""
    plan = core.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "__other" not in plan
