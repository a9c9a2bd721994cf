"""The registry against a sequential loop, its edges, responses, ingest, store and stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from claimweave.operators import ingest, registry, store
from claimweave.plans.reconcile import relations
from claimweave.sources import responses, star
from claimweave.streaming import incremental

SF = "/root/testdata/sf0.001"


def dice(a, b):
    a, b = set(a.split()), set(b.split())
    return 2 * len(a & b) / (len(a) + len(b))


def sequential(forms, least=0.92, same=()):
    """normal -> entry, one label after the other."""
    entries, out = [], {}
    for n in forms:
        near = [(-dice(n, e), k) for k, e in enumerate(entries) if dice(n, e) >= least]
        asked = [k for k, e in enumerate(entries) if (n, e) in same]
        if near:
            out[n] = entries[min(near)[1]]
        elif asked:
            out[n] = entries[asked[0]]
        else:
            entries.append(n)
            out[n] = n
    return out


def test_canonicalize(spark):
    rng = random.Random(4)
    words = ["net", "revenue", "from", "operations", "of", "all", "segments", "after", "tax", "in", "total", "group", "per", "share"]
    labels = [" ".join(rng.sample(words, rng.choice([2, 12, 13, 13, 14]))) for _ in range(120)]
    forms = list(dict.fromkeys(labels))
    same = {(forms[20], forms[3]), (forms[21], forms[20]), (forms[22], forms[23])}
    df = spark.createDataFrame([("predicate", x, "", k) for k, x in enumerate(labels)], "namespace string, label string, hint string, seq long")
    asked = spark.createDataFrame([("predicate", a, b, "same") for a, b in same] + [("predicate", forms[30], forms[2], "broader"), ("predicate", forms[31], forms[2], "exclusive")], "namespace string, normal string, candidate string, relation string")
    entries, members, edges = registry.canonicalize(df, asked)
    want = sequential(forms, same=same)
    assert {r.normal: r.entry for r in members.collect()} == want
    assert {r.normal: r.occurrences for r in entries.collect()} == {e: sum(want[x] == e for x in labels) for e in set(want.values())}
    kinds = {(r.a, r.b, r.kind) for r in edges.collect()}
    assert kinds <= {(want[forms[30]], want[forms[2]], "subsumes"), (want[forms[2]], want[forms[31]], "exclusive")} and kinds
    found = registry.find_edges(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), edges.select("a", "b", "kind")).collect()
    assert {r.direction for r in found} == {"b_to_a"}


def test_normal_forms(spark):
    rows = [("subject", "Acme Ltd.", ""), ("subject", "***", ""), ("value", "12 MG Rd.", "registered office"), ("predicate", "Net  Revenue!", "")]
    df = spark.createDataFrame(rows, "n string, l string, h string")
    assert [r[0] for r in df.select(registry.normal_form(F.col("n"), F.col("l"), F.col("h"))).collect()] == ["acme", "***", "12 mahatma gandhi road", "net revenue"]


def test_shortlist(spark):
    rows = [("p", f"e{k}", [1.0, k / 10]) for k in range(8)]
    e = spark.createDataFrame(rows, "namespace string, normal string, embedding array<float>")
    got = registry.shortlist(e.filter("normal = 'e0'"), e).orderBy("rank").collect()
    assert [r.entry for r in got] == ["e1", "e2", "e3"]


def test_responses(spark):
    asked = spark.createDataFrame([("d1", "k1"), ("d1", "k2"), ("d2", "k3")], "document_id string, key string")
    table = spark.createDataFrame([("k1", "small", "a", "1"), ("k1", "large", "b", "2"), ("k2", "other", "c", "3")], "key string, model string, value string, created_at string")
    assert {(r.key, r.model, r.value) for r in responses.answered(asked, table, ["large", "small"]).collect()} == {("k1", "large", "b"), ("k2", "other", "c"), ("k3", None, None)}
    assert [r.key for r in responses.missing(asked, table).collect()] == ["k3"]
    assert {(r.document_id, r.state) for r in responses.coverage(asked, table).collect()} == {("d1", "full"), ("d2", "skip")}
    failed = responses.extract(responses.missing(asked, table).select("key"), responses.no_extractor).collect()
    assert [(r.key, r.value, r.error) for r in failed] == [("k3", None, "no extractor")]


def claim(**kw):
    value = {"kind": "number", "raw": "8,141.7", "number": 8141.7, "unit": None, "scale": "crore", "currency": "INR"} | kw.pop("value", {})
    return {"claim": "c", "subject": "Acme", "predicate": "revenue", "factType": "quantity", "value": value, "period": "FY24", "basis": [" Consolidated ", ""], "quote": "Revenue 8,141.7", "confidence": 0.9} | kw


def test_ingest(spark):
    answers = [claim(), claim(subject=" acme "), claim(confidence=1.5), claim(factType="guess"), claim(quote="made up words"), claim(value={"raw": "(8,141.7)"}, predicate="loss", quote="Loss (8,141.7)")]
    raw = spark.createDataFrame([("d", 1, 0, json.dumps(answers)), ("d", 2, 1, "not json"), ("d", 9, 2, json.dumps([claim()]))], "document_id string, page_number int, unit int, value string")
    valid, rejected = ingest.raw_claims(raw)
    assert rejected.count() == 2
    docs = spark.createDataFrame([("d", "2024-05-01")], "document_id string, published_at string")
    pages = spark.createDataFrame([("d", 1, "Statement of accounts for the year, in crore of rupees\nRevenue 8,141.7\nLoss (8,141.7)"), ("d", 2, "")], "document_id string, page_number int, text string")
    from claimweave.operators.grounding import ground_claims

    kept, out = ingest.split_grounded(ground_claims(ingest.scoped(valid, docs), pages))
    assert sorted(r.reason for r in out.collect()) == ["page_not_found", "quote_not_found"]
    facts = ingest.dedupe(kept, ["unit", "claim_pos"])
    assert sorted((r.predicate, r.number) for r in facts.collect()) == [("loss", -8141.7), ("revenue", 8141.7)]
    assert all(r.basis == ["consolidated"] and r.asserted_as_of == "2024-05-01" for r in facts.collect())
    units = spark.createDataFrame([("d", True), ("d", False)], "document_id string, salient boolean")
    s = ingest.ingest_stats(pages, units, facts, out).first()
    assert (s.pages, s.pages_with_text, s.units, s.skipped, s.facts, s.quarantined, s.page_not_found, s.quote_not_found) == (2, 1, 2, 1, 2, 2, 1, 1)
    rate = store.grounding_rate(facts, out).first()
    assert (rate.kept, rate.rejected, rate.rate) == (2, 2, 0.5)


@pytest.mark.parametrize("number,raw,want", [(4516.08, "(4,516.08)", -4516.08), (-452.0, "(452)", -452.0), (-452.0, "-452", -452.0), (8141.7, "8,141.7", 8141.7), (999.0, "(452)", 999.0), (None, "(452)", -452.0)])
def test_sign(spark, number, raw, want):
    assert spark.createDataFrame([(number, raw)], "n double, r string").select(ingest.signed("n", "r")).first()[0] == want


def test_store(spark):
    facts = spark.createDataFrame([(k, f"f{k}", f"d{k % 2}", "quantity", "s", "p", f"Claim {k}% up", "S", "P") for k in range(4)], "fact_seq long, id string, document_id string, fact_type string, canonical_subject_id string, canonical_predicate_id string, claim string, subject string, predicate string")
    rel = spark.createDataFrame([("r1", "f0", "f2", "CORROBORATES", 0.9), ("r2", "f0", "f1", "CORROBORATES", 0.8), ("r3", "f1", "f3", "CONTRADICTS", 0.7)], "id string, fact_a_id string, fact_b_id string, verdict string, confidence double")
    assert [r.id for r in store.list_facts(facts, document_id="d0", q="cLAIM _%").collect()] == ["f0", "f2"]
    assert [r.id for r in store.list_facts(facts, limit=1, offset=2).collect()] == ["f2"]
    assert [r.id for r in store.list_relations(rel, k=2).collect()] == ["r1", "r2"] and [r.id for r in store.list_relations(rel, "CONTRADICTS").collect()] == ["r3"]
    assert {r.id for r in store.relations_of(rel, "f1").collect()} == {"r2", "r3"}
    assert {r.verdict: (r.id, r.cross) for r in store.best_per_verdict(rel, facts).collect()} == {"CORROBORATES": ("r2", True), "CONTRADICTS": ("r3", False)}
    left = store.delete_document({"facts": facts, "relations": rel}, "d1")
    assert [r.id for r in left["relations"].collect()] == ["r1"] and left["facts"].count() == 2
    assert {r.id: r.claim for r in store.patch(facts, "id", "f1", {"claim": F.lit("new")}).collect()}["f1"] == "new"
    up = store.upsert(rel, rel.filter("id = 'r1'").withColumn("verdict", F.lit("X")), ["fact_a_id", "fact_b_id"])
    assert {r.id: r.verdict for r in up.collect()} == {"r1": "X", "r2": "CORROBORATES", "r3": "CONTRADICTS"}
    w = spark.createDataFrame([("0123456789",)], "t string").select(store.evidence_window(F.col("t"), F.lit(4), F.lit(6), 2).alias("w")).first().w
    assert (w.before, w.mark, w.after) == ("…23", "45", "67…")


def test_stream_gives_the_relations_of_one_batch(spark, tmp_path):
    claims = star.claims(spark, SF).filter("document_id in ('annual', 'deck', 'typo')")
    claims.filter("document_id <> 'typo'").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    claims.filter("document_id = 'typo'").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    incremental.stream(spark, f"{tmp_path}/in/*", claims.schema, str(tmp_path), star.edges(spark), buckets=4).awaitTermination(300)
    got = {(r.id, r.verdict) for r in incremental.current_relations(spark, str(tmp_path)).collect()}
    assert got == {(r.id, r.verdict) for r in relations(star.lift(claims), star.edges(spark)).collect()} and got
