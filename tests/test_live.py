"""The stored corpus: any split of claims, failures, removal, and what a change touches."""

import random

import pytest
from pyspark.sql import functions as F

from claimweave.operators import registry, vocabulary
from claimweave.operators.store import delete_document
from claimweave.operators.tables import Store
from claimweave.operators.work import save
from claimweave.plans import live
from claimweave.plans.reconcile import relations
from claimweave.sources import star

SF = "/root/testdata/sf0.001"
ANSWERS = [("value", "overdrawn", "active", "exclusive")]


@pytest.fixture(scope="module")
def claims(spark):
    """Claims of four documents with the line that each is quoted from, and made-up quotes."""
    rows = star.claims(spark, SF).filter("document_id in ('annual', 'deck', 'typo', 'status-b') and fact_seq % 3 <> 1")
    line = F.concat_ws(" ", "subject", "predicate", "value_raw", "scale", "period_raw")
    quote = F.when(F.col("fact_seq") % 10 == 4, F.concat(F.lit("zzqx "), line, F.lit(" qqzx"))).otherwise(line)
    rows = rows.withColumns({"page_number": ((F.col("fact_seq") / 40) % 1000).cast("int"), "quote": quote, "line": line})
    return save(rows, "live-claims")


@pytest.fixture(scope="module")
def pages(claims):
    return claims.groupBy("document_id", "page_number").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("text"))


def told(rows):
    return {(r.id, r.verdict, r.rule_id) for r in rows.collect()}


def answers(spark):
    return spark.createDataFrame(ANSWERS, "namespace string, normal string, candidate string, relation string")


def expected(spark, claims):
    kept = claims.filter("fact_seq % 10 <> 4")
    return told(relations(star.lift(kept), star.edges(spark)))


def test_splits(spark, claims, pages, tmp_path):
    """Batches in no order, with duplicates of claims in the other batch, give the relations of one; documents can come again."""
    again = claims.filter("fact_seq % 4 = 0").withColumns({"fact_seq": F.col("fact_seq") + 10**12, "subject": F.concat(F.lit(" "), F.upper("subject"))})
    part = F.pmod(F.xxhash64("fact_seq"), F.lit(2))
    store = live.open_store(spark, f"{tmp_path}/s", 8)
    every = claims.unionByName(again)
    docs = claims.select("document_id").distinct().withColumn("source_path", F.concat(F.lit("/in/"), "document_id"))
    for k in range(2):
        batch = every.filter(part == k).drop("line")
        assert live.ingest_batch(store, batch, *([] if k else [pages, docs]), adjudications=answers(spark), batch=k) == k + 1
    first = told(store.table("relations"))
    assert first == expected(spark, claims)
    facts = store.table("facts")
    assert facts.count() == claims.filter("fact_seq % 10 <> 4").count() and facts.filter(f"fact_seq >= {10**12}").count() == 0
    assert store.table("quarantine").groupBy("reason").count().collect()[0]["reason"] == "quote_not_found"
    # A batch that comes again is left out.
    assert live.ingest_batch(store, claims, batch=1) == 2 and store.manifest()["version"] == 2
    own = live.relations_of_document(store, "typo")
    ids = {r.id for r in facts.filter("document_id = 'typo'").select("id").collect()}
    assert told(own) == told(store.table("relations").filter(F.col("fact_a_id").isin(list(ids)) | F.col("fact_b_id").isin(list(ids)))) and ids
    # The document comes under another name: refused, or in its place.
    arriving = spark.createDataFrame([("typo-2", "/in/typo")], "document_id string, source_path string")
    renamed = lambda df: df.filter("document_id = 'typo'").withColumn("document_id", F.lit("typo-2"))
    assert [r.document_id for r in live.reingest(store, arriving, renamed(pages), renamed(claims.drop("line"))).collect()] == ["typo-2"]
    assert told(store.table("relations")) == first
    assert live.reingest(store, arriving, renamed(pages), renamed(claims.drop("line")), force=True).count() == 0
    assert told(store.table("relations")) == first
    assert "typo" not in {r.document_id for r in store.table("documents").collect()} and {r[0] for r in store.table("facts").select("document_id").distinct().collect()} == {"annual", "deck", "typo-2", "status-b"}


def test_stream_and_failure(spark, claims, pages, tmp_path):
    """A stream of files gives the same; a change that dies before its manifest leaves the old state."""
    store = live.open_store(spark, f"{tmp_path}/s", 8)
    change = store.begin()
    change.upsert("pages", pages, ["document_id", "page_number"])
    change.commit()
    names = {"a": "document_id in ('annual', 'status-b')", "b": "document_id in ('deck', 'typo')"}
    for name, where in names.items():
        claims.filter(where).drop("line").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    live.stream(store, f"{tmp_path}/in/*", claims.drop("line").schema, answers(spark)).awaitTermination(300)
    assert told(store.table("relations")) == expected(spark, claims)
    before, version = told(store.table("relations")), store.manifest()["version"]
    dying = store.begin()
    live.remove_documents(dying, spark.createDataFrame([("deck",)], "document_id string"))
    dying.replace("relations", dying.table("relations").limit(0), list(range(8)))
    assert store.manifest()["version"] == version and told(store.table("relations")) == before
    # The next change takes the same version number, and its own folders.
    change = store.begin()
    live.remove_documents(change, spark.createDataFrame([("typo",)], "document_id string"))
    change.commit()
    assert store.manifest()["version"] == version + 1
    with pytest.raises(RuntimeError):
        dying.commit()
    assert store.clean() > 0
    kept = claims.filter("fact_seq % 10 <> 4")
    whole = {"facts": star.lift(kept), "relations": relations(star.lift(kept), star.edges(spark))}
    left = delete_document(whole, "typo")
    assert told(store.table("relations")) == told(left["relations"]) and store.table("facts").count() == left["facts"].count()
    assert store.table("pages").filter("document_id = 'typo'").count() == 0 and store.table("quarantine").filter("document_id = 'typo'").count() == 0


def test_a_change_touches_its_buckets_alone(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", {"t": ["k"]}, 16)
    rows = spark.range(400).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    change = store.begin()
    change.replace("t", rows, list(range(16)))
    change.commit()
    assert store.table("t").count() == 400
    one = spark.createDataFrame([(7, "b"), (1007, "b"), (None, "n")], "k long, v string")
    hit = store.touched("t", one)
    change = store.begin()
    change.upsert("t", one, ["k"])
    change.patch("t", spark.createDataFrame([(8,)], "k long"), {"v": F.lit("c")})
    change.delete("t", spark.createDataFrame([(9,), (5000,)], "k long"))
    change.commit()
    got = {r.k: r.v for r in store.table("t").collect()}
    assert len(got) == 401 and (got[7], got[1007], got[8], got[None]) == ("b", "b", "c", "n") and 9 not in got
    touched = set(hit) | set(store.touched("t", spark.createDataFrame([(8,), (9,), (5000,)], "k long")))
    own = store.manifest()["tables"]["t"]["buckets"]
    assert {int(k) for k, v in own.items() if v.startswith("2-")} <= touched and len(touched) < 8
    assert {int(k) for k, v in own.items() if v.startswith("1-")} >= set(range(16)) - touched
    read = store.near("t", one).inputFiles()
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in read} <= set(hit)
    with pytest.raises(ValueError):
        store.begin().replace("t", rows, [0])


def test_registry_in_batches(spark, tmp_path):
    """Labels in two batches have the entries, members and edges of one."""
    rng = random.Random(9)
    words = ["net", "revenue", "from", "operations", "of", "all", "segments", "after", "tax", "in", "total", "group", "per", "share"]
    labels = [" ".join(rng.sample(words, rng.choice([2, 12, 13, 13, 14]))) for _ in range(60)]
    labels += rng.sample(labels, 15) + ["", "***"]
    asked = [(labels[50], labels[3], "same"), (labels[56], labels[50], "broader"), (labels[57], labels[2], "exclusive")]
    schema = "namespace string, label string, hint string, seq long"
    rows = [("predicate", x, "", k) for k, x in enumerate(labels)]
    answers = spark.createDataFrame([("predicate", *a) for a in asked], "namespace string, normal string, candidate string, relation string")
    entries, members, edges = registry.canonicalize(spark.createDataFrame(rows, schema), answers)
    store = Store(spark, f"{tmp_path}/r", vocabulary.LAYOUT, 8)
    told = {}
    for low, high in ((0, 53), (53, len(rows))):
        change = store.begin()
        for r in vocabulary.settle(change, spark.createDataFrame(rows[low:high], schema), answers).collect():
            told[r.normal] = (r.entry, r.tier)
        change.commit()
    assert told == {r.normal: (r.entry, r.tier) for r in members.collect()}
    show = lambda df: sorted((r.normal, r.canonical, r.seq, r.occurrences, tuple(r.aliases)) for r in df.collect())
    assert show(vocabulary.entries(store)) == show(entries)
    assert {(r.a, r.b, r.kind) for r in store.table("edges").collect()} == {(r.a, r.b, r.kind) for r in edges.collect()}
    n = vocabulary.counts(store).first()
    assert (n.entries, n.forms, n.occurrences) == (entries.count(), members.count(), len(rows))
    found = vocabulary.entry_of(store, spark.createDataFrame([("predicate", labels[0], ""), ("predicate", "never seen", "")], "namespace string, label string, hint string")).collect()
    assert {(r.label, r.entry) for r in found} == {(labels[0], told[labels[0]][0]), ("never seen", None)}
    for e in edges.collect():
        assert (e.a, e.b) in {(r.a, r.b) for r in vocabulary.edges_of(store, "predicate", e.b).collect()}
