"""Lookups and changes of tables, files and their properties, the registry chain, block-wise streams."""

from pyspark.sql import functions as F

from claimweave.operators import store
from claimweave.plans import queries as core
from claimweave.plans.reconcile import canonicalized
from claimweave.sources import files, star

SF = "/root/testdata/sf0.001"


def test_tables_are_written_read_and_emptied(spark, tmp_path):
    tables = {"facts": spark.createDataFrame([("f1", "d1"), ("f2", "d2")], "id string, document_id string"), "relations": spark.createDataFrame([("f1", "f2")], "fact_a_id string, fact_b_id string")}
    store.write_tables(tables, str(tmp_path))
    back = store.read_tables(spark, str(tmp_path), ["facts", "relations"])
    assert sorted(map(tuple, back["facts"].collect())) == [("f1", "d1"), ("f2", "d2")]
    assert store.clear_relations(back)["relations"].count() == 0 and store.clear_relations(back)["facts"].count() == 2
    assert all(t.count() == 0 for t in store.reset(back).values())
    assert store.get_fact(back["facts"], "f2").first().document_id == "d2" and store.count_facts(back["facts"], "d1").first().n == 1


def test_replaced_documents_take_all_with_them(spark):
    docs = spark.createDataFrame([("d1", "/a"), ("d2", "/b"), ("d3", None)], "document_id string, source_path string")
    facts = spark.createDataFrame([("f1", "d1"), ("f2", "d2")], "id string, document_id string")
    rel = spark.createDataFrame([("f1", "f2"), ("f2", "f2")], "fact_a_id string, fact_b_id string")
    new = spark.createDataFrame([("d9", "/a"), ("d8", "/c")], "document_id string, source_path string")
    admitted, refused = store.admit(docs, new)
    assert [r.document_id for r in admitted.collect()] == ["d8"] and [r.document_id for r in refused.collect()] == ["d9"]
    left = store.replace_documents({"documents": docs, "facts": facts, "relations": rel}, store.admit(docs, new, force=True)[0])
    assert sorted(r.document_id for r in left["documents"].collect()) == ["d2", "d3"]
    assert [r.id for r in left["facts"].collect()] == ["f2"] and [tuple(r) for r in left["relations"].collect()] == [("f2", "f2")]


def test_folder_and_properties(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "2024-annual_report.pdf").write_bytes(b"%PDF-")
    (tmp_path / "notes.txt").write_text("x")
    row = files.scan(spark, str(tmp_path)).first()
    assert row.title == "Annual Report" and row.size == 5 and row.source_path.endswith("in/2024-annual_report.pdf")
    rows = spark.createDataFrame([(" A  b ", "D:20240812153000+05'30'"), ("  ", "2024"), (None, None)], "t string, c string").select(files.metadata("t", "c").alias("m")).collect()
    assert [tuple(r.m) for r in rows] == [("A  b", "2024-08-12"), (None, None), (None, None)]


def test_merged_labels_share_blocks(spark):
    """Without the registry's merges the facts of the chain fall into other blocks and get other verdicts."""
    chain = {(r.verdict, r.rule_id): r.n for r in core.QUERIES["chain_verdicts"](spark, SF).collect()}
    facts = core.derived_facts(spark, SF)
    apart = facts.withColumn("canonical_predicate_id", F.when(F.col("document_id") == "deck", "predicate:other").otherwise(F.col("canonical_predicate_id")))
    from claimweave.plans.reconcile import judged_pairs

    split = {(r[0], r[1]): r[2] for r in judged_pairs(apart, star.edges(spark)).groupBy("j.decision.verdict", "j.decision.rule_id").count().collect()}
    assert chain and split != chain and sum(split.values()) < sum(chain.values())


def test_canonical_ids_of_few_facts(spark):
    rows = [(1, "f1", "Acme Ltd", "Status", "categorical", "Active"), (2, "f2", "ACME Limited", "status", "categorical", "Closed"), (3, "f3", "Acme", "Head count", "number", "7")]
    facts = spark.createDataFrame(rows, "fact_seq long, id string, subject string, predicate string, value_kind string, value_raw string").withColumns({c: F.lit(None).cast("string") for c in ("canonical_subject_id", "canonical_predicate_id", "value_id")})
    told = spark.createDataFrame([("value", "closed", "active", "exclusive")], "namespace string, normal string, candidate string, relation string")
    named, edges = canonicalized(store.pending_facts(facts), told)
    got = {r.id: (r.canonical_subject_id, r.canonical_predicate_id, r.value_id) for r in named.collect()}
    assert len({s for s, _, _ in got.values()}) == 1 and got["f1"][1] == got["f2"][1] == "predicate:status" and got["f3"][2] is None
    assert [tuple(r) for r in edges.collect()] == [("value:active", "value:closed", "exclusive")]
    assert store.pending_facts(named).count() == 0
