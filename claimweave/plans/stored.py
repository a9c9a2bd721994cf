"""Registered queries of what is stored and grows: the registry and the corpus, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vocabulary
from ..operators.derivation import derivations
from ..operators.tables import Store
from ..operators.work import save, shared_path
from ..sources import responses, star
from . import live
from . import queries as core
from .queries import _JUDGED, _KEPT, _WITH, SETTLED, query
from .reconcile import judged_pairs


@query(SETTLED + "SELECT namespace, normal, entry, tier, occurrences FROM settled")
def registry_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of suppliers and parts in two batches, the second settled against the store alone: the forms of one batch."""
    labels = save(core._labels(spark, sf_dir), "labels")
    middle = labels.filter("namespace = 'predicate'").agg(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    store = Store(spark, shared_path(spark, "registry"), vocabulary.LAYOUT)
    for part in (F.col("seq") <= middle, F.col("seq") > middle):
        change = store.begin()
        vocabulary.settle(change, labels.filter(part))
        change.commit()
    return store.table("forms").select("namespace", "normal", "entry", "tier", "occurrences")


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of the star tables, each quoted from a line of its page; every eleventh also with a made-up quote."""
    claims = star.claims(spark, sf_dir)
    line = F.concat_ws(" ", "subject", "predicate", "value_raw", "scale", "period_raw")
    claims = claims.withColumns({"page_number": ((F.col("fact_seq") / 40) % 1_000_000).cast("int"), "line": line, "quote": line})
    wrong = claims.filter("fact_seq % 11 = 0").withColumns({"quote": core._made_up(F.col("line")), "value_raw": F.lit("12,345"), "fact_seq": F.col("fact_seq") + 10**12})
    return save(claims.unionByName(wrong), "printed")


@query(
    _WITH + _JUDGED + _KEPT + "SELECT 'both batches' AS state, id, verdict, rule_id, confidence FROM kept UNION ALL SELECT 'without typo', id, verdict, rule_id, confidence FROM kept WHERE a_doc <> 'typo' AND b_doc <> 'typo' "
    "UNION ALL SELECT 'quarantine', 'fact_' || (seq + 1000000000000), 'quote_not_found', NULL, 0.9 FROM facts WHERE seq % 11 = 0"
)
def live_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All claims in two batches of no order, a third of them in both: the relations of one batch, then those without a document."""
    printed = _printed(spark, sf_dir)
    pages = printed.filter(f"fact_seq < {10**12}").groupBy("document_id", "page_number").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("text"))
    part = F.pmod(F.xxhash64("fact_seq"), F.lit(3))
    answers = spark.createDataFrame([("value", "overdrawn", "active", "exclusive")], "namespace string, normal string, candidate string, relation string")
    store = live.open_store(spark, shared_path(spark, "corpus"))
    live.ingest_batch(store, printed.filter(part <= 1).drop("line"), pages, adjudications=answers, batch=0)
    live.ingest_batch(store, printed.filter(part >= 1).drop("line"), adjudications=answers, batch=1)
    whole = store.manifest()
    change = store.begin()
    live.remove_documents(change, spark.createDataFrame([("typo",)], "document_id string"))
    change.commit()
    columns = ["id", "verdict", "rule_id", "confidence"]
    states = [store.table("relations", manifest=m).select(F.lit(name).alias("state"), *columns) for name, m in (("both batches", whole), ("without typo", store.manifest()))]
    rejected = store.table("quarantine", manifest=whole).select(F.lit("quarantine").alias("state"), F.concat(F.lit("fact_"), F.col("fact_seq").cast("string")).alias("id"), F.col("reason").alias("verdict"), F.lit(None).cast("string").alias("rule_id"), "confidence")
    return states[0].union(states[1]).union(rejected)


@query(
    _WITH
    + """, fours AS (SELECT n, fy FROM revenue WHERE q > 0 GROUP BY n, fy HAVING count(*) = 4)
SELECT 'fact_' || ((CAST(k AS BIGINT) * 100 + s.n) * 10000 + s.fy) * 10 AS fact_id, doc AS document_id, 'quarterly' AS parts_document, CAST(4 AS INT) AS parts,
       CAST(floor(1000 / share + 0.5) AS BIGINT) AS thousandths, share = 1 AS holds, CASE WHEN share = 1 THEN 'DERIVES' END AS verdict
FROM fours s JOIN docs ON s.n % every = 0 WHERE doc IN ('annual', 'deck', 'standalone', 'typo')"""
)
def derived_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarters of each nation against what four documents say of the year; the standalone share and the wrong figure don't follow."""
    rows = derivations(core.derived_facts(spark, sf_dir))
    ratio = F.floor(F.col("total") / F.col("value") * 1000 + 0.5).cast("long")
    return rows.select("fact_id", "document_id", "parts_document", F.size("parts").alias("parts"), ratio.alias("thousandths"), "holds", "verdict")


@query(
    _WITH
    + """, world AS (
  SELECT 'World' AS name, fy, sum(total) AS total FROM revenue WHERE q = 0 GROUP BY fy
  UNION ALL SELECT r_name, fy, sum(total) FROM revenue JOIN nation ON n = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE q = 0 GROUP BY r_name, fy
  UNION ALL SELECT n_name, fy, total FROM revenue JOIN nation ON n = n_nationkey WHERE q = 0),
edges AS (SELECT 'World' AS a, r_name AS b FROM region UNION ALL SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey),
ways AS (WITH RECURSIVE w AS (SELECT a, b FROM edges UNION SELECT w.a, e.b FROM w JOIN edges e ON w.b = e.a) SELECT * FROM w)
SELECT w.a AS broader, w.b AS narrower, CASE WHEN abs(x.total - y.total) <= 0.005 * greatest(x.total, y.total) THEN 'R2' WHEN x.fy = y.fy THEN 'R4-predicate' ELSE 'R4-different-times' END AS rule_id,
       'Measures differ: ' || w.a || ' and ' || w.b || ': the first contains the second' AS note, count(*) AS n
FROM ways w JOIN world x ON x.name = w.a JOIN world y ON y.name = w.b GROUP BY ALL"""
)
def subsumed_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenues of the world, its regions and nations as measures of which one contains the next: each against all that it contains."""
    nations = core.table(spark, sf_dir, "nation").join(core.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.regexp_replace(F.lower("n_name"), "_", " ").alias("name"), "n_name", "r_name")
    said = core.derived_facts(spark, sf_dir).filter("document_id = 'annual'").withColumn("name", F.substring("canonical_subject_id", 9, 1000))
    base = save(said.join(nations, "name"), "of-nations")
    rest = [c for c in said.columns if c not in ("fact_seq", "id", "predicate", "normalized_number", "period", "name")]

    def measured(column, level: int) -> DataFrame:
        rows = base.withColumn("predicate", column).groupBy("predicate", F.col("period.start").alias("start"))
        rows = rows.agg(F.sum("normalized_number").alias("normalized_number"), F.first("period").alias("period"), *[F.first(c).alias(c) for c in rest])
        seq = F.pmod(F.xxhash64("predicate", "start"), F.lit(10**15)) + level * 10**15
        rows = rows.withColumns({"fact_seq": seq, "id": seq.cast("string"), "canonical_subject_id": F.lit("subject:group"), "canonical_predicate_id": F.concat(F.lit("predicate:"), "predicate")})
        return rows.select(*[c for c in said.columns if c != "name"])

    facts = save(measured(F.lit("World"), 0).unionByName(measured(F.col("r_name"), 1)).unionByName(measured(F.col("n_name"), 2)), "measures")
    pairs = nations.select(F.lit("World").alias("a"), F.col("r_name").alias("b")).union(nations.select("r_name", "n_name")).distinct()
    edges = pairs.select(*[F.concat(F.lit("predicate:"), c).alias(c) for c in "ab"], F.lit("subsumes").alias("kind"))
    judged = judged_pairs(facts, edges, include_subsumed=True).join(facts.select(F.col("fact_seq").alias("a_seq"), F.col("predicate").alias("broader")), "a_seq").join(facts.select(F.col("fact_seq").alias("b_seq"), F.col("predicate").alias("narrower")), "b_seq")
    return judged.filter("broader <> narrower").groupBy("broader", "narrower", F.col("j.decision.rule_id").alias("rule_id"), F.col("j.deltas")[4]["note"].alias("note")).agg(F.count("*").alias("n"))


def _reader(batch):
    """An extractor that refuses every fifth document."""
    ok = batch["doc_id"] % 5 != 0
    return batch.assign(value=("read " + batch["doc_id"].astype(str)).where(ok, None), error=ok.map({True: None, False: "refused"}))


@query(
    """WITH d AS (SELECT doc_id, doc_id % 3 = 0 AS stored, doc_id % 5 <> 0 AS readable FROM documents)
SELECT 'first' AS run, doc_id, CASE WHEN stored THEN 'kept ' || doc_id WHEN readable THEN 'read ' || doc_id END AS value, CASE WHEN stored THEN 'm1' WHEN readable THEN 'm2' END AS model, CASE WHEN NOT stored AND NOT readable THEN 'refused' END AS error, stored AS hit FROM d
UNION ALL SELECT 'second', doc_id, CASE WHEN stored THEN 'kept ' || doc_id WHEN readable THEN 'read ' || doc_id END, CASE WHEN stored THEN 'm1' WHEN readable THEN 'm2' END, CASE WHEN NOT stored AND NOT readable THEN 'refused' END, stored OR readable FROM d"""
)
def stored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document asked for twice: a third has an answer, others are read and stored, some are refused both times."""
    d = core.table(spark, sf_dir, "documents").select("doc_id", responses.response_key(F.lit("v2"), "extract", F.col("doc_id").cast("string")).alias("key"))
    store = Store(spark, shared_path(spark, "answers"), responses.LAYOUT)
    change = store.begin()
    known = d.filter("doc_id % 3 = 0").select("key", F.lit("m1").alias("model"), F.concat(F.lit("kept "), F.col("doc_id").cast("string")).alias("value"), F.lit("2024-01-01").alias("created_at"))
    change.upsert("responses", known, ["key", "model"])
    change.commit()
    runs = []
    for run in ("first", "second"):
        change = store.begin()
        told = responses.answer(change, d, _reader, ["m2", "m1"], "m2", "2024-05-01", attempts=2)
        change.commit()
        runs.append(told.select(F.lit(run).alias("run"), "doc_id", "value", "model", "error", "hit"))
    return runs[0].union(runs[1])
