"""From facts to relations, and the incremental form of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocking import KEY, block_pairs
from ..operators.reasoning import context, judge
from ..operators.registry import canonicalize, normal_form
from ..operators.store import set_canonical
from ..operators.subsumption import subsumed_pairs

SIDE = ["fact_seq", "id", "document_id", "page_number", "subject", "predicate", "value_kind", "value_raw", "value_iso", "value_id", "period", "asserted_as_of", "basis", "canonical_predicate_id", "normalized_number", "normalized_unit", "confidence"]


def with_edges(pairs: DataFrame, edges: DataFrame | None) -> DataFrame:
    """pairs with the symmetric registry edge (kind) between the values' registry ids, exclusive before compatible."""
    if edges is None:
        return pairs.withColumn("edge", F.lit(None).cast("string"))
    own = edges.filter(F.col("kind").isin("exclusive", "compatible"))
    both = own.select("a", "b", "kind").union(own.select("b", "a", "kind")).groupBy("a", "b").agg(F.max("kind").alias("edge"))
    both = both.select(F.col("a").alias("edge_a"), F.col("b").alias("edge_b"), "edge")
    return pairs.join(both, (F.col("fa.value_id") == F.col("edge_a")) & (F.col("fb.value_id") == F.col("edge_b")), "left")


def judged_pairs(facts: DataFrame, edges: DataFrame | None = None, rules: str = "reference", include_subsumed: bool = False, **limits) -> DataFrame:
    """Every pair with value, deltas and decision, unrelated ones too.

    include_subsumed adds pairs of measures of which one contains the other by the subsumes edges, in the block of the
    broader one; the predicate axis tells which.
    """
    side = facts.select(F.struct(*SIDE).alias("f")).withColumn("c", context(F.col("f")))
    pairs, broader = block_pairs(facts, **limits), None
    if include_subsumed and edges is not None:
        across = subsumed_pairs(facts, edges, **{k: v for k, v in limits.items() if k == "cap"})
        pairs, broader = pairs.withColumn("broader", F.lit(None).cast("string")).unionByName(across), F.col("broader")
    pairs = pairs.join(side.select(F.col("f.fact_seq").alias("a_seq"), F.col("f").alias("fa"), F.col("c").alias("ca")), "a_seq")
    pairs = pairs.join(side.select(F.col("f.fact_seq").alias("b_seq"), F.col("f").alias("fb"), F.col("c").alias("cb")), "b_seq")
    pairs = with_edges(pairs, edges)
    return pairs.select(*KEY, "a_seq", "b_seq", F.col("fa.id").alias("fact_a_id"), F.col("fb.id").alias("fact_b_id"), judge(F.col("fa"), F.col("fb"), F.col("ca"), F.col("cb"), F.col("edge"), rules, broader).alias("j"))


def relations(facts: DataFrame, edges: DataFrame | None = None, rules: str = "reference", **limits) -> DataFrame:
    """The relations worth keeping: one row per related pair, a before b."""
    pairs = judged_pairs(facts, edges, rules, **limits).filter("j.decision.verdict <> 'UNRELATED'")
    return pairs.select(
        F.concat(F.lit("rel_"), F.col("a_seq").cast("string"), F.lit("_"), F.col("b_seq").cast("string")).alias("id"), *KEY, "fact_a_id", "fact_b_id",
        "j.decision.verdict", "j.decision.confidence", "j.decision.axis", F.col("j.value.relation").alias("value_relation"), F.col("j.deltas").alias("deltas"),
        "j.decision.explanation", F.lit("rule").alias("decided_by"), "j.decision.rule_id",
    )


def canonicalized(facts: DataFrame, adjudications: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, edges): facts with the registry ids of their subjects, measures and values, settled in the order of mention.

    The labels of all facts go through the registry, so that labels that its tiers merge share an id; adjudications are as
    in registry.canonicalize. Edges carry the same ids as the facts.
    """
    labels = labels_of(facts)
    _, members, edges = canonicalize(labels, adjudications)
    return with_entries(facts, labels, members), edge_ids(edges)


def labels_of(facts: DataFrame) -> DataFrame:
    """The labels that facts mention (id, namespace, label, hint, seq): subject, measure, and value where it is a text."""
    text = F.col("value_kind").isin("categorical", "entity")
    label = lambda namespace, label, hint: F.struct(F.lit(namespace).alias("namespace"), F.col(label).alias("label"), hint.alias("hint"))
    named = F.array_compact(F.array(label("subject", "subject", F.lit("")), label("predicate", "predicate", F.lit("")), F.when(text, label("value", "value_raw", F.col("predicate")))))
    return facts.select("fact_seq", "id", F.explode(named).alias("l")).select("id", "l.*", F.col("fact_seq").alias("seq"))


def with_entries(facts: DataFrame, labels: DataFrame, members: DataFrame) -> DataFrame:
    """facts with the registry ids of their labels, by the entries of members (namespace, normal, entry)."""
    own = labels.withColumn("normal", normal_form(F.col("namespace"), F.col("label"), F.col("hint"))).join(members.select("namespace", "normal", "entry"), ["namespace", "normal"])
    entry = lambda n: F.max(F.when(F.col("namespace") == n, F.concat(F.lit(f"{n}:"), F.col("entry"))))
    ids = own.groupBy("id").agg(entry("subject").alias("canonical_subject_id"), entry("predicate").alias("canonical_predicate_id"), entry("value").alias("value_id"))
    return set_canonical(facts, ids)


def edge_ids(edges: DataFrame) -> DataFrame:
    """Registry edges (namespace, a, b, kind) with the ids that facts carry."""
    return edges.select(*[F.concat(F.col("namespace"), F.lit(":"), F.col(c)).alias(c) for c in "ab"], "kind")


def touched(facts: DataFrame, new: DataFrame) -> DataFrame:
    """The facts of blocks that new facts fall into."""
    keys = new.select(F.col(KEY[0]).alias("k0"), F.col(KEY[1]).alias("k1")).distinct()
    return facts.join(keys, (F.col(KEY[0]) == F.col("k0")) & F.col(KEY[1]).eqNullSafe(F.col("k1")), "left_semi")


def updated_relations(old: DataFrame, facts: DataFrame, new: DataFrame, edges: DataFrame | None = None, **options) -> DataFrame:
    """Relations after new has been added to facts: the blocks that it touches are judged anew, the others stay."""
    fresh = relations(touched(facts, new), edges, **options)
    keys = new.select(F.col(KEY[0]).alias("k0"), F.col(KEY[1]).alias("k1")).distinct()
    kept = old.join(keys, (F.col(KEY[0]) == F.col("k0")) & F.col(KEY[1]).eqNullSafe(F.col("k1")), "left_anti")
    return kept.unionByName(fresh)
