"""Measures that contain others: the closure of subsumes edges, and pairs of facts across it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocking import KEY, PAIRS, block_pairs
from .work import save


def closure(edges: DataFrame) -> DataFrame:
    """(broader, narrower) for every way along subsumes edges (a contains b, kind), however long; round trips are left out.

    Each round joins ways with ways, so a chain of n edges takes log n rounds.
    """
    ways = save(edges.filter((F.col("kind") == "subsumes") & (F.col("a") != F.col("b"))).select(F.col("a").alias("broader"), F.col("b").alias("narrower")).distinct(), "ways")
    n = ways.count()
    while True:
        on = ways.select(F.col("broader").alias("narrower"), F.col("narrower").alias("end"))
        longer = ways.join(on, "narrower").select("broader", F.col("end").alias("narrower")).filter("broader <> narrower")
        ways, before = save(ways.union(longer).distinct(), "ways"), n
        n = ways.count()
        if n == before:
            return ways


def subsumed_pairs(facts: DataFrame, edges: DataFrame, cap: int | None = PAIRS) -> DataFrame:
    """canonical_predicate_id (the broader one), canonical_subject_id, a_seq, b_seq, broader (a or b): pairs of facts of one subject,
    one of whose measures contains the other.

    A broader and a narrower measure of a subject make a block of their own, of which the first cap pairs are taken;
    documents make no difference in it.
    """
    ways = closure(edges)
    ends = ways.select("broader", "narrower", F.explode(F.array("broader", "narrower")).alias("canonical_predicate_id"))
    rows = facts.select(*KEY, "fact_seq").join(ends, "canonical_predicate_id")
    both = F.to_json(F.struct("broader", "narrower"))
    # The measure in the place of the document: only pairs of different ones are made.
    rows = rows.select(both.alias("canonical_predicate_id"), "canonical_subject_id", "fact_seq", F.col("canonical_predicate_id").alias("document_id"))
    pairs = block_pairs(rows, cross_above=0, cap=cap)
    names = F.from_json("canonical_predicate_id", "broader string, narrower string")
    first = rows.select("canonical_predicate_id", F.col("fact_seq").alias("a_seq"), F.col("document_id").alias("measure"))
    pairs = pairs.join(first, ["canonical_predicate_id", "a_seq"]).withColumn("ends", names)
    return pairs.select(F.col("ends.broader").alias("canonical_predicate_id"), "canonical_subject_id", "a_seq", "b_seq", F.when(F.col("measure") == F.col("ends.broader"), "a").otherwise("b").alias("broader"))
