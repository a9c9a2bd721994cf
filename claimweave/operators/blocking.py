"""Blocks of comparable facts and the pairs within them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import same_key
from .work import is_empty, numbered, save

KEY = ["canonical_predicate_id", "canonical_subject_id"]
#: A block of more members pairs different documents only; of each block the first PAIRS pairs in order are taken.
CROSS_DOCUMENT_ABOVE, PAIRS = 40, 1_200


def blocks(facts: DataFrame) -> DataFrame:
    """canonical_predicate_id, canonical_subject_id (may be null), members, of blocks with at least two facts."""
    return facts.filter("canonical_predicate_id is not null").groupBy(*KEY).agg(F.count("*").alias("members")).filter("members > 1")


def _of_block(name: str) -> list:
    return [F.col(k).alias(f"{name}_{k}") for k in KEY]


def _same_block(name: str):
    return same_key(KEY, [f"{name}_{k}" for k in KEY])


def _ranked(rows: DataFrame, label: str) -> DataFrame:
    """rows of blocks of at least two, with members and rank, from 0 in the order of fact_seq; no task sorts a whole block."""
    placed = numbered(rows, [*KEY, "fact_seq"], "pos", label)
    sized = placed.groupBy(*KEY).agg(F.count("*").alias("members"), F.min("pos").alias("low")).filter("members > 1").select(*_of_block("of"), "members", "low")
    return placed.join(sized, _same_block("of")).select(*rows.columns, "members", (F.col("pos") - F.col("low")).alias("rank"))


def block_pairs(facts: DataFrame, cross_above: int = CROSS_DOCUMENT_ABOVE, cap: int | None = PAIRS) -> DataFrame:
    """canonical_predicate_id, canonical_subject_id, a_seq, b_seq with a_seq < b_seq, in the order of which the first cap
    pairs of each block are taken; cap=None takes all. Facts without a document are of one document.

    The first cap pairs are known before any pair is made, and no step needs a block in one place. A fact has partners
    unless all later ones are of its document, so those with partners come first, and the first sides of the pairs are
    among the first cap facts; what they have in partners follows from the sizes of the block and of their documents in
    it. Their partners are among the first 4 * cap facts, where at most one document has more than half, and for that one
    document among the first 2 * cap facts of others.
    """
    rows = facts.filter("canonical_predicate_id is not null").select(*KEY, "fact_seq", "document_id")
    large = F.col("members") > cross_above
    meets = _same_block("b") & (F.col("fact_seq") < F.col("b_seq")) & (~large | ~F.col("document_id").eqNullSafe(F.col("b_doc")))
    side = lambda df: df.select(*_of_block("b"), F.col("fact_seq").alias("b_seq"), F.col("document_id").alias("b_doc"))
    if cap is None:
        sized = blocks(facts).select(*_of_block("of"), "members")
        return rows.join(sized, _same_block("of")).join(side(rows), meets).select(*KEY, F.col("fact_seq").alias("a_seq"), "b_seq")
    ranked = _ranked(rows, "block-order")
    first = save(ranked.filter(F.col("rank") < 4 * cap), "first-of-blocks")
    head = first.filter(F.col("rank") < cap)
    shares = ranked.filter(large).groupBy(*KEY, "document_id").agg(F.count("*").alias("of_document")).select(*_of_block("of"), F.col("document_id").alias("of_doc"), "of_document")
    head = head.join(shares, _same_block("of") & F.col("document_id").eqNullSafe(F.col("of_doc")), "left")
    earlier = F.row_number().over(Window.partitionBy(*KEY, "document_id").orderBy("rank")) - 1
    head = head.withColumn("partners", F.col("members") - 1 - F.col("rank") - F.when(large, F.col("of_document") - 1 - earlier).otherwise(0))
    before = F.sum("partners").over(Window.partitionBy(*KEY).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    a = head.withColumn("before", F.coalesce(before, F.lit(0))).filter((F.col("before") < cap) & (F.col("partners") > 0)).select(*KEY, "fact_seq", "document_id", "members", "before")

    others = first.select(*rows.columns)
    most = first.filter(large & (F.col("members") > 4 * cap)).groupBy(*KEY, "document_id").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * cap)
    most = save(most.select(*_of_block("of"), F.col("document_id").alias("of_doc")), "one-document")
    if not is_empty(most):
        far = ranked.filter(F.col("members") > 4 * cap).join(most, _same_block("of") & ~F.col("document_id").eqNullSafe(F.col("of_doc"))).select(*rows.columns, F.col("rank").alias("at"))
        others = others.unionByName(_firsts(far, 2 * cap).filter(F.col("at") >= 4 * cap).select(*rows.columns))
    nth = F.row_number().over(Window.partitionBy(*KEY, "fact_seq").orderBy("b_seq"))
    pairs = a.join(side(others), meets).withColumn("nth", F.col("before") + nth).filter(F.col("nth") <= cap)
    return pairs.select(*KEY, F.col("fact_seq").alias("a_seq"), "b_seq")


def _firsts(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows of each block; a block of one row counts as well."""
    placed = numbered(rows, [*KEY, "fact_seq"], "pos", "others-order")
    low = placed.groupBy(*KEY).agg(F.min("pos").alias("low")).select(*_of_block("of"), "low")
    return placed.join(low, _same_block("of")).filter(F.col("pos") - F.col("low") < n).select(*rows.columns)
