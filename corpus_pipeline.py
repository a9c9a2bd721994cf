"""Corpus cleaning and packing as five stages; each is written as Parquet and reread as the next one's documents.

Every stage but the last returns the columns of documents, whatever others they have; the last returns the places of the
packed pieces. Null texts count as empty. An empty table passes every stage. Each row is judged by its own text, so a row
with a null doc_id counts like any other, and so do two texts of one doc_id.

A Python worker lives through all stages and keeps what its largest batch took. So each stage lowers the session's
spark.sql.execution.arrow.maxRecordsPerBatch to BATCH, for what it returns, which runs later, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimweave.llm.common import save
from claimweave.llm.decontaminate import drop_contaminated
from claimweave.llm.exact_dedup import drop_exact_copies
from claimweave.llm.jaccard_join import drop_near_copies
from claimweave.llm.packing import pack
from claimweave.llm.toxicity import drop_toxic

#: Rows of texts that Spark hands to Python at once, and gets back.
BATCH = 1_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(spark: SparkSession) -> None:
    """From now on Python gets BATCH rows at once at most; a lower setting stays."""
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH:
        spark.conf.set(_ROWS, str(BATCH))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    in_small_batches(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space apart, one row stays: the longest, then the smallest doc_id. Null, empty and blank texts are equal."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest doc_id stays, with rows that repeat it, and a row without doc_id only where there is no other; a text without words is linked to equal ones alone."""
    in_small_batches(spark)
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; empty texts contain none, and items of one word are not looked for."""
    in_small_batches(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of what is left; rows that repeat a document are packed each, an empty text is its end id."""
    in_small_batches(spark)
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL expresses neither the label model nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
