"""Reconciliation of a stream of claims: each micro-batch touches only the blocks that it falls into.

State is kept in tables, so late claims are just another batch; their publication date is data, not event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocking import KEY
from ..plans.reconcile import relations, touched
from ..sources.star import lift

BUCKETS = 64


def bucket(buckets: int = BUCKETS):
    """A block's bucket: relations are stored and replaced by it."""
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(k), F.lit("")) for k in KEY]), F.lit(buckets)).cast("int")


def apply_batch(batch: DataFrame, batch_id: int, path: str, edges: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Add a batch of claims to the fact table under path and judge the blocks that they fall into anew; buckets bound what is read.

    Facts and relations of a batch have their own partitions, so a batch that is run again replaces itself.
    """
    spark = batch.sparkSession
    mode = {"partitionOverwriteMode": "dynamic"}
    facts = lift(batch).withColumn("bucket", bucket(buckets)).withColumn("batch", F.lit(batch_id))
    facts.write.mode("overwrite").options(**mode).partitionBy("bucket", "batch").parquet(f"{path}/facts")
    every = spark.read.parquet(f"{path}/facts")
    hit = [r["bucket"] for r in every.filter(F.col("batch") == batch_id).select("bucket").distinct().collect()]  # at most buckets
    near = every.filter(F.col("bucket").isin(hit)).drop("bucket")
    new = near.filter(F.col("batch") == batch_id).drop("batch")
    fresh = relations(touched(near.drop("batch"), new), edges)
    fresh = fresh.withColumn("bucket", bucket(buckets)).withColumn("batch", F.lit(batch_id))
    fresh.write.mode("overwrite").options(**mode).partitionBy("bucket", "batch").parquet(f"{path}/relations")


def current_relations(spark: SparkSession, path: str) -> DataFrame:
    """The relations of each block as the last batch that touched it left them."""
    keys = [F.col(k).alias(f"__{k}") for k in KEY]
    last = spark.read.parquet(f"{path}/facts").groupBy("bucket", *keys).agg(F.max("batch").alias("__batch")).withColumnRenamed("bucket", "__bucket")
    rel = spark.read.parquet(f"{path}/relations")
    on = (F.col("bucket") == F.col("__bucket")) & (F.col("batch") == F.col("__batch"))
    for k in KEY:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rel.join(last, on).select(*[c for c in rel.columns if c not in ("bucket", "batch")])


def stream(spark: SparkSession, source: str, schema, path: str, edges: DataFrame | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Reconcile all claims that arrive as Parquet files in source, then stop."""
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    work = lambda df, k: apply_batch(df, k, path, edges, buckets)
    return arriving.writeStream.foreachBatch(work).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
