"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir, for a table that is written once.

    The setting must name a folder that all machines share; only a session of one machine (local master) does without.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="claimweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/claimweave/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet under spark.checkpoint.dir and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it has fewer partitions than that; a table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).collect()


def numbered(rows: DataFrame, order: list[str], name: str, label: str) -> DataFrame:
    """rows with name: their place from 0 in the order of the columns of order, ascending, nulls first.

    Rows are dealt to tasks by ranges of that order and counted there; what is added up in one place and broadcast has a
    row per task. Rows that are equal in order must be equal in all columns, so that any place among them is as good.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = save(ranged, label)
    task = F.shiftright("__at", 33)  # its upper bits are the task's number
    counts = ranged.groupBy(task.alias("__task")).agg(F.min("__at").alias("__low"), F.count("*").alias("__n"))
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    counts = save(counts.select("__task", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__low")).alias("__add")), f"{label}-counts")
    placed = ranged.withColumn("__task", task).join(F.broadcast(counts), "__task")
    return placed.withColumn(name, F.col("__at") + F.col("__add")).select(*rows.columns, name)
