"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by their leading bytes; every group that still holds more than one document is split by its next
bytes, until each group is a single document or its documents have ended. Digits widen geometrically, so a document of
n bytes takes O(log n) rounds, and only documents that still share a prefix are carried to the next round. Groups are
compared by the bytes themselves; no digest decides equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import is_empty, save, squeezed, text_of

WHOLE = 2**31 - 1


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_width: int = 64, growth: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical without white space; null counts as empty, so null, empty and blank texts form one
    group. Of a group, the row with the longest original text stays, then the smallest doc_id (a null doc_id comes
    last); of rows that repeat both, exactly one has kept = true. Other columns are ignored, whatever their names. An
    empty table gives an empty result.

    A group may hold a third of all rows: sizes and winners come from aggregates that combine before the shuffle, and
    rows meet them in a sort-merge join, whose skewed partitions Spark splits.
    """
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(text).cast("long").alias("n_chars"),
        F.sha2(squeezed(text), 256).alias("text_sha256"),
        squeezed(text).cast("binary").alias("rest"),
        F.lit(0).cast("long").alias("gid"),
    )
    done, width = [], first_width
    while True:
        keyed = rows.withColumn("digit", F.substring("rest", 1, width)).withColumn("rest", F.substring("rest", width + 1, WHOLE))
        rank = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"))
        shared = keyed.groupBy("gid", "digit").agg(F.count("*").alias("group_size"), F.min(rank).alias("best")).filter("group_size > 1")
        # Written before it is joined: the new group numbers must not change if a task is run again.
        shared = save(shared.withColumn("next_gid", F.monotonically_increasing_id()), "radix-groups")
        ended = F.length("digit") < width
        split = save(
            keyed.join(shared.hint("merge"), ["gid", "digit"], "left").select(
                "doc_id", "n_chars", "text_sha256", "next_gid", "group_size", "best",
                F.when(F.col("next_gid").isNotNull() & ~ended, F.col("rest")).alias("rest"),
            ),
            "radix-rows",
        )
        done.append(split.filter("rest is null"))
        rows = split.filter("rest is not null").select("doc_id", "n_chars", "text_sha256", "rest", F.col("next_gid").alias("gid"))
        if is_empty(rows):
            break
        width *= growth
    out = []
    for part in done:
        alone = part.filter("group_size is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
        many = part.filter("group_size is not null").withColumn("first", (-F.col("n_chars") == F.col("best.n")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id")))
        again = Window.partitionBy("next_gid").orderBy("doc_id")
        first = many.filter("first").withColumn("kept", F.row_number().over(again) == 1)
        rest = many.filter("not first").withColumn("kept", F.lit(False))
        out += [alone] + [x.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", "kept", "text_sha256") for x in (first, rest)]
    result = out[0]
    for x in out[1:]:
        result = result.union(x)
    return result


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns; of repeated rows one stays.

    A row with a null doc_id stays if its text is kept for a null doc_id.
    """
    found = exact_dedup(docs, id_col, text_col)
    keep = found.filter("kept").select(F.col("doc_id").alias("__keep_id"), F.col("text_sha256").alias("__keep_sha"))
    sha = F.sha2(squeezed(text_of(text_col)), 256)
    kept = docs.join(keep, docs[id_col].eqNullSafe(F.col("__keep_id")) & (sha == F.col("__keep_sha")), "left_semi")
    # Only a doc_id that occurs again with the same text needs a second look; mostly there is none.
    again = save(found.groupBy("doc_id", "text_sha256").count().filter("count > 1").select(F.col("doc_id").alias("__again_id"), F.col("text_sha256").alias("__again_sha")), "repeated-rows")
    if is_empty(again):
        return kept
    on = docs[id_col].eqNullSafe(F.col("__again_id")) & (sha == F.col("__again_sha"))
    twice = kept.join(again, on, "left_semi")
    order = Window.partitionBy(F.col(id_col), sha).orderBy(F.length(text_of(text_col)).desc(), text_of(text_col))
    twice = twice.withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").drop("__nth")
    return kept.join(again, on, "left_anti").unionByName(twice)


#: DuckDB SQL of the query over documents.
ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
