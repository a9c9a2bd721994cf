"""Repeated passages by line and sentence hashing.

Texts are split into sentences within lines. A unit is a sentence with enough words, or a run of neighbouring ones, over
line breaks too, that has enough words together. Units are normalised and hashed; digests are grouped over all documents,
the earliest occurrence stays, and every other one is reported with its place in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UNSPACED, save, text_of

#: A sentence ends at a line break, after . ! ? and the like before white space, or after a full-width mark and its closing quotes.
SENTENCE = re.compile(r"[^\n](?:[^\n.!?\u061f\u06d4\u0964\u0965。！？｡။។]+|[.!?\u061f\u06d4\u0964\u0965](?![ \t\r]))*(?:[.!?\u061f\u06d4\u0964\u0965]|[。！？｡။។]+[」』”’）》]*)?")
#: In scripts without spaces each character is a word.
WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
_SPACED, _UNSPACED = re.compile(r"\w+"), re.compile(f"[{UNSPACED}]")


def units(text: str, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, length, digest) of the units, by start; the digest covers the lower-cased words.

    From each sentence on, and up to each sentence, the shortest run of sentences with min_words words is a unit. So
    each sentence of a repeated passage of min_words words lies in a unit that lies in the passage, and is found there
    whatever stands around the passage.
    """
    words = WORD if not text.isascii() and _UNSPACED.search(text) else _SPACED
    starts, ends, norms, before = [], [], [], [0]
    for m in SENTENCE.finditer(text):
        own = m[0]
        found = words.findall(own.lower())
        if found:
            starts.append(m.start() + len(own) - len(own.lstrip()))
            ends.append(m.start() + len(own.rstrip()))
            norms.append(" ".join(found))
            before.append(before[-1] + len(found))
    i = last = 0
    for j in range(len(norms)):
        if before[j + 1] < min_words:
            continue
        while before[j + 1] - before[i + 1] >= min_words:
            i += 1
        for k in range(min(i, last), i + 1):  # the run up to j, and those from earlier sentences on that end here first
            yield starts[k], ends[j] - starts[k], xxhash.xxh3_128_digest(" ".join(norms[k : j + 1]))
        last = max(last, i + 1)


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8) -> DataFrame:
    """One row per removed unit: doc_id, start, length (code points), keep_doc_id, keep_start, copies.

    Units of equal words (lower case, punctuation and white space apart) with at least min_words words are copies; the
    earliest by doc_id, then start, stays. Units of several sentences overlap: what goes is all that rows cover, and of
    each sentence that goes a copy stays. Null and empty texts have no units; rows with a null doc_id rank last, of rows
    that repeat a doc_id one ranks wholly before the next, and of whole copies only one copy of each unit is kept. Other
    columns are ignored; an empty table gives an empty result.

    Digests are counted with combining aggregates; rows meet them in a sort-merge join, whose skewed partitions Spark
    splits, so a line that a third of all documents share doesn't land in one task.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(d.as_py(), r.as_py(), *u) for d, r, t in zip(*batch.columns) for u in units(t.as_py(), min_words)]
            for k in range(0, max(1, len(out)), 50_000):
                part = out[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], f.type) for c, f in enumerate(schema)], schema=schema)

    # Rows that repeat a doc_id are told apart by a number, so that of whole copies one stays.
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_of(text_col).alias("text"))
    # Written once: both sides below read the same units and row numbers, even if a task is run again.
    found = save(base.mapInArrow(run, "doc_id long, row long, start int, length int, digest binary"), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "start")
    # Written too: Spark splits a skewed join only if no aggregate stands between its shuffle and the join.
    shared = save(found.groupBy("digest").agg(F.min(rank).alias("keep"), F.count("*").alias("copies")).filter("copies > 1"), "shared")
    copies = found.join(shared.hint("merge"), "digest")
    first = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("start") == F.col("keep.start")) & (F.col("row") == F.col("keep.row"))
    return copies.filter(~first).select("doc_id", "start", "length", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"), "copies")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the removed units cut out of text_col and their spans, which may overlap, in removed (array of start, length).

    The doc_id must tell documents apart; rows with a null doc_id keep their text.
    """
    spans = repeated_units(docs, id_col, text_col, **options).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("removed")).withColumnRenamed("doc_id", "__cut_id")
    joined = docs.join(spans, docs[id_col] == F.col("__cut_id"), "left").drop("__cut_id")
    cut = F.aggregate(
        F.coalesce("removed", F.array().cast("array<struct<start:int,length:int>>")),
        F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(F.concat(acc["text"], F.substring(text_of(text_col), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))).alias("text"), F.greatest(acc["at"], s["start"] + s["length"]).alias("at")),
        lambda acc: F.concat(acc["text"], F.substring(text_of(text_col), acc["at"] + 1, F.lit(2**31 - 1) - acc["at"])),
    )
    return joined.withColumn(text_col, F.when(F.col("removed").isNull(), F.col(text_col)).otherwise(cut))
