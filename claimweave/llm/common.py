"""Shared plumbing of the training-data operators: text normal forms, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.work import is_empty, numbered, save

__all__ = ["UNSPACED", "components", "is_empty", "join_hot", "numbered", "save", "sifted", "squeezed", "text_of"]

#: Characters deleted or split on as white space: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
#: Inside of a regex class: characters of scripts that put no spaces between words (Han, kana, Thai, Lao, Burmese, Khmer).
UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"


def text_of(column: str | Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def squeezed(text: Column) -> Column:
    """text without any white space."""
    return F.translate(text, WHITE, "")


#: A key with more than this share of all rows is hot; there are at most so many such keys.
HOT = 10_000


def join_hot(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """rows.join(values, key), where a key may have most of the rows; values has a row per key and its rows' number, n.

    Keys with more than 1 / HOT of all rows number HOT at most, so their values are broadcast; all other keys are joined
    by shuffling, and none of them outweighs the rest.
    """
    total = values.agg(F.sum("n")).first()[0] or 0
    hot = values.filter(F.col("n") > total / HOT)
    met = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(values.filter(F.col("n") <= total / HOT), key)
    return met.unionByName(rest).drop("n")


#: Bits of one bitmap of Spark's bitmap_construct_agg, for each wanted key, and the most bitmaps: 32 MB in all.
_BITMAP, _BITS_A_KEY, _BITMAPS = 32_768, 64, 8_192


def sifted(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """rows with __maybe: false only if no row of wanted has these keys; a row of other keys is rarely true.

    A bit for each hash of wanted's keys is broadcast, so rows don't move, and only what is left is worth a shuffle.
    """
    bitmaps = min(_BITMAPS, 1 + wanted.count() * _BITS_A_KEY // _BITMAP)
    digest = F.xxhash64(*keys)
    own, bit = F.pmod(digest, F.lit(bitmaps)), F.shiftrightunsigned(digest, 49)
    bits = save(wanted.groupBy(own.alias("__own")).agg(F.bitmap_construct_agg(bit).alias("__bits")), "bits")
    met = rows.withColumn("__own", own).withColumn("__bit", bit.cast("int")).join(F.broadcast(bits), "__own", "left")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright("__bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    return met.withColumn("__maybe", F.coalesce(F.getbit(byte, F.col("__bit") % 8) == 1, F.lit(False))).select(*rows.columns, "__maybe")


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the smallest node of its connected component.

    Each round links a node's whole neighbourhood to the smallest node in it, first upward and then downward, so
    that a component becomes a star in about log(size) rounds; aggregates combine before they are shuffled, and a node
    with very many neighbours is not shuffled with them.
    """
    links = save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"), F.count_if(F.col("b") > F.col("a")).alias("n"))
        large = join_hot(both.filter("b > a"), save(low, label), "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = save(large, label)
        least = save(large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")), label)
        small = join_hot(large, least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = save(small.union(least.select("a", F.col("low").alias("b"))).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
        same = _digest(after) == _digest(links)
        links = after
        if same:
            break
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
