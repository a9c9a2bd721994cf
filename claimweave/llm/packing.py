"""Best-fit packing by exact-complement hashing.

Lengths of pieces are counted; the plan is made on the counts alone. Sequences begin with the longest piece left. The
index of available lengths is asked for a single, a pair or a triple that fills the gap exactly; such combinations are
used as far as the counts allow, and gaps without one are packed by best fit. Pieces then take their places by rank
within their length.
"""

from __future__ import annotations

import base64
import bisect
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save, text_of

#: Up to here the fast encoder's pattern classes are those of the reference library in every Unicode version.
_OTHER = re.compile("[԰-\U0010ffff]")


class Encoder:
    """Ids of whole texts, as tokenizers gives them for byte_bpe_50k.json without added special tokens.

    tokenizers handles text beyond Latin, Greek and Cyrillic; the same vocabulary and merges in tiktoken give the same
    ids four times faster elsewhere.
    """

    def __init__(self, slow_path: str, ranks_path: str, special: str = "<|endoftext|>", special_id: int = 50256) -> None:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={special: special_id})
        self.slow = Tokenizer.from_file(slow_path)
        self.special = {special}

    def __call__(self, text: str) -> list[int]:
        if not text.isascii() and _OTHER.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special=self.special, disallowed_special=())


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole ones of size, only the first may be shorter."""
    first = n % size
    return [(0, first)] * bool(first) + [(s, size) for s in range(first, n, size)]


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, each with the number of sequences that take it; every piece has a place in one.

    Filling gaps with triples and pairs spends short pieces that best fit may need later; so plans that fill with up to
    three, two and one pieces at a time are made, and the one with the fewest sequences is taken, never more than best
    fit alone needs. Depends on the counts per length only, so its cost doesn't grow with the corpus.
    """
    return min((_plan(counts, size, most) for most in (3, 2, 1)), key=lambda patterns: sum(n for _, n in patterns))


def _plan(counts: dict[int, int], size: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Each sequence begins with the longest piece left; its gap is filled exactly if it can be, else by best fit."""
    left = dict(counts)
    have = np.zeros(size + 1, bool)
    have[list(counts)] = True
    out: list[tuple[tuple[int, ...], int]] = []
    for length in sorted(counts, reverse=True):
        while left[length]:
            need, gap, pattern = {length: 1}, size - length, [length]
            while gap:
                free = [x for x in np.flatnonzero(have[: gap + 1]).tolist() if left[x] > need.get(x, 0)]
                if not free:
                    break
                for x in _filling(free, gap, left, need, most) or free[-1:]:
                    pattern.append(x)
                    need[x] = need.get(x, 0) + 1
                    gap -= x
            n = min(left[x] // m for x, m in need.items())
            for x, m in need.items():
                left[x] -= n * m
                have[x] = left[x] > 0
            out.append((tuple(pattern), n))
    return out


def _filling(free: list[int], gap: int, left: dict[int, int], need: dict[int, int], most: int) -> list[int] | None:
    """A single, a pair or a triple of free lengths (ascending) that fills gap, found by complement; the longest first."""
    if free[-1] == gap:
        return [gap]
    known = set(free)

    def pair(rest: int, top: int, taken: int) -> list[int] | None:
        """Two lengths up to top that sum to rest, each still free beside a piece of length taken."""
        spare = lambda x: left[x] - need.get(x, 0) - (x == taken)
        for x in reversed(free[: bisect.bisect_right(free, min(top, rest - 1))]):
            if 2 * x < rest:
                return None
            if rest - x in known and spare(x) > 0 and spare(rest - x) > (x == rest - x):
                return [x, rest - x]
        return None

    found = pair(gap, gap, 0) if most > 1 else None
    if not found and most > 2:
        for x in reversed(free):
            if 3 * x < gap:
                break
            if two := pair(gap - x, x, x):
                return [x, *two]
    return found


class _Places:
    """The places of all pieces of a length, by rank: runs of equal patterns, at most one per pattern and slot."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]) -> None:
        runs: dict[int, list[tuple[int, int, int]]] = {}
        used: dict[int, int] = {}
        base = 0
        for pattern, n in patterns:
            offset = 0
            for length in pattern:
                runs.setdefault(length, []).append((used.get(length, 0), base, offset))
                used[length] = used.get(length, 0) + n
                offset += length
            base += n
        self.runs = {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in runs.items()}

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for x in np.unique(length).tolist():
            at = np.flatnonzero(length == x)
            start, base, shift = self.runs[x]
            k = np.searchsorted(start, rank[at], "right") - 1
            sequence[at], offset[at] = base[k] + rank[at] - start[k], shift[k]
        return sequence, offset


def _pieces(encoder: tuple[str, str], size: int, end_id: int, with_ids: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("salt", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(*encoder)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.array(encode(text.as_py()) + [end_id], np.uint32)
                doc_id, whole = doc_id.as_py(), crc32(ids.data)
                for k, (start, length) in enumerate(cut(len(ids), size)):
                    own = ids[start : start + length].tobytes()
                    out.append((doc_id, k, start, length, crc32(own), whole, own if with_ids else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def _placed(places, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = places.value
        for batch in batches:
            sequence, offset = find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 2, encoder: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids (binary) if asked for.

    Every document is its ids and end_id; null counts as empty and is the end id alone. Longer ones are cut into pieces
    of size ids, of which the first may be shorter. Pieces of a sequence lie gapless from offset 0. Rows that repeat
    are packed each; a null doc_id is packed too. Other columns are ignored; an empty table gives an empty result.

    Only the counts per length (size numbers at most) reach the driver, and only the plan made from them, whose size
    doesn't depend on the corpus, goes back. Ranks within a length are counted per salt first, so a length that many
    pieces share is ranked by many tasks.
    """
    if encoder is None:
        from public_tokenizers import path

        encoder = path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken")
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    pieces = base.mapInArrow(_pieces(encoder, size, end_id, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, salt long, ids binary")
    pieces = save(pieces if with_ids else pieces.drop("ids"), "pieces")
    salts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(salts)))
    counts = save(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")), "piece-counts")
    patterns = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    places = spark.sparkContext.broadcast(_Places(patterns))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = pieces.withColumn("nth", F.row_number().over(order)).join(first, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("nth") - 1)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = ", ".join(f"{c} {t}" for c, t in ranked.select(*columns).dtypes)
    return ranked.select(*columns, "rank").mapInArrow(_placed(places, size), f"{schema}, sequence_id bigint, offset bigint")
