"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes ends a piece wherever its low k bits are all set, so pieces depend on their own bytes
alone, and an edit changes the pieces that it touches. Each piece gives a letter; k is the least number with which a text
has at most 64 pieces. A fingerprint is block:letters:letters, for the block size 2 ** k and for twice that size, where
pieces join in pairs or so. Two fingerprints are compared by edit distance over letters of one block size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, text_of

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Bytes of the rolling hash; most pieces of a text; letters in a row that two fingerprints must share.
WINDOW, PIECES, RUN = 7, 64, 7
#: Bytes that are hashed at a time, so memory beside the text itself is bounded.
SLICE = 1 << 20
FACTOR, MIX = np.uint32(0x01000193), np.uint32(0x85EBCA6B)


def _rolled(data: bytes, low: int, high: int) -> np.ndarray:
    """Hash of the WINDOW bytes that end at each of the places low to high; before the text there are zeros."""
    begin = low - WINDOW + 1
    x = np.frombuffer(bytes(max(0, -begin)) + data[max(0, begin) : high], np.uint8).astype(np.uint32)
    h = x[: high - low].copy()
    for k in range(1, WINDOW):
        h *= FACTOR
        h += x[k : k + high - low]
    h ^= h >> np.uint32(15)
    h *= MIX
    h ^= h >> np.uint32(13)
    return h


def _set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Whether the low k bits of each hash are all set; a hash has 32."""
    return hashes & np.uint32((1 << k) - 1) == np.uint32((1 << k) - 1) if k <= 32 else np.zeros(len(hashes), bool)


def _ends(data: bytes, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(the least number of bits from k on with fewer than PIECES ends, places of the ends, their hashes)"""
    places, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint32)
    for low in range(0, len(data), SLICE):
        h = _rolled(data, low, min(len(data), low + SLICE))
        hit = np.flatnonzero(_set(h, k))
        places, hashes = np.concatenate([places, hit + low]), np.concatenate([hashes, h[hit]])
        while len(places) >= PIECES:  # a larger k has fewer ends, so what goes here is never wanted again
            k += 1
            stay = _set(hashes, k)
            places, hashes = places[stay], hashes[stay]
    return k, places, hashes


def _letters(data: bytes, ends: list[int]) -> str:
    at, out = 0, []
    for end in [*ends, len(data)]:
        if end > at:
            out.append(LETTERS[zlib.crc32(data[at:end]) & 63])
        at = end
    return "".join(out)


def fingerprint(data: bytes) -> str:
    """block:letters:letters of a text in UTF-8; an empty one has no letters."""
    guess = max(0, (len(data) // PIECES).bit_length() - 3)
    k, places, hashes = _ends(data, guess)
    if k == guess > 0:  # a smaller k may do
        k, places, hashes = _ends(data, 0)
    return f"{1 << k}:{_letters(data, (places + 1).tolist())}:{_letters(data, (places[_set(hashes, k + 1)] + 1).tolist())}"


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: how alike two fingerprints are. 1 if equal, 0 if no block size is common to both.

    For a common block size it is 1 - distance / letters of the longer one, the higher of two such values; letters that
    share no run of RUN (of all letters, where one side has fewer) count as unlike, as even random ones are a little alike.
    """
    part = lambda x, k: F.split(x, ":")[k]
    block = lambda x: part(x, 0).cast("long")

    def runs(s: Column, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substr(s, i, n))

    def near(x: Column, y: Column) -> Column:
        run = F.least(F.lit(RUN), F.length(x), F.length(y))
        met = F.when(run > 0, F.arrays_overlap(runs(x, run), runs(y, run))).otherwise(False)
        return F.when(met, 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))).otherwise(0.0)

    return (
        F.when(a == b, 1.0)
        .when(block(a) == block(b), F.greatest(near(part(a, 1), part(b, 1)), near(part(a, 2), part(b, 2))))
        .when(2 * block(a) == block(b), near(part(a, 2), part(b, 1)))
        .when(block(a) == 2 * block(b), near(part(a, 1), part(b, 2)))
        .otherwise(0.0)
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_chars, fingerprint. Null texts count as empty; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([fingerprint(t.encode()) for t in part.column(2).to_pylist()], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


_PAIRS = pa.schema([("task", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("next_fingerprint", pa.string()), ("first", pa.bool_()), ("text", pa.string())])
_PAIRS_SQL = "task int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, first boolean, text string"


def _pair(task: int, doc_id: int | None, text: str, mark: str, after: str, after_mark: str, share: int) -> tuple:
    """A row and the one behind it: the edited text has the next one's beginning in place of its own last n // share code points."""
    cut = len(text) // share
    edited = (text[: len(text) - cut] + after[:cut]).encode()
    return task, doc_id, len(text), hashlib.sha256(edited).hexdigest(), mark, fingerprint(edited) if cut else mark, after_mark


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PAIRS, strict=True)], schema=_PAIRS)


def _neighbours(share: int) -> callable:
    """Rows (task, doc_id, text) in order to pairs; the last one of a task has no next and keeps its text, as the first one does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                out = []
                for task, doc_id, text in zip(*(c.to_pylist() for c in batch.slice(low, 256).columns), strict=True):
                    mark = fingerprint(text.encode())
                    if held:
                        out.append((*_pair(*held, text, mark, share), first, held[2] if first else None))
                        first = False
                    held = (task, doc_id, text, mark)
                if out:
                    yield _batch(out)
        if held:
            yield _batch([(held[0], held[1], len(held[2]), None, held[3], None, None, first, held[2])])

    return run


def _joined(share: int) -> callable:
    """The pairs across tasks: rows (task, doc_id, text, mark, next text, its mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _batch([(*_pair(*row, share), False, None)])

    return run


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4) -> DataFrame:
    """Every row of docs, its edited text and the row behind it in the order of id_col; after the last comes the first.

    One row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited
    text has the next row's first n_chars // share code points (all, if it has fewer) in place of its own last ones.

    Null texts count as empty; null ids come first; rows of one id are ordered by a hash of their text, then by the text,
    and rows that repeat are documents of their own. A single row is its own next. Other columns are ignored; an empty
    table gives an empty result. Texts are taken whole; beside two of them a task holds a slice of hashes.

    Texts are moved once, dealt to tasks by ranges of the order. Only the first and last text of a task are written down,
    for the pairs that two tasks share.
    """
    text = text_of(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    ordered = base.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select(F.spark_partition_id().alias("task"), "doc_id", "text")
    near = {"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("next_fingerprint"))}
    rows = save(ordered.mapInArrow(_neighbours(share), _PAIRS_SQL).withColumns(near).drop("next_fingerprint"), "fingerprints")

    firsts = rows.filter("first").select(F.col("task").alias("next_task"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mark"))
    tasks = rows.filter("first").agg(F.array_sort(F.collect_list("task")).alias("tasks"))  # a number per task
    follows = tasks.select(F.posexplode("tasks").alias("k", "task"), "tasks").select("task", F.get("tasks", (F.col("k") + 1) % F.size("tasks")).alias("next_task"))
    ends = rows.filter("edited_fingerprint is null").join(follows, "task").join(firsts, "next_task").select("task", "doc_id", "text", F.col("fingerprint").alias("mark"), "next_text", "next_mark")
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    across = ends.mapInArrow(_joined(share), _PAIRS_SQL).withColumns(near)
    return rows.filter("edited_fingerprint is not null").select(*columns).union(across.select(*columns))
