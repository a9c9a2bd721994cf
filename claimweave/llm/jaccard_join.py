"""N-gram Jaccard self-join with Bayesian candidate pruning.

Exact copies collapse to one class first. MinHash values of the classes are banded; classes that share a band are
compared value by value, and a pair is dropped as soon as the posterior probability that its similarity reaches the
threshold falls below a tolerance. What survives is verified on the full shingle sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_hot, save, sifted, text_of

WORD = re.compile(r"\w+")
#: MinHash values, and how many of them make a band: a pair of similarity 0.8 shares no band with probability 3e-6.
HASHES, BAND = 96, 4
#: Posterior probability of reaching the threshold below which a pair is dropped.
TOLERANCE = 1e-6
#: Values compared between two looks at the posterior.
STEP = 16
#: Members of a bucket or component that one unit of work takes from each of two blocks, and bytes of their hashes.
BLOCK, BYTES = 256, 1 << 24
_MULT = (np.random.default_rng(20240229).integers(1, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(words: list[str], hashes: dict, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a shorter text has one n-gram of all its words."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    out = np.full(n, min(len(words), size), np.uint64)
    for k in range(min(size, len(words))):
        out = (out ^ (h[k : k + n] * _ODD[k % len(_ODD)])) * _ODD[-1]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.empty(HASHES, np.uint32)
    for k in range(HASHES):
        out[k] = (shingles * _MULT[k]).min() >> np.uint64(32)
    return out


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n compared values, the fewest matches at which P(similarity >= threshold | matches) >= tolerance.

    The prior is uniform, so the posterior after m matches of n is Beta(m + 1, n - m + 1), whose upper tail is a
    binomial sum.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out[n] = m
    return out


def surviving(a: np.ndarray, b: np.ndarray, same: bool, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of signatures that no look at the posterior has dropped; same: b is a, take each pair once."""
    i, j = np.triu_indices(len(a), 1) if same else (x.ravel() for x in np.indices((len(a), len(b))))
    found = np.zeros(len(i), np.int32)
    for n, m in least.items():
        found += (a[i, n - STEP : n] == b[j, n - STEP : n]).sum(1, dtype=np.int32)
        keep = found >= m
        i, j, found = i[keep], j[keep], found[keep]
        if not len(i):
            break
    return i, j


def common_counts(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a[i] and b[j]: pairwise for a few pairs, by blocks of an incidence matrix for many."""
    if len(i) <= 4 * (len(a) + len(b)):
        return np.fromiter((np.intersect1d(a[x], b[y], assume_unique=True).size for x, y in zip(i, j)), np.int64, len(i))
    sets = a + b
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[column] > 1
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    total = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        x, y = np.searchsorted(column, [low, low + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[x:y], column[x:y] - low] = 1
        total += m[: len(a)] @ m[len(a) :].T
    return total[i, j].astype(np.int64)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """For each of n nodes the smallest node that the links reach."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(i.tolist(), j.tolist()):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one unit after another; the input is sorted by unit, block and key."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and rows[-1]["unit"] != row["unit"]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _sides(rows: list[dict]) -> tuple[list[int], list[int], bool]:
    """Positions of the two blocks of a unit; one block is compared with itself."""
    first = [k for k, r in enumerate(rows) if r["block"] == rows[0]["unit"]["i"]]
    if rows[0]["unit"]["i"] == rows[0]["unit"]["j"]:
        return first, first, True
    return first, [k for k, r in enumerate(rows) if r["block"] != rows[0]["unit"]["i"]], False


def _key(words: list[str], text: str) -> bytes:
    """The same for texts of the same words; a text without words goes by its characters but white space."""
    return xxhash.xxh3_128_digest(" ".join(words) or "\n" + "".join(text.split()))


def _features(size: int):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            keys, sigs = [], []
            for text in batch.column(1):
                words = WORD.findall(text.as_py().lower())
                keys.append(_key(words, text.as_py()))
                sigs.append(signature(shingle_hashes(words, hashes, size)).tobytes() if words else None)
            names = [*batch.schema.names[:1], *batch.schema.names[2:], "key", "sig"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=names)

    return run


def _shingles(size: int):
    schema = pa.schema([("key", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            keys, sets = [], []
            for text in batch.column(0):
                words = WORD.findall(text.as_py().lower())
                keys.append(_key(words, text.as_py()))
                sets.append(shingle_hashes(words, hashes, size).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], schema=schema)

    return run


def _candidates(threshold: float, tolerance: float):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches(threshold, tolerance)
        a, b = [], []
        for rows in _units(batches):
            x, y, same = _sides(rows)
            sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint32).reshape(len(rows), HASHES)
            i, j = surviving(sig[x], sig[y], same, least)
            if len(i):
                up = roots(len(rows), np.asarray(x)[i], np.asarray(y)[j])
                linked = [k for k, r in enumerate(up) if r != k]
                a += [rows[k]["key"] for k in linked]
                b += [rows[up[k]]["key"] for k in linked]
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=schema)
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=schema)

    return run


def _verified(threshold: float, tolerance: float):
    schema = pa.schema([("key", pa.binary()), ("root", pa.binary()), ("n_links", pa.int64()), ("n_similar", pa.int64())])

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches(threshold, tolerance)
        out: list[tuple] = []
        for rows in _units(batches):
            x, y, same = _sides(rows)
            sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint32).reshape(len(rows), HASHES)
            sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
            i, j = surviving(sig[x], sig[y], same, least)
            if not len(i):
                continue
            shared = common_counts([sets[k] for k in x], [sets[k] for k in y], i, j)
            i, j = np.asarray(x)[i], np.asarray(y)[j]
            sizes = np.array([len(s) for s in sets])
            real = shared >= threshold * (sizes[i] + sizes[j] - shared) - 1e-9
            i, j = i[real], j[real]
            copies = np.array([r["copies"] for r in rows])
            links = np.bincount(i, minlength=len(rows)) + np.bincount(j, minlength=len(rows))
            similar = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
            up = roots(len(rows), i, j)
            out += [(rows[k]["key"], rows[up[k]]["key"], int(links[k]), int(similar[k])) for k in np.flatnonzero(links).tolist()]
            if len(out) > 20_000:
                yield table(out)
                out = []
        yield table(out)

    return run


def _dealt(members: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Deal the members of each group into blocks of about BLOCK members and BYTES, and every two blocks into a unit of work."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK), F.ceil(F.col("volume") / BYTES)).cast("int")
    rows = members.withColumn("block", F.pmod(F.xxhash64("key", F.lit(7)), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    rows = rows.select(*columns, "block", *group, other.alias("other"))
    unit = F.struct(*group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = rows.select(unit.alias("unit"), "block", *columns)
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "unit").sortWithinPartitions("unit", "block", "key")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, n_similar.

    Words are the lower-cased runs of letters, digits and underscores; two texts are linked if the sets of their word
    n-grams have a Jaccard similarity of at least threshold. n_links counts the linked different texts, n_similar the
    other documents that are linked, copies included; class_id is the smallest doc_id of the connected component.
    Texts with the same words are copies; a text with fewer than size words has one n-gram of all its words; texts without
    words are copies if they are equal but for white space, null counts as empty, and have no links to other texts. A row with a null doc_id gets a null
    class_id and no links, and counts for nobody. Other columns are ignored. An empty table gives an empty result.

    A bucket or component of any size is dealt into blocks of BLOCK members, and two blocks at a time meet in a task,
    which returns per-text counts and a spanning forest, never the pairs.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    result = _joined(base.filter("doc_id is not null"), "doc_id long", size, threshold, tolerance)
    nameless = base.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_similar"))
    return result.union(nameless)


def _joined(named: DataFrame, columns: str, size: int = 5, threshold: float = 0.8, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of jaccard_join for named, which has doc_id of any type, none null, text, and others; columns are those and their types but text."""
    others = [c for c in named.columns if c not in ("doc_id", "text")]
    marked = save(named.select("doc_id", "text", *others).mapInArrow(_features(size), f"{columns}, key binary, sig binary"), "minhash")
    classes = save(marked.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig")), "classes")

    band = F.transform(
        F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)),
        lambda k: F.struct(k.alias("band"), F.xxhash64(F.substring(F.col("sig"), k * (4 * BAND) + 1, F.lit(4 * BAND)), k).alias("hash")),
    )
    banded = classes.filter("sig is not null").select("key", F.inline(band))
    token = F.xxhash64("key").cast("decimal(38,0)")
    buckets = banded.groupBy("band", "hash").agg(F.count("*").alias("members"), F.sum(token).alias("sum_a"), F.sum(F.xxhash64("key", F.lit(1)).cast("decimal(38,0)")).alias("sum_b")).filter("members > 1")
    # Buckets of the same members are one: copies of a document pair meet once, not in every band.
    buckets = buckets.groupBy("members", "sum_a", "sum_b").agg(F.min(F.struct("band", "hash")).alias("first")).select("members", "first.band", "first.hash")
    buckets = save(buckets.withColumn("bucket", F.struct("band", "hash")).withColumn("n", F.col("members")), "buckets")
    met = join_hot(banded.withColumn("bucket", F.struct("band", "hash")).select("bucket", "key"), buckets.select("bucket", "members", "n"), "bucket")
    members = met.join(classes.select("key", "sig"), "key").withColumn("volume", F.lit(0))
    near = _dealt(members, ["bucket"], ["key", "sig"]).mapInArrow(_candidates(threshold, tolerance), "a binary, b binary")
    groups = components(near, "candidates")

    suspects = save(groups.join(classes, groups["node"] == classes["key"]).select("key", "sig", "copies", "rep", "root"), "members")
    # Shingles are made where the texts lie; what was read for another's sake finds no suspect of its key.
    near = sifted(named.select("doc_id", "text"), suspects.select(F.col("rep").alias("doc_id")), ["doc_id"]).filter("__maybe")
    sets = near.select("text").mapInArrow(_shingles(size), "key binary, shingles binary")
    sets = sets.groupBy("key").agg(F.first("shingles").alias("shingles"))
    full = save(suspects.join(sets, "key"), "sets")
    sizes = save(full.groupBy("root").agg(F.count("*").alias("members"), F.sum(F.octet_length("shingles")).alias("volume"), F.count("*").alias("n")), "sizes")
    full = join_hot(full, sizes, "root")
    found = save(_dealt(full, ["root"], ["key", "sig", "copies", "shingles"]).mapInArrow(_verified(threshold, tolerance), "key binary, root binary, n_links long, n_similar long"), "links")

    linked = found.groupBy("key").agg(F.sum("n_links").alias("n_links"), F.sum("n_similar").alias("n_similar"))
    star = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")), "components")
    reps = classes.select("key", "rep", "copies").join(star.withColumnRenamed("node", "key"), "key", "left").join(linked, "key", "left").withColumn("root", F.coalesce("root", "key"))
    reps = save(reps, "classes")
    low = save(reps.groupBy("root").agg(F.min("rep").alias("class_id"), F.count("*").alias("n")), "lowest")
    reps = join_hot(reps, low, "root").select("key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.coalesce("n_similar", F.lit(0)) + F.col("copies") - 1).alias("n_similar"), F.col("copies").alias("n"))
    # A key stands for its exact copies, which may be most rows.
    return join_hot(marked.select("doc_id", "key", *others), save(reps, "keys"), "key").select("doc_id", "class_id", "n_links", "n_similar", *others)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stand for their class, with all their columns.

    The row with the smallest doc_id of a class stays, with the rows of its doc_id in the class; rows with a null doc_id come
    last, and one of them stays where a class has no others. Each row is judged by its own text, which goes by its SHA-256.
    Texts stay where they are: what goes is a few rows, and only rows that may be among them are shuffled.
    """
    whole = docs.withColumn("__id", F.col(id_col).cast("long")).withColumn("__sha", F.unhex(F.sha2(text_of(text_col), 256)))
    classes = save(_joined(whole.select(F.col("__sha").alias("doc_id"), text_of(text_col).alias("text"), "__id"), "doc_id binary, __id long", **options), "classes")
    classes = classes.select("class_id", F.col("doc_id").alias("__sha"), "__id")
    best = classes.groupBy("class_id").agg(F.min(F.struct(F.col("__id").isNull().alias("nameless"), "__id", "__sha")).alias("best"), F.count("*").alias("n"))
    best = save(best, "best")
    gone = join_hot(classes.filter("__id is not null"), best.filter("n > 1"), "class_id").filter(F.col("__id") != F.col("best.__id"))
    gone = save(gone.select("__id", "__sha").distinct(), "gone")
    named = sifted(whole.filter("__id is not null"), gone, ["__id", "__sha"])
    stay = named.filter("not __maybe").unionByName(named.filter("__maybe").join(gone, ["__id", "__sha"], "left_anti"))
    alone = best.filter("best.nameless").select(F.col("best.__sha").alias("__sha"))
    nameless = whole.filter("__id is null").join(alone, "__sha", "left_semi").dropDuplicates(["__sha"])
    return stay.select(*docs.columns).unionByName(nameless.select(*docs.columns))
