"""Trie of conversation prefixes, screened by a count-min sketch.

A prefix of d turns goes by a digest that chains the digests of its turns. Every prefix counts in one cell of each row of
a sketch; as a cell never counts too low, a prefix with a cell that counts one occurs in one conversation alone, and so do
all that continue it. Such tails are nodes as they stand: they are emitted where they are read. Only prefixes whose every
cell was met again are shuffled and grouped by their digests, the few that collide in the sketch among them.

Sums over subtrees need no walk: a node's share is put down at its smallest member, in whose own prefixes its ancestors
are, and is added up along that conversation, then by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_hot, save

#: Cells of a row of the sketch: eight for a prefix, up to this many. What is broadcast has a bit for a cell, 32 MB at most;
#: with more prefixes than that fits, more of them are grouped exactly.
CELLS = 2**27
#: Bits of a page of the sketch, as bitmap_construct_agg makes them.
PAGE = 32_768
ROOT = bytes(16)
NOTHING = hashlib.sha256(b"").hexdigest()
#: The first turns that a conversation can borrow.
LENT = 5


def turns_of(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), digest, chars of each row: in the order of turn (null first), then role, then text; null role or text is empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    own = rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return own.select("conv_id", pos.alias("pos"), digest.alias("digest"), F.length("text").cast("long").alias("chars"))


def steps_of(turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest, chars of turns_of, with a row of depth 0 for each conversation."""
    return turns.select("conv_id", F.col("pos").alias("depth"), "digest", "chars").union(turns.filter("pos = 1").select("conv_id", F.lit(0), F.lit(None).cast("binary"), F.lit(0).cast("long")))


def rebuilt(turns: DataFrame, group: int = 100) -> DataFrame:
    """Steps of conversations that begin with turns of their group's first one.

    Conversation c has the first h turns of c - c % group (all if they are fewer, none if there is no such conversation;
    % as in SQL, with the sign of c), then its own after its first h; h is the CRC-32 of the decimal c modulo LENT + 1. A
    null conv_id is one more conversation, which borrows nothing.
    """
    turns = save(turns, "turns")
    group_of = F.col("conv_id") - F.col("conv_id") % group
    ids = turns.filter("pos = 1").select("conv_id", group_of.alias("base"), F.coalesce(F.crc32(F.col("conv_id").cast("string")) % (LENT + 1), F.lit(0)).cast("int").alias("h"))
    head = F.array_sort(F.collect_list(F.struct("pos", "digest", "chars")))  # LENT at most
    heads = turns.filter((F.col("conv_id") == group_of) & (F.col("pos") <= LENT)).groupBy(F.col("conv_id").alias("base")).agg(head.alias("head"))
    none = F.array().cast("array<struct<pos:int,digest:binary,chars:bigint>>")
    plan = save(ids.join(heads, "base", "left").select("conv_id", "h", F.slice(F.coalesce("head", none), F.lit(1), F.col("h")).alias("lent")), "plan")
    begin = F.array(F.struct(F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars")))
    first = plan.select("conv_id", F.explode(F.concat(begin, "lent")).alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.digest", "t.chars")
    skip = plan.select(F.col("conv_id").alias("__id"), "h", F.size("lent").alias("k"))
    own = turns.join(skip, F.col("conv_id").eqNullSafe(F.col("__id"))).filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "digest", "chars")
    return first.unionByName(own)


_PREFIXES = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("chars", pa.int64()), ("last", pa.bool_())])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps in the order of conversation and depth to prefixes; a row waits for the next one, which tells if it is the last of its conversation."""
    held, node = ([], [], [], [], []), ROOT
    for batch in batches:
        ids, depths, digests, chars = (c.to_pylist() for c in batch.columns)
        nodes, parents = [], []
        for depth, digest in zip(depths, digests, strict=True):
            parents.append(node if depth else None)
            node = hashlib.sha256(node + digest).digest()[:16] if depth else ROOT
            nodes.append(node)
        rows = [a + b for a, b in zip(held, (ids, depths, nodes, parents, chars), strict=True)]
        held = tuple(c[-1:] for c in rows)
        if len(rows[0]) > 1:
            yield pa.RecordBatch.from_arrays([*(pa.array(c[:-1], f.type) for c, f in zip(rows, _PREFIXES, strict=False)), pa.array([d == 0 for d in rows[1][1:]])], schema=_PREFIXES)
    if held[0]:
        yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(held, _PREFIXES, strict=False)), pa.array([True])], schema=_PREFIXES)


def prefixes(steps: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent (digests of the prefix and of the one before), chars of its last turn, last: whether the conversation ends there."""
    ordered = steps.select("conv_id", F.col("depth").cast("int").alias("depth"), "digest", "chars").repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return ordered.mapInArrow(_chained, "conv_id long, depth int, node binary, parent binary, chars long, last boolean")


def _cells(node: str, width: int) -> list[Column]:
    return [F.xxhash64(node, F.lit(k)).bitwiseAND(F.lit(width - 1)) + k * width for k in range(2)]


def sketch(rows: DataFrame, width: int) -> np.ndarray:
    """A bit for each cell of two rows of width cells: whether it counts more than one of rows. Cells are counted and packed by Spark."""
    cell = rows.select(F.explode(F.array(*[c + 1 for c in _cells("node", width)])).alias("cell"))  # pages begin behind 0
    met = cell.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    pages = met.groupBy(F.bitmap_bucket_number("cell").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    bits = np.zeros((-(-2 * width // PAGE), PAGE // 8), np.uint8)
    for page, packed in pages.collect():  # 2 * width bits at most
        bits[page - 1] = np.frombuffer(packed, np.uint8)
    return bits.reshape(-1)


def _screened(bits) -> callable:
    """Adds to rows with the cells of node and parent whether the sketch proves either to occur once."""

    def alone(columns) -> np.ndarray:
        out = np.zeros(len(columns[0]), bool)
        for c in columns:
            cell = c.to_numpy(zero_copy_only=False)
            out |= (bits.value[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 0
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth = batch.column(1).to_numpy()
            # The root is shared by all, and so is counted exactly.
            own, before = alone(batch.columns[6:8]) & (depth > 0), alone(batch.columns[8:10]) & (depth > 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(own | before), pa.array(before)], names=[*_PREFIXES.names, "tail", "inner"])

    return run


def _ends(rows: DataFrame) -> DataFrame:
    """node, ends_sha256 of rows (node, conv_id): the digest of the ascending ids, joined by commas.

    Ids are joined in pieces of 4,096 neighbouring numbers; the pieces of a node stream through the hash in their order,
    so no task holds all members of a node.
    """
    piece = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("conv_id").isNull().alias("no_id"), "conv_id"))), lambda s: F.coalesce(s["conv_id"].cast("string"), F.lit(""))), ",")
    pieces = rows.groupBy("node", F.shiftright("conv_id", 12).alias("range")).agg(piece.alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            nodes, sums = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != at:
                    if at is not None:
                        nodes.append(at)
                        sums.append(state.hexdigest())
                    at, state = node, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sums, pa.string())], names=["node", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    ordered = pieces.repartition("node").sortWithinPartitions("node", F.asc_nulls_last("range")).select("node", "piece")
    return ordered.mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(steps: DataFrame, cells: int = CELLS) -> DataFrame:
    """A row per node of the trie of steps (conv_id, depth, digest, chars; depth 0 for each conversation).

    conv_id: its smallest member, of which depth turns are its prefix; depth; parent_conv_id (root: null), n_convs,
    n_children, n_leaves (childless nodes of its subtree, itself among them), saved_tokens (sum over its subtree of
    n_convs - 1 times the code points of the last text), ends_sha256 (of the decimal ids of the members that end there).

    A null conv_id is a conversation that comes after all others, and its decimal is empty. Turns with equal digests
    (128 bits, chained) are equal. Without conversations there is no node. Texts don't get here, so their length doesn't
    matter; rows that repeat are turns of their own.

    A prefix may be shared by most conversations: groups are counted before they are shuffled, and rows that look up such
    a node have its values broadcast. Turns of one conversation stream through one task in their order, and aren't held.
    """
    rows = save(prefixes(steps), "prefixes")
    below = rows.filter("depth > 0")
    width = 64
    while width < min(cells, 8 * below.count()):
        width *= 2
    bits = rows.sparkSession.sparkContext.broadcast(sketch(below, width))
    kinds = "conv_id long, depth int, node binary, parent binary, chars long, last boolean, tail boolean, inner boolean"
    celled = rows.select(*_PREFIXES.names, *[c.alias(f"c{k}") for k, c in enumerate(_cells("node", width) + _cells("parent", width))])
    rows = save(celled.mapInArrow(_screened(bits), kinds), "screened")
    bits.unpersist()

    one, tail_ends = F.lit(1).cast("long"), F.when(F.col("last"), F.sha2(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), 256)).otherwise(NOTHING)
    alone = [one.alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), tail_ends.alias("ends_sha256")]
    inner = rows.filter("tail and inner").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *alone)
    heads = rows.filter("tail and not inner").select("parent", "conv_id", "depth", *alone)

    shared = rows.filter("not tail")
    grouped = shared.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.count_if("last").alias("ended"))
    nodes = save(grouped, "shared-nodes")
    kids = nodes.filter("depth > 0").select("parent").union(heads.select("parent")).groupBy("parent").agg(F.count("*").alias("n"))
    named = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # A parent beyond the shared nodes is a tail of the same conversation.
    values = save(kids.join(named, "parent", "left").select("parent", "parent_conv_id", "n"), "parents")

    share = nodes.select(F.col("node").alias("__node"), F.col("conv_id").alias("__id"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (F.col("ended") == F.col("n_convs")).cast("long").alias("leaf"))
    down = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    put = shared.join(share, (F.col("node") == F.col("__node")) & F.col("conv_id").eqNullSafe(F.col("__id")), "left")
    goes_on = (F.lag("depth").over(down).isNull() & ~F.col("last")).cast("long")  # into a tail, which has one leaf
    put = put.select("node", "conv_id", "depth", "saved", (F.coalesce("leaf", F.lit(0)) + goes_on).alias("leaf"))
    added = put.select("node", F.sum("saved").over(down).alias("saved"), F.sum("leaf").over(down).alias("leaf"))
    sums = added.groupBy("node").agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    whole = nodes.join(sums, "node").join(_ends(shared.filter("last").select("node", "conv_id")), "node", "left").join(kids.select(F.col("parent").alias("node"), F.col("n").alias("n_children")), "node", "left")
    whole = save(whole.select("node", "parent", "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")), "nodes").drop("node")
    root = whole.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).drop("parent")
    under = join_hot(whole.filter("depth > 0").unionByName(heads), values, "parent").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id")).drop("parent")
    columns = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return root.unionByName(under).unionByName(inner).select(*columns)


#: DuckDB SQL of the query over conversations.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT),
           lambda c, b: list_reduce(range(8), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)),
           4294967295::BIGINT), 4294967295) % 6 AS h
  FROM t),
lent AS (SELECT i.conv_id, t.pos AS depth, t.role, t.text FROM ids i JOIN t ON t.conv_id = i.base AND t.pos <= i.h),
steps AS (
  SELECT * FROM lent
  UNION ALL
  SELECT t.conv_id, t.pos - i.h + coalesce(k.n, 0), t.role, t.text
  FROM t JOIN ids i USING (conv_id) LEFT JOIN (SELECT conv_id, count(*) AS n FROM lent GROUP BY conv_id) k USING (conv_id) WHERE t.pos > i.h),
prefixes AS (
  SELECT conv_id, depth, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS key,
         length(text) AS chars, lead(depth) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS last
  FROM steps
  UNION ALL
  SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM steps) FROM ids),
nodes AS (
  SELECT key, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n, max(chars) AS chars, bool_and(last) AS childless,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM prefixes GROUP BY key),
sums AS (
  SELECT a.key, count(*) FILTER (b.childless) AS n_leaves, sum((b.n - 1) * b.chars)::BIGINT AS saved_tokens
  FROM nodes a JOIN nodes b ON starts_with(b.key, a.key) GROUP BY a.key),
kids AS (SELECT left(key, length(key) - 64) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (key) LEFT JOIN kids k USING (key)
LEFT JOIN nodes p ON n.depth > 0 AND p.key = left(n.key, length(n.key) - 64)
"""
