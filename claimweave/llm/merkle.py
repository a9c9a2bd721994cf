"""Merkle manifest of a dataset: a tree of hashes for each value of a column, a tree over their roots, a proof for each row.

Rows are numbered within their tree without a sort in one task. Eight levels are climbed at a time in windows over blocks
of 256 neighbours: on level k the nodes stand in the rows whose number 2^k divides, so lag and lead by 2^k rows, masked by
slot and run length, are a node's sibling, and rows that are first children hash the pair for the next level. The nodes of
the eighth level are the rows of the next such tier, a 256th in number. Proofs are put together from the top down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered, save

#: Levels that one tier of windows climbs; a block has 2 ** BITS rows.
BITS = 8
#: The columns of documents that a leaf hashes, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<on_left:boolean,digest:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one behind the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(*values: Column) -> Column:
    """Hash of a row's values: each as its UTF-8 byte count, a colon and itself, or - if null."""
    shown = [v.cast("string") for v in values]
    return digest(*[F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in shown])


def _climbed(nodes: DataFrame, with_path: bool) -> DataFrame:
    """nodes (tree, idx, n, h, ...) with top, BITS levels above h in rows that begin a block, and with path if asked.

    n is the number of nodes of the tree on the level of h. A level of one node is not climbed.
    """
    block = Window.partitionBy("tree", "block").orderBy("idx")  # a column, so that all windows share one exchange and sort
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    idx, rows, h, waiting, steps = F.col("idx"), nodes.withColumn("block", F.shiftright("idx", BITS)), "h", {}, []
    for k in range(BITS):
        size = 1 << k
        at, run = F.shiftright(idx, k), F.shiftright(F.col("n") + (size - 1), k)
        right, holds = at.bitwiseAND(F.lit(1)) == 1, idx.bitwiseAND(F.lit(size - 1)) == 0
        rows = rows.withColumns(waiting | {"__next": F.lead(h, size).over(block), "__prev": F.lag(h, size).over(block)})
        sibling = F.when(holds & (run > 1), F.when(right, F.col("__prev")).when(at + 1 < run, F.col("__next")).otherwise(""))
        parent = F.when(run > 1, digest(F.col(h), F.col("__sibling"))).otherwise(F.col(h))
        rows = rows.withColumn("__sibling", sibling).withColumn(f"__h{k + 1}", F.when(holds & ~right, parent))
        if with_path:
            rows = rows.withColumn(f"__sibling{k}", F.col("__sibling"))
            # A row's node of this level stands in the last row up to it that has one.
            waiting = {f"__step{k}": F.last(f"__sibling{k}", ignorenulls=True).over(so_far)}
            steps.append(F.when(run > 1, F.struct(right.alias("on_left"), F.col(f"__step{k}").alias("digest"))))
        h = f"__h{k + 1}"
    rows = rows.withColumns(waiting | {"top": F.col(h)})
    return rows.withColumn("path", F.array_compact(F.array(*steps))).select(*nodes.columns, "block", "path") if with_path else rows.select(*nodes.columns, "block", "top")


def _tiers(nodes: DataFrame, most: int, label: str) -> list[DataFrame]:
    """nodes and the tiers above them, up to the one in which every tree has a single node; most is the largest n."""
    tiers = [nodes]
    while most > 1 or len(tiers) < 2:
        up = _climbed(tiers[-1], False).filter(F.col("idx").bitwiseAND(F.lit(2**BITS - 1)) == 0)
        tiers.append(save(up.select("tree", F.col("block").alias("idx"), F.shiftright(F.col("n") + (2**BITS - 1), BITS).alias("n"), F.col("top").alias("h")), label))
        most = (most + 2**BITS - 1) >> BITS
    return tiers


def _proofs(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The rows of the lowest tier with path, up to what above (tree, block, above, ...) adds to it for each tree's last node."""
    keep = [c for c in above.columns if c not in ("tree", "block", "above")]
    up = above
    for nodes in tiers[-2::-1]:
        own = [c for c in nodes.columns if c not in keep]
        rows = _climbed(nodes, True).join(up, ["tree", "block"])
        rows = rows.select(*own, *keep, F.concat("path", "above").alias("path"))
        up = rows.select("tree", F.col("idx").alias("block"), *keep, F.col("path").alias("above"))
    return rows


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree_col: str = "lang", id_col: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, path (array of on_left, digest), and the columns of carry.

    A tree per value of tree_col, null among them, its leaves in the order of id_col; the subroots, in bytewise order of
    those values (null first), make the tree of root. path has the siblings from a leaf to root, empty where a node is
    alone in its run; fold() follows it. Nulls of fields hash as -. Rows of one id_col are ordered by their leaves, null
    ids come first; rows that repeat have leaves of their own. Texts of any length are hashed whole, where they are read,
    and not moved. An empty table gives an empty result. Columns of docs that aren't named are ignored.

    Only hashes are moved, some hundred bytes a row. A tree that holds most rows is spread over blocks like the others.
    """
    leaves = docs.select(F.col(tree_col).alias("lang"), F.col(id_col).alias("doc_id"), leaf_hash(*[F.col(f) for f in fields]).alias("h"), *[c.alias(n) for n, c in (carry or {}).items()])
    rows = numbered(save(leaves, "leaves"), ["lang", "doc_id", "h"], "pos", "merkle-rows")
    langs = numbered(save(rows.groupBy("lang").agg(F.min("pos").alias("low"), F.count("*").alias("n")), "merkle-runs"), ["lang"], "tree", "merkle-trees")
    trees, most = langs.agg(F.count("*"), F.max("n")).first()
    known = langs.select(F.col("lang").alias("__lang"), "tree", "low", "n")
    nodes = rows.join(known, F.col("lang").eqNullSafe(F.col("__lang"))).withColumn("idx", F.col("pos") - F.col("low")).select("tree", "idx", "n", "h", "doc_id", *(carry or {}))
    tiers = _tiers(nodes, most or 0, "merkle-tier")
    subroots = tiers[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("n"), "h")
    over = _tiers(subroots, trees, "merkle-top")
    root = over[-1].first()
    start = over[-1].select("tree", F.col("idx").alias("block"), F.array().cast(PATH).alias("above"))
    above = _proofs(over, start).select(F.col("idx").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("h").alias("subroot"), F.col("path").alias("above"))
    return _proofs(tiers, above).select("doc_id", F.col("h").alias("leaf"), "subroot", F.lit(root and root["h"]).cast("string").alias("root"), "path", *(carry or {}))


def fold(leaf: Column, path: Column | str) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, p: F.when(p["on_left"], digest(p["digest"], h)).otherwise(digest(h, p["digest"])))


def proof_hash(path: Column | str) -> Column:
    """Hash of all siblings of a path."""
    return digest(F.array_join(F.transform(path, lambda p: p["digest"]), ""))


def tampered_leaf(fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", count_col: str = "n_chars", every: int = 7) -> Column:
    """The leaf with 1 added to count_col, where every divides the CRC-32 of the decimal id; null where not, and where the count or id is null."""
    more = [(F.col(f).cast("decimal(20,0)") + 1).cast("string") if f == count_col else F.col(f) for f in fields]
    return F.when((F.crc32(F.col(id_col).cast("string")) % every == 0) & F.col(count_col).isNotNull(), leaf_hash(*more))


#: DuckDB SQL of the query over documents.
ORACLE = r"""
WITH RECURSIVE coded AS (
  SELECT doc_id, lang,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS before,
         coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS counted,
         coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS recounted,
         coalesce(strlen(text) || ':' || text, '-') AS after,
         xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT),
           lambda c, b: list_reduce(range(8), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)),
           4294967295::BIGINT), 4294967295) AS crc
  FROM documents),
hashed AS (
  SELECT doc_id, lang, sha256(before || counted || after) AS leaf,
         sha256(before || CASE WHEN crc % 7 = 0 THEN recounted ELSE counted END || after) AS shown
  FROM coded),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n,
         row_number() OVER () AS rid
  FROM hashed),
up(lang, k, idx, h, n) AS (
  SELECT lang, 0, idx, leaf, n FROM leaves
  UNION ALL
  SELECT lang, k + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY lang, k, idx // 2),
subroots AS (
  SELECT lang, k AS levels, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
over_(k, idx, h, n) AS (
  SELECT 0, idx, h, n FROM subroots
  UNION ALL
  SELECT k + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM over_ WHERE n > 1 GROUP BY k, idx // 2),
steps AS (
  SELECT l.rid, v.k AS step, (l.idx >> v.k) & 1 = 1 AS on_left, coalesce(u.h, '') AS h
  FROM leaves l JOIN (SELECT DISTINCT lang, k FROM up WHERE n > 1) v ON l.lang IS NOT DISTINCT FROM v.lang
  LEFT JOIN up u ON u.lang IS NOT DISTINCT FROM l.lang AND u.k = v.k AND u.idx = xor(l.idx >> v.k, 1)
  UNION ALL
  SELECT l.rid, s.levels + v.k, (s.idx >> v.k) & 1 = 1, coalesce(o.h, '')
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN (SELECT DISTINCT k FROM over_ WHERE n > 1) v
  LEFT JOIN over_ o ON o.k = v.k AND o.idx = xor(s.idx >> v.k, 1)),
folded(rid, step, h) AS (
  SELECT rid, 0, shown FROM leaves
  UNION ALL
  SELECT f.rid, f.step + 1, sha256(CASE WHEN s.on_left THEN s.h || f.h ELSE f.h || s.h END) FROM folded f JOIN steps s ON s.rid = f.rid AND s.step = f.step),
proofs AS (SELECT rid, string_agg(h, '' ORDER BY step) AS all_, count(*) AS n FROM steps GROUP BY rid)
SELECT l.doc_id, l.leaf, s.h AS subroot, o.h AS root, sha256(coalesce(p.all_, '')) AS proof_sha256, f.h AS folded_root, f.h = o.h AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
LEFT JOIN proofs p ON p.rid = l.rid JOIN folded f ON f.rid = l.rid AND f.step = coalesce(p.n, 0)
CROSS JOIN (SELECT h FROM over_ WHERE n = 1) o
"""
