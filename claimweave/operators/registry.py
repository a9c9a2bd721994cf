"""The registry of subjects, predicates and values: an evolving vocabulary resolved in the order of first mention.

A label joins the earliest entry that its tiers allow, else it becomes an entry. Which earlier labels are entries depends
on the labels before them; rounds settle this set by set: a label is settled once every earlier neighbour is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import squash
from ..functions.text import normalize_by_hint, normalize_subject, normalize_text
from .nearest import Vectors, nearest
from .work import is_empty, save, spread

#: Dice similarity of the lexical tier; cosine and size of the shortlist.
LEXICAL, SHORTLIST, TOP = 0.92, 0.72, 3


def normal_form(namespace: Column, label: Column, hint: Column) -> Column:
    """Normal form of a label in its namespace; a label without one stands for itself."""
    form = F.when(namespace == "predicate", normalize_text(label)).when(namespace == "subject", normalize_subject(label)).otherwise(normalize_by_hint(label, hint))
    return F.coalesce(F.nullif(form, F.lit("")), squash(label))


def forms(labels: DataFrame) -> DataFrame:
    """namespace, normal, canonical (first label), seq (first), occurrences, aliases of labels (namespace, label, hint, seq)."""
    rows = labels.withColumn("normal", normal_form(F.col("namespace"), F.col("label"), F.coalesce("hint", F.lit(""))))
    return rows.groupBy("namespace", "normal").agg(
        F.min_by("label", "seq").alias("canonical"), F.min("seq").alias("seq"), F.count("*").alias("occurrences"), F.sort_array(F.collect_set(F.lower("label"))).alias("aliases")
    )


def words_of(form: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(form, " "), lambda w: w != ""))


def dice(a: Column, b: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def prefix_size(n: Column, least: float) -> Column:
    """How many of the rarest of n words two sets of a Dice similarity of least must have one in common of."""
    # Dice >= t of sizes x and y needs an overlap of at least t / (2 - t) * x.
    share = least / (2 - least)
    return F.greatest(F.lit(1), n - F.ceil(share * n - 1e-9) + 1).cast("int")


def lexical_pairs(forms: DataFrame, least: float = LEXICAL) -> DataFrame:
    """namespace, a, b, score: normal forms whose Dice similarity of words is at least least, a the earlier.

    Prefix filter: two such sets share one of their rarest words, as many as may be missing and one more.
    """
    rows = forms.select("namespace", "normal", "seq", words_of("normal").alias("words")).filter(F.size("words") > 0)
    each = rows.select("namespace", "normal", F.explode("words").alias("word"))
    rare = each.groupBy("namespace", "word").agg(F.count("*").alias("n"))
    ranked = each.join(rare, ["namespace", "word"]).groupBy("namespace", "normal").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ranked"))
    prefix = ranked.select("namespace", "normal", F.explode(F.slice("ranked", F.lit(1), prefix_size(F.size("ranked"), least))).alias("r")).select("namespace", "normal", F.col("r.word").alias("word"))
    met = prefix.alias("x").join(prefix.alias("y"), ["namespace", "word"]).filter("x.normal <> y.normal").select("namespace", F.col("x.normal").alias("a"), F.col("y.normal").alias("b")).distinct()
    side = lambda n: rows.select("namespace", F.col("normal").alias(n), F.col("seq").alias(f"{n}_seq"), F.col("words").alias(f"{n}_words"))
    pairs = met.join(side("a"), ["namespace", "a"]).join(side("b"), ["namespace", "b"]).filter("a_seq < b_seq")
    return pairs.withColumn("score", dice(F.col("a_words"), F.col("b_words"))).filter(F.col("score") >= least).select("namespace", "a", "b", "score")


#: Labels that are compared with all entries at a time.
BLOCK = 2_048


def shortlist(labels: DataFrame, entries: DataFrame, least: float | None = SHORTLIST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """The top entries by cosine for each label, both (namespace, normal, embedding): namespace, normal, entry, score, rank.

    normal is a string or an integer. Labels go to the tasks about block at a time, so what a task holds doesn't grow with
    them; entries are read once for each block. A task returns its best entries of each label, the best of those stay.
    """
    rows = save(labels.select("namespace", "normal", "embedding").filter("namespace is not null and normal is not null"), "labels")
    entry = spread(entries.select("namespace", F.col("normal").alias("entry"), "embedding").filter("namespace is not null and entry is not null"))
    blocks = -(-rows.count() // block) or 1
    schema = T.StructType([rows.schema["namespace"], rows.schema["normal"], entry.schema["entry"], T.StructField("score", T.DoubleType())])
    best = Window.partitionBy("namespace", "normal").orderBy(F.desc("score"), "entry")
    out = None
    for k in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("namespace", "normal"), F.lit(blocks)) == k)
        scored = entry.mapInArrow(_scorer(part.toArrow(), least, top), schema)
        found = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
        out = found if out is None else out.union(found)
    return out


def _scorer(labels: pa.Table, least: float | None, top: int):
    """A function from batches of entries to their best of each label."""
    space, normal, embedding = (pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type) for column in labels.columns)
    wanted = Vectors(space, normal, embedding)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("entry").type
                yield batch

        if (found := nearest(wanted, seen(), least, top)) is not None:
            label, entry, score, known = found
            columns = [space.take(pa.array(label)), normal.take(pa.array(label)), pa.array(entry.tolist(), kind), pa.array(score, mask=~known)]
            yield pa.RecordBatch.from_arrays(columns, names=["namespace", "normal", "entry", "score"])

    return run


# What an adjudicator may say of a label and a candidate.
RELATIONS = {"predicate": ["same", "broader", "narrower", "different"], "subject": ["same", "different"], "value": ["same", "exclusive", "compatible", "different"]}


def adjudications(answers: DataFrame, shortlisted: DataFrame) -> DataFrame:
    """namespace, normal, candidate, relation of answers (namespace, normal, match, relation) about shortlisted labels.

    match is the rank of the candidate that the answer is about. An answer that names no candidate of the list, or a
    relation that its namespace doesn't have, counts as different, and so has no candidate.
    """
    listed = shortlisted.select("namespace", "normal", F.col("rank").alias("match"), F.col("entry").alias("candidate"))
    known = F.lit(False)
    for namespace, relations in RELATIONS.items():
        known = known | ((F.col("namespace") == namespace) & F.col("relation").isin(relations))
    about = F.coalesce(known, F.lit(False)) & (F.col("relation") != "different") & F.col("candidate").isNotNull()
    told = answers.join(listed, ["namespace", "normal", "match"], "left")
    return told.select("namespace", "normal", F.when(about, F.col("candidate")).alias("candidate"), F.when(about, F.col("relation")).otherwise("different").alias("relation"))


def settled_in_rounds(labels: DataFrame, near: DataFrame) -> DataFrame:
    """namespace, normal, entry, tier of labels (namespace, normal).

    near (namespace, a, b, tier, score, a_order, a_entry): label b may join a, which comes before it; a_entry is the entry
    of a, where a was settled before. A label is settled once all its earlier neighbours are: it joins the best of those
    that are entries (lowest tier, highest score, first in order), else it is an entry itself. A round reads the neighbours
    of labels that are still open, and no others.
    """
    key = ["namespace", "normal"]
    rest = save(near, "near")
    step = labels.join(rest.select("namespace", F.col("b").alias("normal")).distinct(), key, "left_anti").select(*key, F.col("normal").alias("entry"), F.lit("minted").alias("tier"))
    out = step = save(step, "settled")
    while not is_empty(rest):
        named = step.select("namespace", F.col("normal").alias("a"), F.col("entry").alias("__entry"))
        rest = save(rest.join(named, ["namespace", "a"], "left").withColumn("a_entry", F.coalesce("a_entry", "__entry")).drop("__entry"), "near")
        best = F.min(F.when(F.col("a_entry") == F.col("a"), F.struct("tier", (-F.col("score")).alias("s"), "a_order", "a")))
        judged = rest.groupBy("namespace", "b").agg(best.alias("best"), F.bool_and(F.col("a_entry").isNotNull()).alias("ready")).filter("ready")
        tier = F.when(F.col("best").isNull(), "minted").when(F.col("best.tier") == 0, "lexical").otherwise("adjudicated")
        step = save(judged.select("namespace", F.col("b").alias("normal"), F.coalesce("best.a", "b").alias("entry"), tier.alias("tier")), "settled")
        out = out.union(step)
        rest = rest.join(step.select("namespace", F.col("normal").alias("b")), ["namespace", "b"], "left_anti")
    return out


def adjudicated_edges(asked: DataFrame, entry_of: DataFrame) -> DataFrame:
    """namespace, a, b, kind of answers (namespace, a, b, relation) about label b and an earlier one a, between their entries (namespace, normal, entry)."""
    to = entry_of.select("namespace", F.col("normal").alias("x"), F.col("entry").alias("x_entry"))
    rel = asked.filter(F.col("relation").isin("broader", "narrower", "exclusive", "compatible"))
    rel = rel.join(to.withColumnsRenamed({"x": "a", "x_entry": "a_entry"}), ["namespace", "a"]).join(to.withColumnsRenamed({"x": "b", "x_entry": "b_entry"}), ["namespace", "b"])
    # broader: the label contains the candidate.
    flip = F.col("relation") == "broader"
    kind = F.when(F.col("relation").isin("broader", "narrower"), "subsumes").otherwise(F.col("relation"))
    return rel.select("namespace", F.when(flip, F.col("b_entry")).otherwise(F.col("a_entry")).alias("a"), F.when(flip, F.col("a_entry")).otherwise(F.col("b_entry")).alias("b"), kind.alias("kind")).filter("a <> b").distinct()


def canonicalize(labels: DataFrame, adjudications: DataFrame | None = None, least: float = LEXICAL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, members, edges) of labels (namespace, label, hint, seq).

    members: namespace, normal, entry (the normal form that stands for it), tier: minted, lexical or adjudicated. entries:
    namespace, normal, canonical, seq, occurrences, aliases. edges: namespace, a, b, kind. adjudications (namespace,
    normal, candidate, relation: same, broader, narrower, exclusive, compatible, different) are answers about a label and an earlier one; same joins it
    unless the lexical tier does, broader to compatible make edges. An order of labels may mint other entries than
    another order.
    """
    known = save(forms(labels), "forms")
    near = lexical_pairs(known, least).select("namespace", "a", "b", F.lit(0).alias("tier"), "score")
    earlier = known.select("namespace", F.col("normal").alias("a"), F.col("seq").alias("a_seq"))
    if adjudications is not None:
        seqs = known.select("namespace", F.col("normal").alias("b"), F.col("seq").alias("b_seq"))
        asked = adjudications.select("namespace", F.col("normal").alias("b"), F.col("candidate").alias("a"), "relation")
        asked = save(asked.join(seqs, ["namespace", "b"]).join(earlier, ["namespace", "a"]).filter("a_seq < b_seq"), "asked")
        near = near.union(asked.filter("relation = 'same'").select("namespace", "a", "b", F.lit(1).alias("tier"), F.lit(1.0).alias("score")))
    near = near.join(earlier, ["namespace", "a"]).select("namespace", "a", "b", "tier", "score", F.col("a_seq").alias("a_order"), F.lit(None).cast("string").alias("a_entry"))
    settled = save(settled_in_rounds(known.select("namespace", "normal"), near), "members")
    grouped = known.join(settled, ["namespace", "normal"])
    entries = grouped.groupBy("namespace", F.col("entry").alias("normal")).agg(F.min_by("canonical", "seq").alias("canonical"), F.min("seq").alias("seq"), F.sum("occurrences").alias("occurrences"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"))
    if adjudications is None:
        edges = settled.sparkSession.createDataFrame([], "namespace string, a string, b string, kind string")
    else:
        edges = adjudicated_edges(asked.select("namespace", "a", "b", "relation"), settled.select("namespace", "normal", "entry"))
    return entries, settled, edges


def find_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (a, b) with the edge between them in either direction: kind, direction; a to b is preferred."""
    forward = edges.select("a", "b", "kind", F.lit("a_to_b").alias("direction"))
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "kind", F.lit("b_to_a").alias("direction"))
    best = forward.union(back).groupBy("a", "b", "kind").agg(F.min("direction").alias("direction"))
    return pairs.join(best, ["a", "b"], "left")
