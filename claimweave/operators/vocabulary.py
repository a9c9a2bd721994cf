"""The stored registry: new labels are settled against entries of earlier batches, and old labels aren't read again.

Labels of a batch come after all stored ones. Stored are the forms with their entries, the postings of the prefix filter,
the rank of every word, and edges; a batch reads and writes only the buckets that its own forms and words fall into.

The prefix filter needs one order of words for all time, so a word keeps the rank of the batch that it came with: words of
later batches come first, as they are rarer, and within a batch those with fewer labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import LEXICAL, adjudicated_edges, dice, forms, normal_form, prefix_size, settled_in_rounds, words_of
from .tables import Change, Store
from .work import save

#: Bucket columns of the registry's tables.
LAYOUT = {"forms": ["namespace", "normal"], "words": ["namespace", "word"], "postings": ["namespace", "word"], "edges": ["namespace", "a"]}


def settle(change: Change, labels: DataFrame, adjudications: DataFrame | None = None, least: float = LEXICAL) -> DataFrame:
    """namespace, normal, entry, tier of every form of labels (namespace, label, hint, seq), which are stored with the change.

    Tiers and adjudications are those of registry.canonicalize; labels in several batches, in the order of seq, are settled
    as in one. A form that is known adds to its occurrences and aliases and keeps its entry. Null labels and namespaces are
    left to the caller; an empty batch changes nothing.
    """
    spark, batch = labels.sparkSession, change.version
    arriving = save(forms(labels), "arriving")
    stored = change.near("forms", arriving)
    if stored is None:
        stored = spark.createDataFrame([], "namespace string, normal string, canonical string, seq bigint, occurrences bigint, aliases array<string>, batch bigint, entry string, tier string")
    key = ["namespace", "normal"]
    again = arriving.select(*key, F.col("occurrences").alias("__n"), F.col("aliases").alias("__aliases")).join(stored, key)
    fresh = save(arriving.join(stored.select(*key), key, "left_anti"), "fresh")

    # Words and their ranks.
    own = fresh.select(*key, "seq", words_of("normal").alias("words"))
    each = own.select(*key, F.explode("words").alias("word"))
    ranks = change.near("words", each)
    new_words = each.groupBy("namespace", "word").agg(F.count("*").alias("n")).withColumn("batch", F.lit(batch).cast("long"))
    new_words = save(new_words if ranks is None else new_words.join(ranks.select("namespace", "word"), ["namespace", "word"], "left_anti"), "new-words")
    ranks = new_words if ranks is None else ranks.unionByName(new_words)
    order = F.struct((-F.col("batch")).alias("batch"), "n", "word")
    ranked = each.join(ranks, ["namespace", "word"]).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(order)), lambda r: r["word"]).alias("ranked"))
    prefix = ranked.join(own, key).select(*key, "seq", F.explode(F.slice("ranked", F.lit(1), prefix_size(F.size("ranked"), least))).alias("word"))
    prefix = save(prefix, "prefixes")

    # Earlier labels that share a word of both prefixes: of earlier batches, with their entries, or of this one.
    b = prefix.select("namespace", "word", F.col("normal").alias("b"), F.col("seq").alias("b_seq"))
    here = prefix.select("namespace", "word", F.col("normal").alias("a"), F.lit(batch).cast("long").alias("a_batch"), F.col("seq").alias("a_seq"), F.lit(None).cast("string").alias("a_entry"))
    earlier = change.near("postings", prefix)
    if earlier is not None:
        here = here.unionByName(earlier.select("namespace", "word", F.col("normal").alias("a"), F.col("batch").alias("a_batch"), F.col("seq").alias("a_seq"), F.col("entry").alias("a_entry")))
    met = b.join(here, ["namespace", "word"]).filter((F.col("a_batch") < batch) | (F.col("a_seq") < F.col("b_seq"))).drop("word", "b_seq").distinct()
    near = met.withColumn("score", dice(words_of("a"), words_of("b"))).filter(F.col("score") >= least).withColumn("tier", F.lit(0))
    asked = None
    if adjudications is not None:
        asked = adjudications.select("namespace", F.col("normal").alias("b"), F.col("candidate").alias("a"), "relation")
        known = change.near("forms", asked.select("namespace", F.col("a").alias("normal")))
        place = fresh.select("namespace", F.col("normal").alias("a"), F.lit(batch).cast("long").alias("a_batch"), F.col("seq").alias("a_seq"), F.lit(None).cast("string").alias("a_entry"))
        if known is not None:
            place = place.unionByName(known.select("namespace", F.col("normal").alias("a"), F.col("batch").alias("a_batch"), F.col("seq").alias("a_seq"), F.col("entry").alias("a_entry")))
        to = fresh.select("namespace", F.col("normal").alias("b"), F.col("seq").alias("b_seq"))
        asked = save(asked.join(place, ["namespace", "a"]).join(to, ["namespace", "b"]).filter((F.col("a_batch") < batch) | (F.col("a_seq") < F.col("b_seq"))).drop("b_seq"), "asked")
        same = asked.filter("relation = 'same'").drop("relation").withColumns({"score": F.lit(1.0), "tier": F.lit(1)})
        near = near.unionByName(same)

    near = near.select("namespace", "a", "b", "tier", "score", F.struct("a_batch", "a_seq").alias("a_order"), "a_entry")
    members = save(settled_in_rounds(fresh.select(*key), near), "members")

    whole = fresh.join(members, key).withColumn("batch", F.lit(batch).cast("long"))
    grown = again.withColumns({"occurrences": F.col("occurrences") + F.col("__n"), "aliases": F.sort_array(F.array_union("aliases", "__aliases"))}).drop("__n", "__aliases")
    known_members = again.select(*key, "entry", "tier")
    out = save(known_members.unionByName(members.select(*key, "entry", "tier")), "batch-members")
    change.upsert("forms", grown.unionByName(whole.select(*grown.columns)), key)
    change.upsert("words", new_words, ["namespace", "word"])
    change.upsert("postings", prefix.join(members, key).select("namespace", "word", "normal", F.lit(batch).cast("long").alias("batch"), "seq", "entry"), ["namespace", "word", "normal"])
    if asked is not None:
        stored_entries = asked.filter("a_entry is not null").select("namespace", F.col("a").alias("normal"), F.col("a_entry").alias("entry"))
        edges = adjudicated_edges(asked.select("namespace", "a", "b", "relation"), members.select(*key, "entry").union(stored_entries).distinct())
        change.upsert("edges", edges, ["namespace", "a", "b", "kind"])
    return out


def entries(store: Store) -> DataFrame:
    """All entries: namespace, normal, canonical, seq, occurrences, aliases."""
    order = F.struct("batch", "seq")
    rows = store.table("forms").groupBy("namespace", F.col("entry").alias("normal"))
    return rows.agg(
        F.min_by("canonical", order).alias("canonical"), F.min_by("seq", order).alias("seq"), F.sum("occurrences").alias("occurrences"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases")
    )


def entry_of(store: Store, labels: DataFrame) -> DataFrame:
    """labels (namespace, label, hint) with the entry that their form has; null where the registry doesn't know it. Reads their buckets alone."""
    rows = labels.withColumn("normal", normal_form(F.col("namespace"), F.col("label"), F.coalesce("hint", F.lit(""))))
    return rows.join(store.near("forms", rows).select("namespace", "normal", "entry"), ["namespace", "normal"], "left")


def edges_of(store: Store, namespace: str, entry: str) -> DataFrame:
    """The edges of an entry in either direction."""
    edges = store.table("edges")
    return edges.filter((F.col("namespace") == namespace) & ((F.col("a") == entry) | (F.col("b") == entry)))


def counts(store: Store) -> DataFrame:
    """namespace, entries, forms, occurrences."""
    return store.table("forms").groupBy("namespace").agg(F.count_if(F.col("entry") == F.col("normal")).alias("entries"), F.count("*").alias("forms"), F.sum("occurrences").alias("occurrences"))
