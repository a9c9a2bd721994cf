"""A stored corpus that grows batch by batch: pages, claims, facts, registry and relations in one store, changed together.

A batch is grounded on its pages, its labels are settled against the stored registry, its facts replace duplicates of
earlier batches or give way to them, and the blocks that it falls into are judged anew. All of that becomes visible at
once, and only the buckets of those pages, labels and blocks are read or written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import vocabulary
from ..operators.blocking import KEY
from ..operators.grounding import ground_claims
from ..operators.ingest import identity, split_grounded
from ..operators.store import admit
from ..operators.tables import BUCKETS, Change, Store, without
from ..operators.work import is_empty, save
from ..sources.star import lift
from .reconcile import edge_ids, labels_of, relations, touched, with_entries

#: Bucket columns: what belongs to a document by its id, facts and relations by their block. places has the buckets of
#: facts that each document has some in.
LAYOUT = {"documents": ["document_id"], "pages": ["document_id"], "quarantine": ["document_id"], "places": ["document_id"], "facts": KEY, "relations": KEY} | vocabulary.LAYOUT
FACT_KEY = [*KEY, "document_id", "claim_key"]


def open_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Store:
    return Store(spark, path, LAYOUT, buckets)


def _judge_again(change: Change, moved: DataFrame, rules: str) -> None:
    """The relations of the blocks that moved facts (KEY) belong to, from the facts as the change has them."""
    blocks = save(moved.select(*KEY).distinct(), "blocks")
    hit = change.store.touched("facts", blocks)
    edges = change.table("edges")
    fresh = relations(touched(change.table("facts", hit), blocks), None if edges is None else edge_ids(edges), rules)
    old = change.table("relations", hit)
    change.replace("relations", fresh if old is None else without(old, blocks, KEY).unionByName(fresh), hit)


def add_claims(change: Change, claims: DataFrame, adjudications: DataFrame | None = None, rules: str = "reference") -> None:
    """Claims (those of lift, with quote) on stored pages become facts, quarantine and relations.

    Of equal claims of a document (ingest.identity), in this batch or an earlier one, the one with the smallest fact_seq
    is the fact. A rejected claim is stored with its reason; fact_seq tells claims of a document apart.
    """
    claims = save(claims.withColumn("claim_key", F.sha2(F.to_json(F.struct(*[c.alias(f"k{k}") for k, c in enumerate(identity())])), 256)), "claims")
    pages = change.near("pages", claims)
    if pages is None:
        pages = claims.sparkSession.createDataFrame([], "document_id string, page_number int, text string")
    kept, rejected = split_grounded(save(ground_claims(claims, pages), "grounded"))
    change.upsert("quarantine", rejected, ["document_id", "fact_seq"], first=[F.col("reason")])
    place = kept.select("fact_seq", "claim_key", "quote", F.col("grounding.start").alias("char_start"), F.col("grounding.end").alias("char_end"))
    facts = save(lift(kept).join(place, "fact_seq"), "lifted")
    labels = labels_of(facts)
    members = vocabulary.settle(change, labels, adjudications)
    facts = save(with_entries(facts, labels, members), "facts")
    if is_empty(facts):
        return
    change.upsert("facts", facts, FACT_KEY, first=[F.col("fact_seq")])
    change.upsert("places", facts.select("document_id", change.store.bucket("facts").alias("at")).distinct(), ["document_id", "at"])
    _judge_again(change, facts, rules)


def ingest_batch(store: Store, claims: DataFrame, pages: DataFrame | None = None, documents: DataFrame | None = None, adjudications: DataFrame | None = None, batch: int | None = None, rules: str = "reference") -> int:
    """One batch of documents, pages (document_id, page_number, text) and claims; the store's version afterwards.

    A batch number that the store has seen is left out, so a batch that is run again changes nothing.
    """
    change = store.begin()
    if batch is not None and change.state["notes"].get("batch", -1) >= batch:
        return change.version - 1
    if documents is not None:
        change.upsert("documents", documents, ["document_id"])
    if pages is not None:
        change.upsert("pages", pages, ["document_id", "page_number"])
    add_claims(change, claims, adjudications, rules)
    return change.commit(**({} if batch is None else {"batch": batch}))


def remove_documents(change: Change, ids: DataFrame) -> None:
    """Documents (document_id) go with their pages, quarantine, facts and relations; other buckets aren't touched."""
    ids = save(ids.select("document_id").distinct(), "removed")
    for name in ("documents", "pages", "quarantine"):
        change.delete(name, ids)
    places = change.near("places", ids)
    if places is None:
        return
    hit = sorted(r[0] for r in places.join(ids, "document_id").select("at").distinct().collect())  # a number per bucket
    gone = save(change.table("facts", hit).join(ids, "document_id", "left_semi").select("id"), "gone-facts")
    change.delete("facts", ids, on=["document_id"], touched=hit)
    for side in ("fact_a_id", "fact_b_id"):
        change.delete("relations", gone.withColumnRenamed("id", side), on=[side], touched=hit)
    change.delete("places", ids)


def reingest(store: Store, documents: DataFrame, pages: DataFrame, claims: DataFrame, force: bool = False, adjudications: DataFrame | None = None) -> DataFrame:
    """Take in documents (document_id, source_path, ...) with their pages and claims; the refused ones come back.

    A document whose path is stored is refused; with force it takes the place of all documents of that path.
    """
    change = store.begin()
    known = change.table("documents")
    if known is None:
        known = documents.limit(0)
    admitted, refused = (save(x, "admission") for x in admit(known, documents, force))
    if is_empty(admitted):
        return refused
    same = known.join(admitted.select("source_path").distinct(), "source_path", "left_semi") if force else known.limit(0)
    if not is_empty(same):
        remove_documents(change, same)
    own = admitted.select("document_id")
    change.upsert("documents", admitted.select(*documents.columns), ["document_id"])
    change.upsert("pages", pages.join(own, "document_id", "left_semi"), ["document_id", "page_number"])
    add_claims(change, claims.join(own, "document_id", "left_semi").select(*claims.columns), adjudications)
    change.commit()
    return refused


def stream(store: Store, source: str, schema, adjudications: DataFrame | None = None) -> StreamingQuery:
    """Take in all claims that arrive as Parquet files in source, on pages that the store has, then stop.

    The store knows the last batch that it has, so a batch that is run again after a failure counts once.
    """
    arriving = store.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    work = lambda df, k: ingest_batch(store, df, adjudications=adjudications, batch=k)
    return arriving.writeStream.foreachBatch(work).option("checkpointLocation", f"{store.path}/progress").trigger(availableNow=True).start()


def relations_of_document(store: Store, document_id: str) -> DataFrame:
    """The relations that facts of a document take part in; reads the buckets that it has facts in."""
    spark = store.spark
    places = store.near("places", spark.createDataFrame([(document_id,)], "document_id string")).filter(F.col("document_id") == document_id)
    hit = [r["at"] for r in places.select("at").collect()]
    own = store.table("facts", hit).filter(F.col("document_id") == document_id).select("id")
    rows = store.table("relations", hit)
    ends = rows.select("id", F.explode(F.array("fact_a_id", "fact_b_id")).alias("fact")).join(own.withColumnRenamed("id", "fact"), "fact", "left_semi").select("id").distinct()
    return rows.join(ends, "id", "left_semi")
