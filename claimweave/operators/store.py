"""Queries and changes over the tables of claims, facts and relations; tables are DataFrames in a dict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Tables = dict[str, DataFrame]


def _like(q: str) -> Column:
    """Substring search as in a LIKE without escapes: % and _ in q are wildcards; case doesn't matter."""
    return F.col("claim").ilike(f"%{q}%") | F.col("subject").ilike(f"%{q}%") | F.col("predicate").ilike(f"%{q}%")


def list_facts(facts: DataFrame, document_id: str | None = None, fact_type: str | None = None, predicate_id: str | None = None, subject_id: str | None = None, q: str | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
    for name, value in (("document_id", document_id), ("fact_type", fact_type), ("canonical_predicate_id", predicate_id), ("canonical_subject_id", subject_id)):
        if value is not None:
            facts = facts.filter(F.col(name) == value)
    if q:
        facts = facts.filter(_like(q))
    return facts.orderBy("fact_seq").offset(offset).limit(limit)


def list_relations(relations: DataFrame, verdict: str | None = None, k: int = 200) -> DataFrame:
    rows = relations if verdict is None else relations.filter(F.col("verdict") == verdict)
    return rows.orderBy(F.desc("confidence"), "id").limit(k)


def relations_of(relations: DataFrame, fact_id: str) -> DataFrame:
    return relations.filter((F.col("fact_a_id") == fact_id) | (F.col("fact_b_id") == fact_id))


def relation_counts(relations: DataFrame) -> DataFrame:
    return relations.groupBy("verdict").agg(F.count("*").alias("n"))


def best_per_verdict(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """The surest relation of each verdict, between documents if there is one."""
    doc = lambda side: facts.select(F.col("id").alias(f"fact_{side}_id"), F.col("document_id").alias(f"doc_{side}"))
    rows = relations.join(doc("a"), "fact_a_id").join(doc("b"), "fact_b_id").withColumn("cross", F.col("doc_a") != F.col("doc_b"))
    best = rows.groupBy("verdict").agg(F.min_by(F.struct("id", "confidence", "cross"), F.struct(~F.col("cross"), -F.col("confidence"), "id")).alias("b"))
    return best.select("verdict", "b.*")


def delete_document(tables: Tables, document_id: str) -> Tables:
    """tables without a document and all that hangs on it."""
    gone = tables["facts"].filter(F.col("document_id") == document_id).select("id")
    out = {name: t.filter(F.col("document_id") != document_id) if "document_id" in t.columns else t for name, t in tables.items()}
    rel = tables["relations"]
    for side in ("fact_a_id", "fact_b_id"):
        rel = rel.join(gone.withColumnRenamed("id", side), side, "left_anti")
    return out | {"relations": rel.select(*tables["relations"].columns)}


def patch(table: DataFrame, key: str, value: str, changes: dict[str, Column]) -> DataFrame:
    """table with changes in the rows whose key has the value."""
    hit = F.col(key) == value
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.withColumn("__nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__new")))).filter("__nth = 1").drop("__new", "__nth")


def grounding_rate(kept: DataFrame, quarantine: DataFrame) -> DataFrame:
    """document_id, kept, rejected, rate (null without claims)."""
    rows = kept.select("document_id", F.lit(1).alias("k"), F.lit(0).alias("r")).union(quarantine.select("document_id", F.lit(0), F.lit(1)))
    out = rows.groupBy("document_id").agg(F.sum("k").alias("kept"), F.sum("r").alias("rejected"))
    return out.withColumn("rate", F.try_divide(F.col("kept").cast("double"), F.col("kept") + F.col("rejected")))


def evidence_window(text: Column, start: Column, end: Column, around: int = 220) -> Column:
    """struct<before, mark, after>: the evidence with some text around it and … where it is cut."""
    first = F.greatest(start - around, F.lit(0))
    before = F.concat(F.when(first > 0, "…").otherwise(""), F.substr(text, first + 1, start - first))
    after = F.concat(F.substr(text, end + 1, F.lit(around)), F.when(F.length(text) > end + around, "…").otherwise(""))
    return F.struct(before.alias("before"), F.substr(text, start + 1, end - start).alias("mark"), after.alias("after"))


def fact_details(facts: DataFrame, pages: DataFrame, relations: DataFrame) -> DataFrame:
    """Each fact with its page's text and its number of relations."""
    ends = relations.select(F.col("fact_a_id").alias("id")).union(relations.select("fact_b_id"))
    n = ends.groupBy("id").agg(F.count("*").alias("relations"))
    return facts.join(pages.select("document_id", "page_number", "text"), ["document_id", "page_number"], "left").join(n, "id", "left").fillna(0, ["relations"])


def registry_view(entries: DataFrame, namespace: str | None = None) -> DataFrame:
    """Entries without embeddings, the most used first."""
    rows = entries if namespace is None else entries.filter(F.col("namespace") == namespace)
    return rows.drop("embedding").orderBy("namespace", F.desc("occurrences"), "normal")


# ---- lookups and changes of single tables --------------------------------------------------------------------------


def list_documents(documents: DataFrame) -> DataFrame:
    """Documents, the last ingested first."""
    return documents.orderBy(F.desc("ingested_at"), "document_id")


def get_document(documents: DataFrame, document_id: str) -> DataFrame:
    return documents.filter(F.col("document_id") == document_id)


def document_status(documents: DataFrame, document_id: str) -> DataFrame:
    return get_document(documents, document_id).select("document_id", "status", "error")


def page_texts(pages: DataFrame, document_id: str, page_number: int | None = None) -> DataFrame:
    """The pages of a document in order, or one of them."""
    rows = pages.filter(F.col("document_id") == document_id)
    return (rows if page_number is None else rows.filter(F.col("page_number") == page_number)).orderBy("page_number")


def get_fact(facts: DataFrame, fact_id: str) -> DataFrame:
    return facts.filter(F.col("id") == fact_id)


def count_facts(facts: DataFrame, document_id: str | None = None) -> DataFrame:
    return (facts if document_id is None else facts.filter(F.col("document_id") == document_id)).agg(F.count("*").alias("n"))


def pending_facts(facts: DataFrame) -> DataFrame:
    """Facts that no registry entry stands for yet."""
    return facts.filter(F.col("canonical_predicate_id").isNull())


def set_canonical(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """facts with canonical_subject_id, canonical_predicate_id and value_id of ids (id and those three) where it has them."""
    names = ["canonical_subject_id", "canonical_predicate_id", "value_id"]
    new = ids.select("id", *[F.col(n).alias(f"__{n}") for n in names])
    out = facts.join(new, "id", "left").withColumns({n: F.coalesce(f"__{n}", n) for n in names})
    return out.select(*facts.columns)


def list_quarantine(quarantine: DataFrame, document_id: str | None = None, reason: str | None = None, limit: int = 200) -> DataFrame:
    for name, value in (("document_id", document_id), ("reason", reason)):
        if value is not None:
            quarantine = quarantine.filter(F.col(name) == value)
    return quarantine.orderBy("document_id", "page_number", "unit", "claim_pos").limit(limit)


def quarantine_by_reason(quarantine: DataFrame) -> DataFrame:
    return quarantine.groupBy("reason").agg(F.count("*").alias("n"))


def clear_relations(tables: Tables) -> Tables:
    return tables | {"relations": tables["relations"].limit(0)}


def reset(tables: Tables) -> Tables:
    return {name: t.limit(0) for name, t in tables.items()}


def admit(documents: DataFrame, arriving: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(admitted, refused) of arriving documents (document_id, source_path): one whose path is known is refused unless forced."""
    known = documents.select("source_path").distinct()
    if force:
        return arriving, arriving.limit(0)
    return arriving.join(known, "source_path", "left_anti"), arriving.join(known, "source_path", "left_semi")


def replace_documents(tables: Tables, arriving: DataFrame) -> Tables:
    """tables without the documents whose path an arriving document has, nor what hangs on them."""
    old = tables["documents"].join(arriving.select("source_path").distinct(), "source_path", "left_semi").select("document_id")
    gone = tables["facts"].join(old, "document_id", "left_semi").select("id")
    out = {name: t.join(old, "document_id", "left_anti").select(*t.columns) if "document_id" in t.columns else t for name, t in tables.items()}
    rel = tables["relations"]
    for side in ("fact_a_id", "fact_b_id"):
        rel = rel.join(gone.withColumnRenamed("id", side), side, "left_anti")
    return out | {"relations": rel.select(*tables["relations"].columns)}


def write_tables(tables: Tables, path: str) -> None:
    """Every table as Parquet under path; the old one of that name is replaced."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables(spark, path: str, names: list[str]) -> Tables:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def whole_facts(facts: DataFrame, pages: DataFrame, relations: DataFrame) -> DataFrame:
    """Each fact with its evidence within its page (char_start, char_end) and its relations, surest first."""
    page = pages.select("document_id", "page_number", F.col("text").alias("__page"))
    own = F.struct((-F.col("confidence")).alias("order"), F.col("id").alias("relation_id"), "verdict", "other")
    ends = relations.select("id", "verdict", "confidence", F.col("fact_a_id").alias("fact"), F.col("fact_b_id").alias("other")).union(relations.select("id", "verdict", "confidence", "fact_b_id", "fact_a_id"))
    met = ends.groupBy("fact").agg(F.transform(F.sort_array(F.collect_list(own)), lambda r: F.struct(r["relation_id"].alias("id"), r["verdict"].alias("verdict"), r["other"].alias("other"))).alias("relations"))
    rows = facts.join(page, ["document_id", "page_number"], "left").join(met, F.col("id") == F.col("fact"), "left").drop("fact")
    return rows.withColumn("evidence", evidence_window(F.col("__page"), F.col("char_start"), F.col("char_end"))).drop("__page")
