"""Answers of external models as a keyed table: lookup by content, preference among models, coverage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import Change
from ..operators.work import is_empty, save


def response_key(prompt_version: Column | str, kind: str, payload: Column) -> Column:
    """Key of a request, whichever model answers it."""
    version = F.col(prompt_version) if isinstance(prompt_version, str) else prompt_version
    return F.sha2(F.concat_ws("\n", version, F.lit(kind), payload), 256)


def answered(requests: DataFrame, responses: DataFrame, models: list[str]) -> DataFrame:
    """requests (key, ...) with the value and model of the first preferred model that answered; null if none did."""
    rank = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    order = F.when(rank == 0, len(models) + 1).otherwise(rank)
    best = responses.groupBy("key").agg(F.min_by(F.struct("model", "value"), F.struct(order, "model", "created_at")).alias("best"))
    return requests.join(best, "key", "left").select(*requests.columns, F.col("best.model").alias("model"), F.col("best.value").alias("value"))


def missing(requests: DataFrame, responses: DataFrame) -> DataFrame:
    return requests.join(responses.select("key").distinct(), "key", "left_anti")


def coverage(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """document_id, units, answered, share, state (skip below a half, partial below 0.99, full); no requests count as full."""
    hits = requests.join(responses.select("key").distinct().withColumn("hit", F.lit(1)), "key", "left")
    out = hits.groupBy("document_id").agg(F.count("*").alias("units"), F.count("hit").alias("answered"))
    share = F.col("answered") / F.col("units")
    return out.withColumn("share", share).withColumn("state", F.when(F.col("share") < 0.5, "skip").when(F.col("share") < 0.99, "partial").otherwise("full"))


def extract(requests: DataFrame, extractor: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """key, value, error of requests that an extractor plug-in answers batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield extractor(batch)[["key", "value", "error"]]

    return requests.mapInPandas(run, "key string, value string, error string")


def no_extractor(batch: pd.DataFrame) -> pd.DataFrame:
    """The default plug-in: no model can be reached."""
    return pd.DataFrame({"key": batch["key"], "value": None, "error": "no extractor"})


#: Bucket columns of the stored answers, for operators.tables.Store.
LAYOUT = {"responses": ["key"]}


class NoAnswers(RuntimeError):
    """Not one request has an answer."""


def answer(change: Change, requests: DataFrame, extractor: Callable[[pd.DataFrame], pd.DataFrame], models: list[str], model: str, created_at: str, attempts: int = 1) -> DataFrame:
    """requests (key, ... what the extractor needs) with model, value, error, and hit: whether the answer was stored.

    Stored answers are looked up in the buckets of their keys, of whichever model, those of models first. All other requests
    go to the extractor, a key once, and those that fail again up to attempts times; what it answers is stored under model
    with the change. A request without an answer keeps its last error. If no request has one, NoAnswers is raised and the
    change should be dropped.
    """
    requests = save(requests, "requests")
    stored = change.near("responses", requests)
    if stored is None:
        stored = requests.sparkSession.createDataFrame([], "key string, model string, value string, created_at string")
    have = save(answered(requests, stored, models), "answered")
    rest = have.filter("value is null").select(*requests.columns).dropDuplicates(["key"])
    told = None
    for k in range(attempts):
        step = save(extract(rest, extractor), "extracted")
        failed = step.filter("value is null")
        last = k == attempts - 1 or is_empty(failed)
        own = step if last else step.filter("value is not null")
        told = own if told is None else told.union(own)
        if last:
            break
        rest = rest.join(failed.select("key"), "key", "left_semi")
    told = save(told, "told")
    new = told.filter("value is not null").select("key", F.lit(model).alias("model"), "value", F.lit(created_at).alias("created_at"))
    change.upsert("responses", new, ["key", "model"], first=[F.desc("created_at")])
    fresh = told.select("key", F.col("value").alias("__value"), "error")
    hit = F.col("value").isNotNull()
    out = have.join(fresh, "key", "left").select(*requests.columns, F.when(hit, F.col("model")).when(F.col("__value").isNotNull(), model).alias("model"), F.coalesce("value", "__value").alias("value"), "error", hit.alias("hit"))
    out = save(out, "answers")
    asked, known = out.agg(F.count("*"), F.count("value")).first()
    if asked and not known:
        raise NoAnswers(f"none of {asked} requests has an answer")
    return out
