"""Answers that are stored, retried and missing."""

import pandas as pd
import pytest

from claimweave.operators.tables import Store
from claimweave.sources import responses


def test_answers_are_stored(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", responses.LAYOUT, 4)
    asked = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), ("c", 3)], "key string, n int")
    mark = tmp_path / "tried"

    def flaky(batch):
        """Answers b from the second attempt on, never c."""
        again = mark.exists()
        ok = (batch["key"] == "a") | ((batch["key"] == "b") & again)
        if (batch["key"] == "b").any():
            mark.touch()
        return pd.DataFrame({"key": batch["key"], "value": batch["key"].where(ok, None), "error": ok.map({True: None, False: "busy"})})

    change = store.begin()
    first = responses.answer(change, asked.coalesce(1), flaky, ["m"], "m", "1", attempts=3)
    assert store.table("responses") is None
    change.commit()
    assert sorted((r.key, r.value, r.model, r.error, r.hit) for r in first.collect()) == [("a", "a", "m", None, False), ("b", "b", "m", None, False), ("b", "b", "m", None, False), ("c", None, None, "busy", False)]
    assert sorted(r.key for r in store.table("responses").collect()) == ["a", "b"]
    again = responses.answer(store.begin(), asked, responses.no_extractor, ["m"], "m", "2")
    assert sorted((r.key, r.value, r.error, r.hit) for r in again.collect()) == [("a", "a", None, True), ("b", "b", None, True), ("b", "b", None, True), ("c", None, "no extractor", False)]
    with pytest.raises(responses.NoAnswers):
        responses.answer(store.begin(), asked.filter("key = 'c'"), responses.no_extractor, ["m"], "m", "3")
    assert responses.answer(store.begin(), asked.limit(0), responses.no_extractor, ["m"], "m", "3").collect() == []
