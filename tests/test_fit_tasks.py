"""What a fit sends with the tasks of its steps: no names of features, no more tasks than cores and memory ask for."""

from __future__ import annotations

import pytest
from pyspark.ml import Transformer
from pyspark.sql import functions as F

from postlab.plans import models
from postlab.plans.models import Plan

ROWS = [(i, [f"w{i % 5}", f"c{i % 2}"], i % 2) for i in range(40)]


@pytest.mark.parametrize("plan", [Plan(("grams",), models=("logreg",)), Plan(("tfidf",), top=3, tf_width=64, models=("logreg",))])
def test_training_rows_carry_no_feature_names(spark, monkeypatch, plan):
    seen = []

    class Fitted(Transformer):
        def fit(self, rows):
            seen.append(rows)
            return self

        def _transform(self, dataset):
            return dataset

    monkeypatch.setattr(models, "classifier", lambda kind, task, width, settings: Fitted())
    rows = spark.createDataFrame(ROWS, "doc_id bigint, stems array<string>, relevance int")
    model = models.fit(rows, plan, "logreg", "relevance")
    assert seen[0].schema["features"].metadata == {}
    assert "w3" not in seen[0].schema.json() and "_unit_1" not in seen[0].schema.json()
    expected = model.stages[0].transform(rows).select("relevance", "features")
    assert sorted(map(repr, seen[0].select(F.col("relevance").cast("int"), "features").collect())) == sorted(map(repr, expected.collect()))


def test_partitions_of_a_training_set():
    assert [models.n_partitions(n, 6) for n in (0, 1, 2000, 2001, 11_000, 20_000, 120_000, 120_001, 1_200_000)] == [1, 1, 1, 2, 6, 6, 6, 7, 60]
    assert models.n_partitions(1_200_000, 2000) == 600  # and no core has fewer than FIT_ROWS rows
