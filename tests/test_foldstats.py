"""Statistics of all training sides from one count, against counts of each side alone and against Spark's own stages."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import IDF, CountVectorizerModel, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from postlab.functions.chi2 import log_p_value
from postlab.operators import foldstats
from postlab.operators.folds import keyed_folds
from postlab.plans import catalog, models
from postlab.plans.components import fit_components
from postlab.plans.models import Plan
from postlab.plans.selection import FoldFeatures, bucket_stage

WIDTH = 64
PLAN = Plan(("tfidf", "dict"), top=20, tf_width=WIDTH, models=("logreg",), folds=3)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(150):
        s = int(rng.integers(3))
        stems = [f"w{int(w)}" for w in rng.integers(0, 60, 12)] + [f"c{s}"] * int(rng.integers(3)) + ["always"]
        scores = [float(rng.integers(4)), 0.0, float(s == 2)]
        rows.append((i, stems, scores, int(s != 1), s, i % 7 == 0))
    table = spark.createDataFrame(
        rows, "doc_id bigint, stems array<string>, scores array<double>, relevance int, sentiment int, dev boolean")
    vector = array_to_vector("scores")
    return keyed_folds(table.withColumn("dict", vector).withColumn("dictbins", vector), "doc_id", 3).cache()


def counts(data, k, holdout=None):
    return FoldFeatures(data, PLAN.base, WIDTH, foldstats.sides(k, "fold", holdout), ["fold", "dev"], ("relevance", "sentiment"))


@pytest.mark.parametrize("task", ["relevance", "sentiment"])
def test_each_side_equals_a_count_of_its_own(data, task):
    together = counts(data, 3, "dev")
    held = {0: F.col("fold") == 0, 1: F.col("fold") == 1, 2: F.col("fold") == 2, -2: F.col("dev"), -1: F.lit(False)}
    rows = together.ranked(task).collect()
    assert {r.side for r in rows} == set(held)
    for side, out in held.items():
        alone = counts(data.where(~out), 0)
        assert {r.feature: tuple(r)[1:] for r in rows if r.side == side} == {
            r.feature: tuple(r)[1:] for r in alone.ranked(task).collect()}
        assert together.chosen(task, 20)[side] == alone.chosen(task, 20)[-1]


@pytest.mark.parametrize("task", ["relevance", "sentiment"])
def test_selection_and_weights_equal_the_fitted_stages(data, task):
    labelled = bucket_stage(WIDTH).transform(data.withColumn(task, F.col(task).cast("double")))
    names = CountVectorizerModel.from_vocabulary([str(i) for i in range(WIDTH)], inputCol="_buckets", outputCol="tf")
    tf = names.transform(labelled)
    idf = IDF(inputCol="tf", outputCol="tfidf").fit(tf)
    base = VectorAssembler(inputCols=["tfidf", "dictbins"], outputCol="base").transform(idf.transform(tf))
    selected = UnivariateFeatureSelector(
        featuresCol="base", labelCol=task, outputCol="s", selectionMode="numTopFeatures",
    ).setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(20).fit(base).selectedFeatures
    chosen = counts(data, 0).chosen(task, 20)[-1]
    assert sorted(selected) == [b for b, _ in chosen.terms] + [WIDTH + d for d in chosen.dense]
    assert all(abs(w - idf.idf[b]) < 1e-12 for b, w in chosen.terms)
    ours = models.fit_features(data, PLAN, task).transform(data).orderBy("doc_id").select("features").collect()
    theirs = [np.asarray(r.base.toArray())[sorted(selected)] for r in base.orderBy("doc_id").collect()]
    assert np.allclose([r.features.toArray() for r in ours], theirs)


def test_p_values(spark):
    gamma = spark._jvm.org.apache.commons.math3.special.Gamma
    cases = [(s, d) for s in (0.0, 0.001, 0.5, 1.9, 2.0, 7.0, 100.0, 600.0) for d in (0, 1, 2, 3, 4, 9, 30, 201)]
    rows = spark.createDataFrame(cases, "s double, d bigint").select("s", "d", log_p_value(F.col("s"), F.col("d")).alias("p"))
    for r in rows.collect():
        want = math.log(gamma.regularizedGammaQ(r.d / 2, r.s / 2)) if r.d and r.s else 0.0
        assert abs(r.p - want) < 1e-9 * max(1.0, abs(want)), r


def test_scores_of_a_plan(data):
    found = catalog.Scores(data.drop("fold"), "doc_id").table(PLAN, "logreg")
    assert [(t, n) for t, n, _ in found] == [(t, n) for t in ("relevance", "sentiment") for n in range(-2, 3)]
    value = {(t, n): f for t, n, f in found}
    for task in ("relevance", "sentiment"):
        assert abs(value[task, -1] - np.mean([value[task, n] for n in range(3)])) < 1e-12
    held = data.where("fold = 1")
    model = models.fit(data.where("fold <> 1"), PLAN, "logreg", "sentiment")
    from postlab.plans.validation import score
    assert abs(score(model, held, "sentiment") - value["sentiment", 1]) < 1e-12


@pytest.mark.parametrize("sparse", [True, False])
def test_components_equal_exact_ones(spark, sparse):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 5)) * [9, 7, 5, 3, 2] @ rng.standard_normal((5, 40)) + 0.1 * rng.standard_normal((300, 40)) + 1
    if sparse:
        x[rng.random(x.shape) < 0.5] = 0
    from pyspark.ml.linalg import Vectors
    rows = [(Vectors.sparse(40, [(j, float(v)) for j, v in enumerate(r) if v]) if sparse else Vectors.dense(r),) for r in x]
    table = spark.createDataFrame(rows, ["v"]).repartition(7)
    found = fit_components(table, "v", 40, 4, passes=8)
    centred = x - x.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(found.variances, s[:4] ** 2 / 299, rtol=1e-6)
    assert np.linalg.norm(found.axes @ found.axes.T - vt[:4].T @ vt[:4]) < 1e-3
    assert np.allclose(found.axes.T @ found.axes, np.eye(4), atol=1e-10)


def test_components_of_odd_tables(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import StructField, StructType
    schema = StructType([StructField("v", VectorUDT())])
    assert fit_components(spark.createDataFrame([], schema), "v", 5, 2).axes.shape == (5, 0)
    same = spark.createDataFrame([(Vectors.dense([1.0, 2.0]),)] * 4 + [(None,)], schema)
    assert np.allclose(fit_components(same, "v", 2, 5).variances, 0)
