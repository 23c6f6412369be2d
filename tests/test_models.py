"""Plans, cross-validation and saved models on a small separable corpus."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from postlab.functions.stem import stem_german
from postlab.operators.terms import vocabulary
from postlab.plans import catalog, features, models, validation
from postlab.plans.models import Plan

SMALL = {
    "bucket": 1 << 10, "gbt": {"trees": 3, "depth": 3}, "mlp": {"hidden": [8], "iterations": 10},
    "svc": {"iterations": 10}, "logreg": {"iterations": 10}}
WORDS = {0: ["zug", "verspätung", "schlecht"], 1: ["bahn", "pünktlich", "gut"], 2: ["wetter", "fussball", "essen"]}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for i in range(90):
        c = i % 3
        tokens = [WORDS[c][(i + j) % 3] for j in range(3)] + ["heute", f"wort{'abcdefg'[i % 7]}"]
        rows.append((i, tokens, [float(c), float(i % 5), 3.0], int(c != 2), c))
    return spark.createDataFrame(
        rows, "doc_id bigint, tokens array<string>, scores array<double>, relevance int, sentiment int").cache()


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(
        [("gut", "positive", 0), ("schlecht", "negative", 0)], "word string, polarity string, idx int")


@pytest.fixture(scope="module")
def table(spark, corpus, lexicon):
    words = vocabulary(corpus)
    vectors = words.join(spark.createDataFrame(
        [(w, [float(c), float(k)]) for c, ws in WORDS.items() for k, w in enumerate(ws)],
        "word string, vector array<double>"), "word")
    clusters = features.fit_clusters(vectors, k=3, seed=1)
    blocks = features.document_features(
        corpus.select("doc_id", "tokens", "scores"), "doc_id", vectors=vectors, dim=2, lexicon=lexicon,
        dictionary=words.where("word like 'z%' or n > 1"), words=words, stemmer=stem_german, clusters=clusters)
    return blocks.join(corpus.select("doc_id", "relevance", "sentiment"), "doc_id").cache()


def f1(table, plan, kind, task):
    model = models.fit(table, plan, kind, task, ["gut", "schlecht"])
    rows = models.predict(model, table, "doc_id").collect()
    assert len(rows) == 90 and {r["prediction"] for r in rows} <= {0.0, 1.0, 2.0}
    return validation.score(model, table, task)


@pytest.mark.parametrize("task", ["relevance", "sentiment"])
@pytest.mark.parametrize("name,kind", [
    ("submit_embeddings", "gbt"), ("submit_terms", "gbt"), ("linear_text", "logreg"), ("bare_terms", "svc"),
    ("bare_terms", "logreg"), ("scores_only", "mlp"), ("terms_lexicon_clusters", "gbt"),
])
def test_plans_learn_a_separable_corpus(table, name, kind, task):
    plan = catalog.with_settings(catalog.PLANS[name], **SMALL)
    assert f1(table, plan, kind, task) > 0.9


def test_components_and_bigrams(table):
    plan = Plan(("tfidf",), ("lex", "dict", "spell"), pca=5, tf_width=64, settings=SMALL)
    assert f1(table, plan, "logreg", "relevance") > 0.9
    assert f1(table, Plan(("grams",), settings={**SMALL, "word_ngrams": 2}), "logreg", "relevance") > 0.9


def test_every_named_plan_builds_its_stages(table):
    for plan in catalog.PLANS.values():
        for task in plan.tasks:
            _, base, extra = models.feature_stages(plan, ["gut"])
            dense = [b for b in plan.base if b != "tfidf"]
            assert base == (["_dense"] if "tfidf" in plan.base and dense else [] if "tfidf" in plan.base else base), task
            assert len(extra) >= len(plan.extra), task
    assert len(catalog.PLANS) == 22


#: (trees, depth) for sentiment and relevance, hidden layers and iterations of the perceptron, by plan.
SETTINGS = {
    "submit_embeddings": ((30, 10), (100, 10), None), "submit_terms": ((30, 10), (100, 10), None),
    "compare_terms_dict": ((30, 10), (100, 10), ([500], 100)), "compare_terms": ((30, 10), (100, 10), ([500], 100)),
    "compare_terms_spell": ((30, 10), (100, 10), ([500], 100)), "compare_embeddings": ((30, 10), (100, 10), ([], 100)),
    "compare_embeddings_dict": ((30, 10), (100, 10), ([], 100)), "compare_embeddings_lex": ((30, 10), (100, 10), ([], 100)),
    "compare_embeddings_dict_lex": ((30, 10), (100, 10), ([], 100)), "bare_terms": ((20, 5), (20, 5), ([500], 100)),
    "terms_lexicon_clusters": ((100, 10), (100, 10), None), "terms_components": ((20, 5), (20, 5), ([100], 200)),
    "embeddings": ((20, 10), (20, 5), ([], 100)), "embeddings_clusters": ((20, 5), None, None),
    "embeddings_clusters_spell": ((20, 8), None, None), "scores_only": (None, None, ([50], 100)),
}


@pytest.mark.parametrize("name", sorted(SETTINGS))
def test_settings_of_the_plans(spark, name):
    sentiment, relevance, perceptron = SETTINGS[name]
    plan = catalog.PLANS[name]
    if sentiment:
        model = models.classifier("gbt", "sentiment", 5, plan.settings).getClassifier()
        assert (model.getMaxIter(), model.getMaxDepth()) == sentiment
    if relevance:
        model = models.classifier("gbt", "relevance", 5, plan.settings)
        assert (model.getMaxIter(), model.getMaxDepth()) == relevance
    if perceptron:
        model = models.classifier("mlp", "sentiment", 5, plan.settings)
        assert (model.getLayers(), model.getMaxIter()) == ([5, *perceptron[0], 3], perceptron[1])
    assert "spell" not in plan.extra or plan.pca or name == "embeddings_clusters_spell"


def test_selection_passes_unrounded_values(table):
    plan = Plan(("dict",), top=3)
    rows = table.select("doc_id", "relevance", F.transform(vector_to_array("dict"), lambda v: v + 1234.56).alias("d"))
    rows = rows.select("doc_id", F.col("relevance").cast("double").alias("relevance"), array_to_vector("d").alias("dict"),
                       array_to_vector(F.transform("d", features.two_digits)).alias("dictbins"))
    seen = models.fit_features(rows, plan, "relevance").transform(rows).select("features", "dict").collect()
    assert all(r["features"].toArray().tolist() == r["dict"].toArray().tolist() for r in seen)


def test_default_settings():
    gbt = models.classifier("gbt", "relevance", 5, {})
    assert (gbt.getMaxIter(), gbt.getMaxDepth()) == (100, 10)
    ovr = models.classifier("gbt", "sentiment", 5, {}).getClassifier()
    assert (ovr.getMaxIter(), ovr.getMaxDepth()) == (30, 10)
    assert models.classifier("mlp", "sentiment", 5, {}).getLayers() == [5, 500, 3]


def fits(name="one"):
    plan = catalog.with_settings(catalog.PLANS["scores_only"], **SMALL)
    return {name: lambda train: models.fit(train, plan, "logreg", "relevance")}


def test_cross_validation(table):
    data = table.select("doc_id", "dict", "relevance")
    rows = validation.cross_validate(data, {**fits("a"), **fits("b")}, "relevance", "doc_id", 3, parallelism=2)
    found = rows.collect()
    assert sorted((r["param_set"], r["fold"]) for r in found) == [(p, k) for p in "ab" for k in range(3)]
    means = {r["param_set"]: r["average"] for r in validation.mean_metric(rows).collect()}
    assert means["a"] == pytest.approx(sum(r["f1"] for r in found if r["param_set"] == "a") / 3)


def test_augmentation_only_trains(table, spark):
    """Wrong labels on the training side spoil the fit; the validation side never holds those rows."""
    data = table.select("doc_id", "dict", "relevance")
    seen = []

    def counting(train):
        seen.append(train.count())
        return fits()["one"](train)

    extra = data.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("relevance", 1 - F.col("relevance"))
    many = extra.unionByName(extra).unionByName(extra)
    spoiled = validation.cross_validate(data, {"x": counting}, "relevance", "doc_id", 2, augmentation=many)
    clean = validation.cross_validate(data, fits(), "relevance", "doc_id", 2)
    assert sum(seen) == 90 + 2 * 270
    assert spoiled.agg(F.max("f1")).head()[0] < 0.5 < clean.agg(F.min("f1")).head()[0]


def test_paired_folds(table):
    data = table.select("doc_id", "dict", "relevance")
    train, other = data.where("doc_id < 60"), data.where("doc_id >= 60")
    assert validation.cross_validate(train, fits(), "relevance", "doc_id", 2, validation=other).count() == 2
    assert validation.holdout(train, other, fits()["one"], "relevance") > 0.9


def test_saved_model(table, tmp_path):
    plan = catalog.with_settings(catalog.PLANS["scores_only"], **SMALL)
    model = models.fit(table, plan, "logreg", "relevance")
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a, b = [sorted(models.predict(m, table, "doc_id").collect()) for m in (model, again)]
    assert a == b


def test_submission(table, corpus):
    plan = catalog.with_settings(catalog.PLANS["submit_embeddings"], **SMALL)
    texts = corpus.select("doc_id", F.array_join("tokens", " ").alias("text"))
    rows = catalog.submit(table, table.where("doc_id < 9"), texts, plan, "sentiment", "doc_id",
                          lexicon_words=["gut", "schlecht"]).collect()
    assert len(rows) == 9
    assert {(int(r["id"]) % 3, r["sentiment"], r["relevance"]) for r in rows} == {
        (0, "negative", "unknown"), (1, "neutral", "unknown"), (2, "positive", "unknown")}


def test_cluster_features_are_one_hot(table):
    rows = table.select("km").collect()
    assert all(r["km"].size == 3 and sum(r["km"].toArray()) == 1.0 for r in rows)


def test_word_vectors_feed_sequences(spark, corpus):
    vectors = features.fit_word_vectors(corpus, dim=4, min_count=2, seed=1)
    assert vectors.where(F.size("vector") == 4).count() == vectors.count() > 5


def test_two_digits(spark):
    df = spark.createDataFrame([(0.0,), (7.0,), (42.0,), (1234.0,), (98765.0,)], "x double")
    assert [r[0] for r in df.select(features.two_digits(F.col("x"))).collect()] == [0.0, 7.0, 42.0, 1200.0, 99000.0]


def test_scores_as_vector(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert df.select(array_to_vector("v").alias("v")).head()["v"].toArray().tolist() == [1.0, 2.0]


def test_scores_of_a_plan(table):
    plan = catalog.with_settings(catalog.PLANS["embeddings"], **SMALL)
    scores = catalog.Scores(table.withColumn("dev", F.col("doc_id") % 5 == 0), "doc_id", ["gut", "schlecht"])
    rows = scores.table(plan, "logreg")
    found = {(task, fold): f1 for task, fold, f1 in rows}
    assert len(rows) == 14 and set(found) == {(t, f) for t in ("relevance", "sentiment") for f in range(-2, 5)}
    for task in ("relevance", "sentiment"):
        assert found[task, -1] == pytest.approx(sum(found[task, f] for f in range(5)) / 5)
        assert found[task, -2] > 0.9


def test_every_plan_and_model_that_finishes_has_scores():
    import __spark_entry__ as entry

    def takes_minutes(plan, kind):
        own = {**plan.settings, **plan.settings.get(kind, {})}
        return "grams" in plan.base or (kind == "gbt" and own.get("trees", 100) >= 100)

    every = {f"scores_{name}_{kind}_{task}": takes_minutes(plan, kind)
             for name, plan in catalog.PLANS.items() for kind in plan.models for task in plan.tasks}
    registered = [n for n in entry.queries() if n.startswith("scores_") and n != "scores_only_confusion"]
    assert set(registered) == {n for n, slow in every.items() if not slow}
    assert list(entry.queries())[-len(registered):] == registered  # last in the catalogue



def test_scores_go_on_after_a_lost_run(spark, table, tmp_path, monkeypatch):
    """A run that breaks off after four fits; the next one fits the other two only and has all scores."""
    data = table.withColumn("dev", F.col("doc_id") % 5 == 0)
    plan = Plan(("dict",), models=("logreg",), settings=SMALL)
    fitted, whole = [], catalog.fit

    def counted(*args):
        if len(fitted) == 4:
            raise RuntimeError("driver lost")
        fitted.append(args[3])
        return whole(*args)

    folder = str(tmp_path / "scores")
    monkeypatch.setattr(catalog, "fit", counted)
    with pytest.raises(RuntimeError):
        catalog.Scores(data, "doc_id", log=folder).table(plan, "logreg", ("relevance",), parallelism=1)
    assert len(catalog.ScoreLog(spark, folder).known()) == 4
    fitted.clear()
    rows = catalog.Scores(data, "doc_id", log=folder).table(plan, "logreg", ("relevance",), parallelism=1)
    assert len(fitted) == 2 and [n for _, n, _ in rows] == [-2, -1, 0, 1, 2, 3, 4]
    fitted.clear()
    again = catalog.Scores(data, "doc_id", log=folder).table(plan, "logreg", ("relevance",))
    assert again == rows and not fitted
    monkeypatch.setattr(catalog, "fit", whole)
    fresh = catalog.Scores(data, "doc_id").table(plan, "logreg", ("relevance",))
    assert [f for _, _, f in fresh] == pytest.approx([f for _, _, f in rows])
