"""Language and toxicity: held-out rows, odd texts, missing training rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlab.llm import langid, toxicity
from postlab.llm.queries import op8_toxicity, op9_language
from tests.llm.fixture import documents, empty

ODD = [(1, None), (2, ""), (3, " 12 !"), (4, "a"), (5, "the " * 60000), (6, "漢字"), (None, "x y z")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").select("*", F.lit(1).alias("score"), F.lit(2).alias("_text"))


def test_language_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = op9_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 150 < len(held) < 350
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.01 and all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_texts(spark):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([
        ("the cat sat on the mat with the hat", "en"), ("there is nothing that they think", "en"),
        ("der hund und die katze sind nicht hier", "de"), ("ich bin ein wort und noch eins", "de"),
        (None, "fr"), ("...", "fr"), ("no language", None)])], "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in langid.predict(odd(spark), model).collect()}
    assert len(got) == len(ODD)
    for i in (1, 2, 3):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[5].lang_pred == "en" and got[6].lang_pred in model.languages and got[6].rejected
    left = langid.drop_rejected(odd(spark), model)
    assert left.columns == odd(spark).columns
    assert {r.doc_id for r in left.collect()} == {i for i, r in got.items() if not r.rejected}


def test_no_language_to_learn(spark):
    model = langid.fit(empty(spark))
    assert model.languages == []
    assert {(r.lang_pred, r.score, r.rejected) for r in langid.predict(odd(spark), model).collect()} == {("und", 0.0, True)}
    assert langid.predict(empty(spark), model).collect() == []


@pytest.mark.parametrize("number", [None, 7])
def test_languages_of_a_large_table_without_identifiers(spark, number):
    """More rows than twice the sample, identifiers missing or all the same; the third language is one text many times."""
    train = spark.createDataFrame(
        [(number, f"the cat number {i} sat on the mat with the hat", "en") for i in range(60)]
        + [(number, f"der hund {i} und die katze sind nicht hier", "de") for i in range(60)]
        + [(number, "le chat est sur la table avec le chien", "fr")] * 60, "doc_id long, text string, lang string")
    model = langid.fit(train, sample_rows=8)
    assert model.languages == ["de", "en", "fr"]
    got = langid.predict(train.select(F.monotonically_increasing_id().alias("doc_id"), "text", "lang"), model)
    assert [r.lang_pred for r in got.orderBy("doc_id").collect()] == ["en"] * 60 + ["de"] * 60 + ["fr"] * 60


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        langid.fit(documents(spark))


def test_centroids_separate_clusters():
    rng = np.random.default_rng(1)
    centers = np.eye(6)[:3]
    points = np.concatenate([c + rng.normal(0, 0.05, (20, 6)) for c in centers])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    assert np.allclose(np.sort((langid.cluster(points, 3) @ centers.T).max(axis=0)), 1, atol=0.01)
    assert len(langid.cluster(points[:2], 5)) == 2


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    caught = sum(r.predicted for r in held if r.toxic == 1) / sum(r.toxic for r in held)
    false = sum(r.predicted for r in held if r.toxic == 0) / sum(1 - r.toxic for r in held)
    assert caught > 0.85 and false < 0.03 and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_of_odd_texts_and_labels(spark):
    train = spark.createDataFrame(
        [(i, ["you are a moron", "what an idiot"][i % 2] if i % 3 == 0 else f"a fine day number {i}") for i in range(30)] + [(None, "x"), (99, None)],
        "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)] + [(None, 1), (99, 0), (5, None), (1, 0), (7, 9)],
                                   "doc_id long, toxic int")
    model = toxicity.fit(train, labels)
    got = {r.doc_id: r for r in toxicity.score(odd(spark), model).collect()}
    assert len(got) == len(ODD) and got[1].score == got[2].score == model.prior
    more = spark.createDataFrame([(1, "such an idiot"), (2, "a fine day")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(more, model).collect()} == {1: 1, 2: 0}
    assert toxicity.score(more.limit(0), model).collect() == []


def test_an_insult_of_few_toxic_rows_counts():
    """40 of 3,000 toxic rows have a bucket that no clean row has; a bucket of 2 rows is not clear."""
    sets = [np.array([5] + [9] * (i < 40) + [11] * (i < 2), dtype=np.uint32) for i in range(3000)] + [np.array([5], dtype=np.uint32)] * 3000
    ratio = toxicity.log_ratios(sets, np.repeat([1, 0], 3000))
    assert ratio[9] > 3 and ratio[5] == ratio[11] == 0


def test_toxicity_without_rows_of_a_label(spark):
    text = spark.createDataFrame([(1, "a text of words")], "doc_id long, text string")
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.score(text, toxicity.fit(text, one)).first().predicted == 1
    nothing = toxicity.fit(text, one.limit(0))
    assert toxicity.score(text, nothing).first().score == 0.5
