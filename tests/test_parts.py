"""Lookups by parts of documents, nearest neighbours by products, the classifier's vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlab.functions.stem import stem_german
from postlab.operators import lexicon, neighbors, subwords, terms
from postlab.operators import wordvectors as wv
from postlab.plans import embedtext
from postlab.plans.features import document_features

VECTORS = [("a", [1.0, 2.0]), ("b", [3.0, 5.0]), ("b", [4.0, 4.0]), ("c", None)]
DOCS = [(1, ["a", "b", "x", "a"]), (2, []), (3, None), (4, ["x", "c"]), (5, ["b"]), (5, ["a", "a"]), (None, ["a"])]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, tokens array<string>")


@pytest.fixture()
def vectors(spark):
    return spark.createDataFrame(VECTORS, "word string, vector array<double>")


def test_no_row_per_token_is_moved(spark, docs, vectors):
    entries = spark.createDataFrame([("a", "positive", 0)], "word string, polarity string, idx int")
    scored = docs.withColumn("scores", F.array(F.lit(1.0)))
    frames = [
        wv.mean_vectors(docs, vectors, ["doc_id"], 2), wv.known_tokens(docs, vectors, ["doc_id"]),
        wv.padded_sequences(docs, vectors, ["doc_id"], 2, 2), lexicon.lexicon_counts(docs, entries, ["doc_id"]),
        lexicon.misspelling_ratio(docs, vectors, ["doc_id"]), terms.stem_tokens(docs, ["doc_id"], stem_german, terms.vocabulary(docs).localCheckpoint()),
        document_features(scored, "doc_id", vectors=vectors, dim=2, lexicon=entries, dictionary=vectors.select("word"),
                          words=terms.vocabulary(docs).localCheckpoint(), stemmer=stem_german),
        subwords.composed_vectors(docs.select(F.lit("word").alias("word")), vectors.withColumnRenamed("word", "bucket"), 2),
    ]
    for frame in frames:
        assert "Generate" not in plan(frame)


def test_means_of_repeated_keys_and_words(docs, vectors):
    found = sorted(((r.doc_id, r.mean_vector) for r in wv.mean_vectors(docs, vectors, ["doc_id"], 2).collect()), key=str)
    five = [(3 + 4 + 1 + 1) / 4, (5 + 4 + 2 + 2) / 4]
    assert found == sorted([
        (1, [(1 + 1 + 3 + 4) / 4, (2 + 2 + 5 + 4) / 4]), (2, [0.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 0.0]), (5, five), (5, five),
        (None, [0.0, 0.0])], key=str)
    known = {r.doc_id: r.n_known for r in wv.known_tokens(docs, vectors, ["doc_id"]).collect()}
    assert known[1] == 4 and known[5] == 4 and known[None] == 1 and 2 not in known


def test_means_skip_missing_entries(spark):
    docs = spark.createDataFrame([(1, ["a", "b"])], "doc_id bigint, tokens array<string>")
    vectors = spark.createDataFrame([("a", [1.0, None]), ("b", [3.0, None])], "word string, vector array<double>")
    assert wv.mean_vectors(docs, vectors, ["doc_id"], 2).first().mean_vector == [2.0, None]


def test_composed_vectors_leave_missing_entries_out(spark):
    grams = [r.bucket for r in subwords.word_buckets(spark.createDataFrame([("ab",)], "word string")).collect()]
    table = spark.createDataFrame([(grams[0], [1.0, 2.0]), (grams[1], [3.0, None])], "bucket string, vector array<double>")
    words = spark.createDataFrame([("ab",), ("zz",)], "word string")
    assert [(r.word, r.vector) for r in subwords.composed_vectors(words, table, 2).collect()] == [("ab", [2.0, 2.0])]


def test_stems_and_sequences_of_repeated_keys(spark, docs, vectors):
    stems = terms.stem_tokens(docs, ["doc_id"], lambda w: F.upper(w))
    assert sorted(((r.doc_id, r.stems) for r in stems.collect()), key=str) == sorted([
        (1, ["A", "B", "X", "A"]), (2, []), (3, []), (4, ["X", "C"]), (5, ["A", "B", "A"]), (5, ["A", "B", "A"]), (None, [])], key=str)
    rows = {r.doc_id: r.sequence for r in wv.padded_sequences(docs, vectors, ["doc_id"], 3, 2).collect()}
    assert rows[1] == [1, 2, 3, 5, 4, 4] and rows[5] == [1, 2, 3, 5, 4, 4] and rows[None] == [1, 2, 0, 0, 0, 0] and 4 not in rows


def test_misspelling_counts_repeated_keys_together(spark, docs):
    found = lexicon.misspelling_ratio(docs, spark.createDataFrame([("a",)], "word string"), ["doc_id"])
    rows = {(r.doc_id, r.n_tokens, r.n_unknown, round(r.ratio, 6)) for r in found.collect()}
    assert {(1, 4, 2, 0.5), (2, 0, 0, 0.0), (5, 3, 1, 0.333333), (None, 0, 0, 0.0)} <= rows


@pytest.mark.parametrize("k", [1, 5])
def test_products_choose_what_all_distances_do(k):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(5000, 8))
    values[100:140] = values[7]
    ids, q = np.arange(5000) * 3, np.concatenate([values[:50], rng.normal(size=(50, 8)), values[100:110]])
    found = neighbors._closest(q, ids, values, (values ** 2).sum(axis=1), k)
    assert all((a == b).all() for a, b in zip(found, neighbors._plain(q, ids, values, k)))


def test_nearest_with_odd_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [1e200, 0.0]), (3, [math.nan, 1.0]), (4, [0.0, 1.0]), (5, [0.0, 1.0])]
    points = spark.createDataFrame(rows, "id bigint, vector array<double>")
    found = {(r.id, r.rank): r.neighbour for r in neighbors.nearest(points, points, 2).collect()}
    assert found[1, 1] == 1 and found[1, 2] == 4 and found[5, 1] == 4 and found[5, 2] == 5 and found[3, 1] == 1


def test_first_vectors_are_never_broadcast(spark, monkeypatch):
    plans, keep = [], embedtext.stored
    monkeypatch.setattr(embedtext, "stored", lambda df, name: (plans.append(plan(df)) if name == "vectors" else None) or keep(df, name))
    rows = [(i, ["good" if i % 2 else "bad", f"w{i}"], i % 2) for i in range(20)]
    embedtext.fit(spark.createDataFrame(rows, "doc_id bigint, stems array<string>, label int"), "doc_id", "stems", "label", 2,
                  embedtext.Settings(dim=4, epochs=2))
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)
