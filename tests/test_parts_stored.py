"""Documents that are stored by part: no shuffle of them beside the result, rounds of parts, the same rows as without."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from postlab.operators import parts, terms
from postlab.plans.features import document_features
from postlab.session import shared_folder, stored, stored_in_turn

DOCS = [(1, ["a", "b", "x", "a"]), (2, []), (3, None), (4, ["x", "c", None]), (5, ["b"]), (5, ["a", "a"]), (None, ["a"]),
        *[(i, ["a", "b", f"w{i % 7}"]) for i in range(10, 60)]]
LABELS = [(1, 1, 0), (5, 0, 1), (5, 1, 2), (7, 0, 0), (None, 1, 1), (20, 1, 2)]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, tokens array<string>").withColumn("scores", F.array(F.lit(1.0)))


@pytest.fixture()
def features(spark, docs):
    vectors = spark.createDataFrame([("a", [1.0, 2.5]), ("b", [3.0, 5.0]), ("b", [0.1, 4.0])], "word string, vector array<double>")
    entries = spark.createDataFrame([("a", "positive", 0)], "word string, polarity string, idx int")
    labels = stored(spark.createDataFrame(LABELS, "doc_id bigint, relevance int, sentiment int"))
    words = stored(terms.vocabulary(docs))
    return lambda given: document_features(
        given, "doc_id", vectors=vectors, dim=2, lexicon=entries, dictionary=vectors.select("word"), words=words,
        stemmer=lambda w: F.upper(w), labels=labels)


def test_stored_documents_are_not_moved_for_their_words(spark, docs, features):
    dealt = parts.deal(docs, ["doc_id"], 200)
    made = features(dealt)
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and "Exchange" not in plan


def test_each_part_has_a_bucket_of_its_own(docs, monkeypatch):
    monkeypatch.setattr(parts, "PART_TOKENS", 8)
    dealt = parts.deal(docs, ["doc_id"], 200)
    placed = dealt.frame.select(F.pmod(F.hash("_part"), F.lit(dealt.parts)).alias("bucket"), "_part").distinct().collect()
    assert dealt.parts == len(dealt.names) == 25
    assert len({r.bucket for r in placed}) == len(placed) == len({r._part for r in placed}) > 10


def test_rounds_of_stored_parts_give_the_same_rows(spark, docs, features, monkeypatch):
    expected = sorted(map(repr, features(docs).collect()))
    monkeypatch.setattr(parts, "PART_TOKENS", 8)
    dealt = parts.deal(docs, ["doc_id"], 200)
    assert sorted(map(repr, dealt.docs.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
    rounds = dealt.rounds()
    assert 1 < len(rounds) <= parts.ROUNDS
    assert sorted(n for r in rounds for n in r.names) == sorted(dealt.names)
    folder = os.path.dirname(shared_folder(spark, "x")).removeprefix("file:")
    before = set(os.listdir(folder))
    made = stored_in_turn([lambda r=r: features(r) for r in rounds], "made")
    assert sorted(map(repr, made.collect())) == expected
    assert [f.split("-")[0] for f in set(os.listdir(folder)) - before] == ["made"]


def test_documents_dealt_by_other_keys_are_refused(docs):
    dealt = parts.deal(docs, ["doc_id"], 200)
    with pytest.raises(ValueError, match="dealt out"):
        parts.in_parts(dealt, ["other"], [], lambda: None, "doc_id bigint")
