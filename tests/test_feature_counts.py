"""What the feature table has ready for the fits: hashed stem counts, lexicon tokens, words counted once; no null list goes to Python."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlab.operators import foldstats, parts, terms
from postlab.operators.lexicon import part_unknown
from postlab.plans import models
from postlab.plans.features import document_features
from postlab.plans.models import Plan
from postlab.session import stored

DOCS = [(1, ["a", "b", "x", "a"]), (2, []), (3, None), (4, ["x", "c", None]), (5, ["b"]), (5, ["a", "a"]), (None, ["a"]),
        *[(i, ["a", "b", f"w{i % 7}", "a", "b\x1fc"]) for i in range(10, 40)]]
WIDTHS = (16, 64)


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, tokens array<string>").withColumn("scores", F.array(F.lit(1.0)))


@pytest.fixture()
def features(spark, docs):
    vectors = spark.createDataFrame([("a", [1.0, 2.5]), ("b", [3.0, 5.0])], "word string, vector array<double>")
    entries = spark.createDataFrame([("a", "positive", 0)], "word string, polarity string, idx int")
    words = stored(terms.vocabulary(docs))

    def made(given, **more):
        return document_features(given, "doc_id", vectors=vectors, dim=2, lexicon=entries, dictionary=vectors.select("word"),
                                 words=words, stemmer=lambda w: F.upper(w), **more)

    return made


@pytest.mark.parametrize("dealt", [False, True])
def test_hashed_counts_equal_those_of_the_stems(docs, features, dealt):
    made = stored(features(parts.deal(docs, ["doc_id"], 200) if dealt else docs, widths=WIDTHS))
    rows = made.withColumn("_row", F.monotonically_increasing_id())
    for width in WIDTHS:
        found = foldstats.row_bucket_counts(rows, ["_row"], width)
        expected = foldstats.row_bucket_counts(rows.drop(*map(foldstats.counts_column, WIDTHS)), ["_row"], width)
        assert found.dtypes == expected.dtypes
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    plain = features(docs)
    assert [c for c in made.columns if c not in plain.columns] == ["tf16", "tf64"]
    assert sorted(map(repr, made.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))


def test_kept_tokens_equal_an_intersection(docs, features):
    entries = ["b", "a", "zz"]
    made = features(docs, kept=entries).select("doc_id", "tokens")
    expected = features(docs).select("doc_id", F.array_intersect("tokens", F.array(*map(F.lit, entries))).alias("tokens"))
    assert sorted(map(repr, made.collect())) == sorted(map(repr, expected.collect()))


def test_term_weights_from_counts_equal_those_from_stems(docs, features):
    made = stored(features(docs, widths=WIDTHS).where("doc_id is not null").withColumn("relevance", F.col("doc_id") % 3 % 2))
    plan = Plan(("tfidf",), top=5, tf_width=64, models=("logreg",))
    both = [models.fit_features(d, plan, "relevance").transform(d).select("doc_id", "features").collect()
            for d in (made, made.drop(*map(foldstats.counts_column, WIDTHS)))]
    assert sorted(map(repr, both[0])) == sorted(map(repr, both[1]))
    hashes = [s for s in models.fit_features(made, plan, "relevance").stages if "SQLTransformer" in type(s).__name__]
    assert not hashes


def test_words_of_stored_parts_are_counted_once(docs):
    dealt = parts.deal(docs, ["doc_id"], 200)
    words = Counter(t for _, tokens in DOCS for t in tokens or [] if t is not None)
    rows = Counter(t for _, tokens in DOCS for t in {*(tokens or [])} if t is not None)
    assert {r.word: r.n for r in terms.vocabulary(dealt).collect()} == words
    assert {r.term: r.df for r in terms.document_frequency(dealt).collect()} == rows
    assert terms.vocabulary(dealt).dtypes == terms.vocabulary(docs).dtypes
    assert terms.document_frequency(dealt).dtypes == terms.document_frequency(docs).dtypes
    plan = terms.vocabulary(dealt)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_lists_that_a_row_has_not_are_empty_and_not_null(spark, docs):
    packed = parts._packed(docs, "tokens")
    assert packed.where("_line is not null and tokens is null").count() == 0
    vectors = spark.createDataFrame([("a", [1.0, 2.5]), ("b", [0.1, 5.0])], "word string, vector array<double>")
    names = spark.createDataFrame([("a", ["x"])], "word string, names array<string>")
    united = parts._united([vectors, names]).toArrow()
    assert not any(united[c].null_count for c in ("vector", "_single", "names"))
    own = united.filter(pa.compute.equal(united["_table"], 0))
    assert sorted(parts._long(own)["vector"].to_pylist()) == [[0.1, 5.0], [1.0, 2.5]]


def test_placeholders_are_looked_at_once_per_word():
    own = pa.table({"doc_id": [1, 2], "tokens": [["a", "<<<tokentime>>>", "u", "u"], ["<<<tokentime>>>"]]})
    found = parts._matched(own, pa.table({"word": ["a"]}), ["doc_id"], "tokens")
    n, u = part_unknown(found)
    assert n.tolist() == [4, 1] and u.tolist() == [2, 0]
    assert "word" not in found.__dict__
