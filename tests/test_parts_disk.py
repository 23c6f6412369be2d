"""What goes to disk on the way to the feature table: slices of parts, vectors, labels, counts of rows, shuffle files."""

from __future__ import annotations

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlab.operators import foldstats, parts, terms
from postlab.operators import wordvectors as wv
from postlab.plans.features import document_features
from postlab.session import stored

DOCS = [(1, ["a", "b", "x", "a"]), (2, []), (3, None), (4, ["x", "c", None]), (5, ["b"]), (5, ["a", "a"]), (None, ["a"])]
LABELS = [(1, 1, 0), (5, 0, 1), (5, 1, 2), (7, 0, 0), (None, 1, 1)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, tokens array<string>")


@pytest.fixture()
def vectors(spark):
    return spark.createDataFrame([("a", [1.0, 2.5]), ("b", [3.0, 5.0]), ("b", [0.1, 4.0]), ("x", [1e300, float("nan")])],
                                 "word string, vector array<double>")


def features(spark, docs, vectors, labels=None):
    entries = spark.createDataFrame([("a", "positive", 0)], "word string, polarity string, idx int")
    return document_features(
        docs.withColumn("scores", F.array(F.lit(1.0))), "doc_id", vectors=vectors, dim=2, lexicon=entries,
        dictionary=vectors.select("word"), words=terms.vocabulary(docs).localCheckpoint(), stemmer=lambda w: F.upper(w), labels=labels)


def test_slices_of_a_part_give_the_same(spark, docs, vectors, monkeypatch):
    def rows():
        found = [wv.mean_vectors(docs, vectors, ["doc_id"], 2), features(spark, docs, vectors), terms.tfidf(docs, ["doc_id"], F.lit(7))]
        return [sorted(map(repr, f.collect())) for f in found]

    whole = rows()
    monkeypatch.setattr(parts, "WORK_TOKENS", 2)
    assert rows() == whole
    table = pa.table({"doc_id": [1, 2, 1, 3], "tokens": [["a", "b"], ["c"], ["d"], None]})
    assert sorted(s["doc_id"].to_pylist() for s in parts._slices(table, ["doc_id"], "tokens")) == [[1, 1], [2], [3]]


def test_vectors_go_in_single_precision_where_nothing_is_lost(vectors):
    short = {(r.word, r._single is not None, r.vector is not None) for r in parts._short(vectors).collect()}
    assert short == {("a", True, False), ("b", True, False), ("b", False, True), ("x", False, True)}
    back = [v for v in parts._long(parts._short(vectors).toArrow())["vector"].to_pylist()]
    assert repr(back) == repr([r.vector for r in vectors.collect()])


def test_labels_join_in_the_parts(spark, docs, vectors):
    labels = spark.createDataFrame(LABELS, "doc_id int, relevance int, sentiment int")
    expected = features(spark, docs, vectors).join(labels, "doc_id", "left")
    found = features(spark, docs, vectors, labels)
    assert found.columns == expected.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))
    assert "doc_id" not in "".join(line.split("hashpartitioning(")[1].split(")")[0] for line in plan(found).splitlines() if "hashpartitioning(" in line)


def test_buckets_of_rows_are_counted_where_they_lie(spark, docs, monkeypatch):
    monkeypatch.setattr(foldstats, "COUNT_ROWS", 2)
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    keys = ["_row", "doc_id"]
    found = foldstats.row_bucket_counts(rows, keys, 16, "tokens")
    expected = foldstats.bucket_counts(rows, keys, 16, "tokens")
    assert found.dtypes == expected.dtypes and sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))
    assert "Exchange" not in plan(found)


def test_a_stored_table_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)

    def files():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {str(f) for f in manager.getAllFiles().mkString("\n").split("\n") if os.path.basename(str(f)).startswith("shuffle_")}

    held = files()
    assert stored(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    left = {f for f in files() - held if f.endswith(".data")}
    assert len(left) <= 1  # that of the count here
    assert spark.conf.get(key) == before
