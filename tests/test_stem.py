"""Stemmers on word lists written from the published rules."""

import pytest
from pyspark.sql import functions as F

from postlab.functions.stem import stem_english, stem_german
from postlab.operators import terms

GERMAN = {
    "verspätungen": "verspat", "verspätet": "verspatet", "züge": "zug", "bahnen": "bahn",
    "freundlichkeit": "freundlich", "pünktlichkeit": "punktlich", "straße": "strass", "ab": "ab",
    "es": "es", "kaufen": "kauf", "treue": "treu", "erlebnisse": "erlebnis", "bedürfnisse": "bedurfnis",
    "schnellsten": "schnell", "kleinstes": "klein", "notwendigkeit": "notwend", "langsamkeit": "langsam",
    "durchsagen": "durchsag", "ärgerlich": "arg", "<<<tokenbahnhashtag>>>": "<<<tokenbahnhashtag>>>",
}
ENGLISH = {
    "running": "run", "hoping": "hope", "flies": "fli", "ties": "tie", "skies": "sky",
    "generously": "generous", "gently": "gentl", "news": "news", "consolingly": "consol",
    "knightly": "knight", "happily": "happili", "national": "nation", "relational": "relat",
    "conditional": "condit", "hopefulness": "hope", "sensibility": "sensibl", "cry": "cri", "by": "by",
    "say": "say", "exceed": "exceed", "feed": "feed", "agreed": "agre", "hopping": "hop",
    "falling": "fall", "failing": "fail", "filing": "file", "abilities": "abil", "analogies": "analog",
    "communication": "communic", "youth": "youth", "controlling": "control", "rate": "rate",
    "cease": "ceas", "adjustable": "adjust",
}


@pytest.mark.parametrize("stemmer,words", [(stem_german, GERMAN), (stem_english, ENGLISH)])
def test_golden_stems(spark, stemmer, words):
    df = spark.createDataFrame(list(words.items()), "word string, want string")
    rows = df.select("word", "want", stemmer(F.col("word")).alias("got")).collect()
    assert {r["word"]: r["got"] for r in rows} == words


def test_filter_on_stem_stays_small(spark):
    """A filter pushed below the projection must not multiply the expression."""
    df = spark.createDataFrame([("bahnen",)], "word string").select(stem_german(F.col("word")).alias("s"))
    assert df.where("s <> 'x'").where("s <> 'y'").count() == 1


def test_documents_keep_order_and_empty_ones(spark):
    docs = spark.createDataFrame(
        [(1, ["bahnen", "züge", "bahnen"]), (2, []), (3, ["züge"])], "doc_id bigint, tokens array<string>")
    rows = terms.stem_tokens(docs, ["doc_id"], stem_german).collect()
    assert {r["doc_id"]: r["stems"] for r in rows} == {1: ["bahn", "zug", "bahn"], 2: [], 3: ["zug"]}


def test_groups(spark):
    words = spark.createDataFrame([("bahn", 3), ("bahnen", 2), ("zug", 1)], "word string, n bigint")
    rows = terms.stem_groups(words, stem_german).collect()
    assert {(r["stem"], r["n_words"], r["n"]) for r in rows} == {("bahn", 2, 5), ("zug", 1, 1)}
