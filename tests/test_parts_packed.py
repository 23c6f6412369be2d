"""Documents on their way to parts, term weights by parts, and what a part holds of sequences."""

from __future__ import annotations

from collections import Counter, defaultdict
from math import log

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from postlab.operators import parts, terms
from postlab.operators import wordvectors as wv
from postlab.testtables import Tables

DOCS = [
    (1, ["a", "b", "a"]), (2, []), (3, None), (4, ["", "b"]), (5, [""]), (6, ["a\x1fb", "c"]), (7, ["a", None, "c"]),
    (8, ["c"]), (8, ["c", "d"]), (None, ["a"]), (None, ["a", "e"]), (9, [None]),
]


def _docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, tokens array<string>")


def test_tokens_come_back_as_they_were(spark):
    packed = parts._packed(_docs(spark), "tokens").toArrow()
    whole = parts._unpacked(packed["_line"].combine_chunks(), packed["tokens"].combine_chunks())
    back = sorted(zip(packed["doc_id"].to_pylist(), whole.to_pylist()), key=repr)
    assert back == sorted(DOCS, key=repr)
    assert packed["_line"].null_count == 5  # no tokens, no array, the separator or a null among them


def test_term_weights_equal_a_count_by_hand(spark):
    docs = _docs(spark)
    found = terms.tfidf(docs, ["doc_id"], F.lit(len(DOCS))).collect()
    counts = defaultdict(Counter)
    for doc, tokens in DOCS:
        counts[doc].update(t for t in tokens or [] if t is not None)
    df = Counter(t for c in counts.values() for t in c)
    expected = {(d, t): (n, log((len(DOCS) + 1) / (df[t] + 1))) for d, c in counts.items() for t, n in c.items()}
    assert {(r.doc_id, r.term): r.tf for r in found} == {k: n for k, (n, _) in expected.items()}
    assert len(found) == len(expected)
    for r in found:
        n, weight = expected[r.doc_id, r.term]
        assert abs(r.idf - weight) < 1e-12 and abs(r.tfidf - n * weight) < 1e-12


def test_term_pairs_are_never_shuffled(spark):
    """Term weights are exchanged by part or by word alone, not by document and term."""
    plan = terms.tfidf(_docs(spark), ["doc_id"], F.lit(3))._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert dealt and not any("doc_id" in line.split("hashpartitioning(")[1].split(")")[0] for line in dealt)


def test_sequences_take_the_vectors_of_their_first_tokens_only(spark, monkeypatch):
    """A part never holds a vector per token: 3 vectors a document, whatever its length."""
    taken = []

    def in_one_part(docs, keys, tables, make, schema, tokens="tokens", words=None, columns=()):
        own = pa.table({"doc_id": [1, 2], "tokens": [["a", "x", "b"] * 2000, ["x"]]})
        known = pa.table({"word": ["a", "b"], "vector": [[1.0, 2.0], [3.0, 4.0]]})
        found = parts._matched(own, known, keys, tokens)
        monkeypatch.setattr(type(found), "value", lambda self, name: taken.append(name))
        return spark.createDataFrame(make(found).to_pylist(), schema)

    monkeypatch.setattr(wv, "in_parts", in_one_part)
    docs = spark.createDataFrame([(1, ["a"])], "doc_id bigint, tokens array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 2.0])], "word string, vector array<double>")
    rows = wv.padded_sequences(docs, vectors, ["doc_id"], 3, 2).collect()
    assert [(r.doc_id, [float(x) for x in np.ravel(r.sequence)]) for r in rows] == [(1, [1.0, 2.0, 3.0, 4.0, 1.0, 2.0])]
    assert not taken


def test_the_rules_run_once_for_vocabulary_and_lookups(spark, sf):
    t = Tables(spark, sf)
    assert t.scored_tokens.select("doc_id", "tokens").inputFiles() == t.stored_tokens.inputFiles()
    expected = {r.doc_id: r.tokens for r in t.tokens.collect()}
    assert {r.doc_id: r.tokens for r in t.stored_tokens.collect()} == expected
