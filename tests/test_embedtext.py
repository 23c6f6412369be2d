"""The text classifier with learned embeddings on a corpus of known classes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlab.plans import embedtext
from postlab.plans.embedtext import Settings
from postlab.plans.validation import score

WORDS = {0: ["zug", "verspätung", "schlecht"], 1: ["bahn", "pünktlich", "gut"], 2: ["wetter", "fussball", "essen"]}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, [WORDS[i % 3][(i // 3 + j) % 3] for j in range(2)] + ["heute", f"wort{i % 7}"], i % 3) for i in range(240)]
    rows += [(900, [], 1), (901, None, 0), (902, ["zug"], None)]
    return spark.createDataFrame(rows, "doc_id bigint, stems array<string>, sentiment int").cache()


def test_learns_and_does_not_depend_on_partitions(spark, corpus):
    small = Settings(dim=6, epochs=6, rate=0.5, buckets=1000, shard_rows=60, word_ngrams=2)
    even = corpus.where("doc_id % 2 = 0")
    a = embedtext.fit(even, "doc_id", "stems", "sentiment", 3, small)
    b = embedtext.fit(even.repartition(7, "stems"), "doc_id", "stems", "sentiment", 3, small)
    va, vb = ({r["bucket"]: r["vector"] for r in m.vectors.collect()} for m in (a, b))
    assert va == vb
    odd = corpus.where("doc_id % 2 = 1 AND doc_id < 900")
    assert score(a, odd, "sentiment") > 0.95
    rest = a.transform(corpus.where("doc_id >= 900")).select("doc_id", "prediction").collect()
    assert {r.doc_id: r.prediction for r in rest}[900] == a.majority and len(rest) == 3


def test_one_shard_is_plain_descent(spark, corpus):
    s = Settings(dim=4, epochs=2, rate=0.3, buckets=50, shard_rows=10_000)
    model = embedtext.fit(corpus, "doc_id", "stems", "sentiment", 3, s)
    got = {r["bucket"]: np.array(r["vector"]) for r in model.vectors.collect()}
    bags = {}
    for r in embedtext.bags(corpus.where("sentiment IS NOT NULL"), "doc_id", "stems", s).collect():
        bags.setdefault(r.doc_id, []).append((r.bucket, r.n))
    label = {r.doc_id: r.sentiment for r in corpus.collect()}
    turns = [[r.doc_id for r in corpus.orderBy(F.xxhash64("doc_id", F.lit(1), F.lit(e))).collect() if r.doc_id in bags] for e in range(2)]
    first = corpus.sparkSession.createDataFrame([(b,) for b in got], "bucket bigint").select(
        "bucket", embedtext._first_vector(s).alias("v")).collect()
    table = {r.bucket: np.array(r.v) for r in first}
    for epoch in range(2):
        for step, doc in enumerate(turns[epoch]):
            rate = 0.3 * (1 - (epoch + step / len(turns[epoch])) / 2)
            total = sum(n for _, n in bags[doc])
            hidden = sum(n / total * table[b] for b, n in bags[doc])
            p = np.exp([table[-1 - c] @ hidden for c in range(3)])
            error = np.eye(3)[label[doc]] - p / p.sum()
            back = sum(error[c] * table[-1 - c] for c in range(3))
            for c in range(3):
                table[-1 - c] = table[-1 - c] + rate * error[c] * hidden
            for b, n in bags[doc]:
                table[b] = table[b] + rate * n / total * back
    assert got.keys() == table.keys()
    assert max(np.abs(got[b] - table[b]).max() for b in got) < 1e-5


def test_no_labelled_rows(spark, corpus):
    with pytest.raises(ValueError):
        embedtext.fit(corpus.where("sentiment IS NULL"), "doc_id", "stems", "sentiment", 3)
