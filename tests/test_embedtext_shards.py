"""Shards of the text classifier: each in a task of its own, as Arrow tables, averaged in whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from postlab.operators.parts import own_names
from postlab.plans import embedtext


def test_a_pass_takes_and_gives_arrow_tables():
    docs = pa.table({"turn": [5, -3], "label": [1, 0], "buckets": [[7, 9], [9]], "counts": [[1, 3], [2]]})
    vectors = pa.table({"bucket": [9, -1, 7, -2], "docs": [2, 2, 1, 2], "vector": [[0.5, 1.0], [0.0, 0.0], [1.0, -1.0], [0.25, 0.0]]})
    made = embedtext._descend(2, (0.5, 0.5))(docs, vectors)
    table = {b: np.array(v) for b, v in zip(vectors["bucket"].to_pylist(), vectors["vector"].to_pylist())}
    for label, bag in ((0, {9: 1.0}), (1, {7: 0.25, 9: 0.75})):
        hidden = sum(w * table[b] for b, w in bag.items())
        p = np.exp([table[-1] @ hidden, table[-2] @ hidden])
        error = np.eye(2)[label] - p / p.sum()
        back = error[0] * table[-1] + error[1] * table[-2]
        table[-1], table[-2] = table[-1] + 0.5 * error[0] * hidden, table[-2] + 0.5 * error[1] * hidden
        for b, w in bag.items():
            table[b] = table[b] + 0.5 * w * back
    assert made["bucket"].to_pylist() == [9, -1, 7, -2] and made["docs"].to_pylist() == [2, 2, 1, 2]
    for b, n, parts in zip(*(made[c].to_pylist() for c in ("bucket", "docs", "parts"))):
        assert np.abs(np.array(parts) / n / embedtext.STEPS - table[b]).max() < 1e-6


def test_means_are_sums_of_whole_numbers(monkeypatch):
    monkeypatch.setattr(embedtext, "MERGE_ROWS", 3)
    rng = np.random.default_rng(1)
    names, docs, parts = rng.integers(-2, 9, 40), rng.integers(1, 5, 40), rng.integers(-1 << 50, 1 << 50, (40, 2))
    rows = embedtext._rows(names, {"docs": docs}, "parts", parts)
    found = pa.Table.from_batches(embedtext._means(iter(rows.to_batches(max_chunksize=4))))
    assert sorted(found["bucket"].to_pylist()) == sorted(set(names.tolist()))
    for b, v in zip(found["bucket"].to_pylist(), found["vector"].to_pylist()):
        assert v == [int(parts[names == b, i].sum()) / int(docs[names == b].sum()) / embedtext.STEPS for i in (0, 1)]
    assert list(embedtext._means(iter([]))) == []


def test_shards_do_not_meet_in_a_task(spark):
    for n in (1, 7, 40):
        names = own_names(spark, n)
        rows = spark.createDataFrame([(i,) for i in names], "shard int")
        assert len(names) == n == rows.select(F.pmod(F.hash("shard"), F.lit(n))).distinct().count()
