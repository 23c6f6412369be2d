"""Search results against all distances."""

import random

import pytest
from pyspark.sql import functions as F

from postlab.llm import hamming
from tests.llm.fixture import CLASHING


def table(spark, width, n, seed):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    rows = []
    for i in range(n):
        vector = [x + rng.gauss(0, 0.7) for x in rng.choice(centers)]
        rows.append((i, vector if rng.random() < 0.6 or not rows else rng.choice(rows)[1]))
    rows += [(n, None), (n + 1, []), (n + 2, [float("nan"), None] + [1.0] * (width - 2)), (n + 3, [1.0] * (width + 1)), (None, rows[0][1])]
    rows.append(rows[5])
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).select(
        "*", *[F.lit(1).alias(c) for c in CLASHING + ["rank", "distance", "code", "width", "chunk"]])


def brute(rows, k):
    codes = {i: tuple(bool(x is not None and x > 0) for x in v) for i, v in rows if i is not None and v}
    found = set()
    for q in codes:
        if q % 7 == 0:
            near = sorted((sum(a != b for a, b in zip(codes[q], codes[i])), i) for i in codes if i != q and len(codes[i]) == len(codes[q]))
            found |= {(q, rank + 1, i, d) for rank, (d, i) in enumerate(near[:k])}
    return found


@pytest.mark.parametrize("width,n,k", [(64, 200, 5), (5, 60, 3), (100, 80, 10), (16, 40, 100)])
def test_nearest(spark, width, n, k):
    rows, df = table(spark, width, n, width)
    for sizes in ({}, {"block_rows": 30, "chunk_rows": 4}):
        got = hamming.top_k(df, F.col("vec_id") % 7 == 0, k, **sizes).collect()
        assert {tuple(r) for r in got} == brute(rows, k) and len(got) == len(brute(rows, k))


def test_no_queries_and_empty_table(spark):
    _, df = table(spark, 8, 20, 1)
    assert hamming.top_k(df, F.lit(False), 3).collect() == []
    assert hamming.top_k(df.limit(0), F.lit(True), 3).collect() == []


def test_search_stops_before_all_codes_are_seen():
    rng = random.Random(2)
    codes = [rng.randbytes(8) for _ in range(4000)]
    index = hamming.MultiIndex(codes, 64)
    seen = []
    whole = hamming._masks
    try:
        hamming._masks = lambda bits, weight: (seen.append(weight), whole(bits, weight))[1]
        rows, distances = index.search(codes[7], 1)
    finally:
        hamming._masks = whole
    assert rows.tolist() == [7] and distances.tolist() == [0] and max(seen) == 0
