"""Whitening against numpy in whole numbers, with copies, odd vectors and few vectors."""

import math
import random

import numpy as np
import pytest

from postlab.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, id int, copies int, whitened int"


def table(spark, seed=1, size=6, rows=120):
    rng = random.Random(seed)
    vectors = [[rng.gauss(0, 1 + k) for k in range(size)] for _ in range(rows)]
    vectors += [vectors[3]] * 60 + [[v + 1e-9 for v in vectors[5]]]
    odd = [None, [], [1.0] * (size - 1), [None] + [0.5] * (size - 1), [float("nan")] * size, [float("inf")] + [0.0] * (size - 1)]
    data = [(i, v, 1, 2, 3) for i, v in enumerate(vectors + odd)] + [(None, vectors[0], 1, 2, 3), (4, vectors[9], 1, 2, 3)]
    rng.shuffle(data)
    return spark.createDataFrame(data, SCHEMA).repartition(5)


def plain(rows, size, components, weighted=False):
    kept = [(r.vec_id, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in r.embedding)) for r in rows
            if r.embedding is not None and len(r.embedding) == size
            and all(c is not None and math.isfinite(c) for c in r.embedding)]
    counts = {}
    for _, x in kept:
        counts[x] = counts.get(x, 0) + 1
    weights = {x: c if weighted else 1 for x, c in counts.items()}
    n = sum(weights.values())
    sums = [sum(x[k] * w for x, w in weights.items()) for k in range(size)]
    centred = {x: np.array([(n * x[k] - sums[k]) / n for k in range(size)]) for x in counts}
    v = sum(w * np.outer(centred[x], centred[x]) for x, w in weights.items()) / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    return [(i, k + 1, n, sum((n * x[d] - sums[d]) ** 2 for d in range(size)),
             float(centred[x] @ vectors[:, k] / math.sqrt(values[k])), float(values[k] / np.trace(v)))
            for i, x in kept for k in range(min(components, size))]


@pytest.mark.parametrize("components, weighted", [(4, False), (16, False), (3, True)])
def test_against_numpy(spark, components, weighted):
    rows = table(spark)
    found = whitening.whitened_rows(rows, components=components, weighted=weighted).collect()
    want = plain(rows.collect(), 6, components, weighted)
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    found = sorted(((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in found), key=order)
    want = sorted(want, key=order)
    assert [f[:4] for f in found] == [w[:4] for w in want]
    assert max(f[6] for f in found) < 1e-9 and len({f[6] for f in found}) == 1
    signs = {}
    for f, w in zip(found, want):
        assert abs(f[5] - w[5]) < 1e-9 * w[5]
        assert abs(abs(f[4]) - abs(w[4])) < 1e-8
        if abs(w[4]) > 1e-3:
            signs.setdefault(f[1], set()).add(f[4] * w[4] > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_hot_vector_by_broadcast_and_others_by_shuffle(spark, monkeypatch):
    rows = table(spark, seed=2)
    want = sorted(map(repr, whitening.whitened_rows(rows).collect()))
    monkeypatch.setattr(whitening, "HOT", 4)
    assert sorted(map(repr, whitening.whitened_rows(rows).collect())) == want


def test_few_vectors_and_empty_table(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    found = {(r.vec_id, r.component): r for r in whitening.whitened_rows(rows).collect()}
    assert len(found) == 9 and abs(abs(found[1, 1].whitened) - 1) < 1e-12 and abs(found[1, 1].explained - 1) < 1e-12
    assert found[1, 2].whitened is None and found[1, 3].explained == 0.0 and found[1, 1].identity_error < 1e-9
    single = whitening.whitened_rows(rows.where("vec_id > 1")).collect()
    assert len(single) == 6 and all(r.whitened is None and r.deviation == 0 and r.n == 1 for r in single)
    for nothing in (rows.where("vec_id > 5"), rows.selectExpr("vec_id", "cast(null as array<float>) AS embedding")):
        assert whitening.whitened_rows(nothing).collect() == []


def test_sums_beyond_64_bits(spark):
    rows = spark.createDataFrame([(1, [2.0**40, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        whitening.whitened_rows(rows).collect()
    with pytest.raises(Exception, match="too large"):
        whitening.whitened_rows(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")).collect()


def test_query(spark, sf):
    from postlab.llm.queries import op13_whitening

    rows = op13_whitening(spark, sf).collect()
    want = plain(spark.read.parquet(f"{sf}/embeddings.parquet").collect(), 64, 16)
    found = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(want) == len(found)
    for i, k, n, deviation, value, share in want:
        r = found[i, k]
        assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - abs(value)) < 1e-6
        assert abs(r.explained - share) < 1e-6 * share and r.identity_error < 1e-9
