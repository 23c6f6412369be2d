"""The product behind the components: blocks of rows over their own columns."""

from __future__ import annotations

import numpy as np
import pytest
from postlab.plans import components


def cells(spark, x):
    rows = [([int(i) for i in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for r in x]
    return spark.createDataFrame(rows, "indices array<int>, values array<double>").coalesce(2)


@pytest.mark.parametrize("block", [1, 200, 1 << 22])
def test_product_equals_the_dense_one(spark, monkeypatch, block):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((70, 40)) * (rng.random((70, 40)) < 0.2)
    x[7] = 0
    basis = rng.standard_normal((40, 6))
    monkeypatch.setattr(components, "BLOCK", block)
    assert np.allclose(components._multiply(cells(spark, x), basis), x.T @ (x @ basis), atol=1e-12)
    assert not components._multiply(cells(spark, x[7:8]), basis).any()
