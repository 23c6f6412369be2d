"""Whitening of embeddings by a covariance in which copies of a vector need not count more than once.

Rows become vectors of whole numbers, and identical ones are grouped first, with their number of copies; the group key is
the vector itself, so equality is exact. The fit goes over distinct vectors with weight one or with their copies as
weights: integer sums for the mean, then centred products of matrices, one per Arrow batch, added up cell by cell. Centring
comes before multiplying: entries lie far from zero, and products of uncentred entries would cancel.
Each distinct vector is projected once; rows get the result back by a join on the digest of their vector, where the vectors
with the most copies are broadcast (at most ``HOT``) and only the others are shuffled.

The driver holds one matrix of dimension x dimension, whatever the number of rows, and solves its eigenproblem.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab.session import stored

#: Vectors with more than 1/HOT of all rows are joined by broadcast; there are fewer than HOT of them.
HOT = 1000
#: Largest dimension: the driver solves an eigenproblem of this size.
MAX_DIMENSION = 4096
_LIMIT = 2**62


def grid_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: float, shift: int) -> DataFrame:
    """(id, x): x = floor(scale * entry) + shift for each entry, as long.

    Rows whose vector is null, empty, holds null or a non-finite entry, or has another length than most vectors (ties:
    the longer) are left out, since no covariance includes them. A finite entry whose x is no long is an error.
    """
    entry = F.col("v")
    good = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(
        entry.isNotNull() & (F.size(entry) > 0)
        & F.forall(entry, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))))
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    size = sizes[0]["n"] if sizes else 0
    if size > MAX_DIMENSION:
        raise ValueError(f"vectors of more than {MAX_DIMENSION} entries")

    def number(c: Column) -> Column:
        scaled = F.lit(float(scale)) * c.cast("double")
        return F.when(F.abs(scaled) < float(_LIMIT), F.floor(scaled).cast("bigint") + F.lit(int(shift))).otherwise(
            F.raise_error(F.lit("an entry is too large for a long")).cast("bigint"))

    return good.where(F.size("v") == size).select("id", F.transform("v", number).alias("x"))


def _key(x: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(x.cast("array<string>"), ",").cast("binary"), 256))


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(key, x, copies), one row per distinct x; copies are counted before the shuffle, so a hot vector is one row a task."""
    counted = vectors.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    return counted.select(_key(F.col("x")).alias("key"), "x", "copies")


@dataclass
class Model:
    """Means as exact fractions ``sums`` / ``n``, unit eigenvectors as rows of ``axes``, all eigenvalues."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    total: float

    @property
    def solid(self) -> np.ndarray:
        """Whether a component has a variance above rounding; others cannot be whitened."""
        top = self.values[0] if len(self.values) else 0.0
        return self.values > max(top, 0.0) * len(self.sums) * np.finfo(float).eps


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: in 64 bits where they suffice, else in whole numbers of any size."""
    most = max(int(np.abs(x).max(initial=0)), 1)
    if most * n < _LIMIT and all(abs(s) < _LIMIT for s in sums):
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _product(frame: DataFrame, size: int, rows_of, weights: bool) -> np.ndarray:
    """Sum over the rows of weight * (row^T row): one product per batch, one matrix per task, cells added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                rows = rows_of(matrix(batch.column(0)))
                total += rows.T @ (rows * batch.column(1).to_numpy()[:, None] if weights else rows)
        if total.any():
            at = np.arange(size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(at, size)), pa.array(np.tile(at, size)), pa.array(total.ravel())], names=["i", "j", "v"])

    cells = frame.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    whole = np.zeros((size, size))
    for cell in cells.collect():  # size x size cells
        whole[cell.i, cell.j] = cell.v
    return whole


def fit(distinct: DataFrame, weighted: bool = False) -> Model:
    """Mean and principal axes of the distinct vectors, each counting once or, if ``weighted``, as often as it occurs."""
    weight = F.col("copies") if weighted else F.lit(1).cast("bigint")
    sums = (distinct.select(weight.alias("w"), F.posexplode("x")).groupBy("pos").agg(
        F.sum(F.col("col").cast("decimal(38,0)") * F.col("w")).alias("s"), F.sum("w").alias("n")).orderBy("pos").collect())
    if not sums:
        return Model(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    n, total = int(sums[0].n), [int(r.s) for r in sums]

    def rows_of(x: np.ndarray) -> np.ndarray:
        return (_centred(x, n, total) / n).astype(float)

    v = _product(distinct.select("x", "copies"), len(total), rows_of, weighted) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")
    axes = vectors.T[order]
    # one sign for all rows and reruns: the largest entry of an axis is positive
    axes *= np.where(np.take_along_axis(axes, np.abs(axes).argmax(1)[:, None], 1) < 0, -1.0, 1.0)
    return Model(n, total, np.ascontiguousarray(axes), values[order], float(np.trace(v)))


def whiten(distinct: DataFrame, model: Model, components: int) -> DataFrame:
    """(key, copies, deviation, whitened) per distinct vector: ``whitened`` has an entry per component, null where the
    component has no variance; ``deviation`` is the sum of (n * x - S)^2, an error if that is no long."""
    k = min(components, len(model.sums))
    solid = model.solid[:k]
    scaled = (model.axes[:k] / np.sqrt(np.where(solid, model.values[:k], 1.0))[:, None]).T
    n, sums = model.n, model.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = _centred(matrix(batch.column(2)), n, sums)
            most = max(int(np.abs(centred).max()), 1)
            exact = centred if most * most * len(sums) < _LIMIT else centred.astype(object)
            squares = (exact * exact).sum(1)
            if exact.dtype == object and max(squares) >= 2**63:
                raise OverflowError("a deviation has more than 64 bits")
            z = ((centred / n).astype(float) @ scaled)
            flat = pa.array(z.ravel(), mask=np.tile(~solid, len(z)), type=pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, k, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([int(s) for s in squares], pa.int64()), lists],
                names=["key", "copies", "deviation", "whitened"])

    return distinct.select("key", "copies", "x").mapInArrow(
        run, "key binary, copies bigint, deviation bigint, whitened array<double>")


def identity_error(whitened: DataFrame, model: Model, weighted: bool = False) -> float:
    """Largest absolute entry of (covariance of the whitened vectors - identity), over components with a variance."""
    k = min(whitened.select(F.size("whitened")).first()[0], len(model.sums)) if model.n else 0
    use = np.flatnonzero(model.solid[:k])
    if not len(use):
        return 0.0
    weight = F.col("copies") if weighted else F.lit(1).cast("bigint")
    means = {r.pos: r.m for r in whitened.select(weight.alias("w"), F.posexplode("whitened")).groupBy("pos").agg(
        (F.sum(F.col("col") * F.col("w")) / F.sum("w")).alias("m")).collect()}
    middle = np.array([means[i] for i in use])
    product = _product(whitened.select("whitened", "copies"), len(use), lambda z: z[:, use] - middle, weighted)
    return float(np.abs(product / model.n - np.eye(len(use))).max())


def join_back(vectors: DataFrame, whitened: DataFrame) -> DataFrame:
    """(id, copies, deviation, whitened) for every row, from the result of its distinct vector.

    A vector with more than 1/HOT of the rows is answered by broadcast, so no task of the shuffled join gets more rows of one
    key than that.
    """
    total = whitened.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") * HOT > total
    rows = vectors.select("id", _key(F.col("x")).alias("_row_key"))
    names = ["copies", "deviation", "whitened"]
    most = whitened.where(hot).select(F.col("key").alias("_hot_key"), F.struct(*names).alias("_hot"))
    others = whitened.where(~hot).select(F.col("key").alias("_cold_key"), F.struct(*names).alias("_cold"))
    marked = rows.join(F.broadcast(most), F.col("_row_key") == F.col("_hot_key"), "left")
    quick = marked.where(F.col("_hot").isNotNull()).select("id", "_hot.*")
    slow = marked.where(F.col("_hot").isNull()).join(others, F.col("_row_key") == F.col("_cold_key")).select("id", "_cold.*")
    return quick.unionAll(slow)


def whitened_rows(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64,
                  shift: int = 1_000_000, components: int = 16, weighted: bool = False) -> DataFrame:
    """One row per remaining row of ``rows`` and component: id, component (from 1), n, deviation, whitened, explained,
    identity_error, copies.

    Repeated identifiers and null identifiers keep their rows. A component without variance (fewer distinct vectors than
    dimensions) has whitened null and explained 0. An empty table gives no rows.
    """
    vectors = grid_vectors(rows, id_col, vector_col, scale, shift)
    distinct = stored(distinct_vectors(vectors), "distinct")
    model = fit(distinct, weighted)
    result = stored(whiten(distinct, model, components), "whitened")
    error = identity_error(result, model, weighted)
    k = min(components, len(model.sums))
    shares = [float(e / model.total) if ok else 0.0 for e, ok in zip(model.values[:k], model.solid[:k])]
    shares = F.array(*[F.lit(s) for s in shares]) if shares else F.expr("cast(array() as array<double>)")
    return join_back(vectors, result).select(
        "id", "copies", "deviation", F.posexplode("whitened").alias("at", "value")).select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation",
        F.col("value").alias("whitened"), F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"), "copies")
