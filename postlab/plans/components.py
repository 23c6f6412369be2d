"""Principal components of wide sparse rows by a randomised range finder.

The rows are never made dense and no width x width matrix exists anywhere. With X the centred rows and Q a width x l basis, one
pass gives X'X Q = sum of x (x'Q) - n m (m'Q): each task multiplies its sparse rows with the broadcast basis and adds up a
width x l block, and the blocks are added by Spark in strips of the width. A few such passes with a QR step between them
turn a random basis to the leading components; a last one gives their variances. The driver holds width x l numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a strip: what one group of the addition holds.
STRIP = 256
#: Numbers that the driver and each task may hold for the basis.
MAX_BASIS = 1 << 25
#: Numbers of a dense block of rows.
BLOCK = 1 << 22


@dataclass(frozen=True)
class Components:
    """``axes``: width x k, orthonormal; ``variances`` fall."""

    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray


def sparse_cells(vector: Column) -> Column:
    """struct(indices, values) of the nonzero entries of an ML vector, sparse or dense."""
    raw = F.unwrap_udt(vector)
    dense = F.filter(F.arrays_zip(F.sequence(F.lit(0), F.size(raw["values"]) - 1).alias("i"), raw["values"].alias("v")),
                     lambda c: c["v"] != 0)
    return F.when(raw["type"] == 0, F.struct(raw["indices"].alias("indices"), raw["values"].alias("values"))).otherwise(
        F.struct(F.transform(dense, lambda c: c["i"]).alias("indices"), F.transform(dense, lambda c: c["v"]).alias("values")))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, columns and values of a batch of (indices, values) lists."""
    indices, values = batch.column(0), batch.column(1)
    lengths = np.diff(indices.offsets.to_numpy())
    return (np.repeat(np.arange(len(lengths)), lengths), indices.flatten().to_numpy(zero_copy_only=False),
            values.flatten().to_numpy(zero_copy_only=False))


def _multiply(cells: DataFrame, basis: np.ndarray) -> np.ndarray:
    """The sum of x (x' basis) over all rows."""
    width, size = basis.shape
    step = max(1, min(512, BLOCK // width))  # rows of a block
    shared = cells.sparkSession.sparkContext.broadcast(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, total, seen = shared.value, np.zeros((width, size)), False
        for batch in batches:
            row, column, value = _rows(batch)
            if not len(row):
                continue
            seen = True
            for at in range(0, batch.num_rows, step):  # their columns alone, as a dense block: far fewer than the width
                a, b = np.searchsorted(row, [at, at + step])
                used = np.zeros(width, dtype=bool)
                used[column[a:b]] = True
                block = np.zeros((step, np.count_nonzero(used)))
                block[row[a:b] - at, (np.cumsum(used) - 1)[column[a:b]]] = value[a:b]
                total[used] += block.T @ (block @ q[used])
        if seen:
            firsts = range(0, width, STRIP)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(firsts), pa.int32()), pa.array([total[f:f + STRIP].tobytes() for f in firsts], pa.binary())],
                names=["first", "block"])

    def add(key: tuple[pa.Scalar, ...], strips: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for strip in strips:
            for block in strip.column("block"):
                total = total + np.frombuffer(block.as_buffer())
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["first", "block"])

    schema = "first int, block binary"
    whole = np.zeros((width, size))
    for strip in cells.mapInArrow(run, schema).groupBy("first").applyInArrow(add, schema).collect():  # width x l numbers
        whole[strip.first:strip.first + STRIP] = np.frombuffer(strip.block).reshape(-1, size)
    return whole


def fit_components(rows: DataFrame, vector: str, width: int, k: int, passes: int = 4, extra: int = 10,
                   seed: int = 1) -> Components:
    """The leading ``k`` principal components of a vector column; fewer if the width or the number of rows is smaller.

    ``extra`` more directions and ``passes`` rounds make them exact up to the gap between the variances: the error of the
    subspace falls with (variance k + extra + 1 / variance k) ** (2 * passes + 1). An empty table has no components.
    """
    cells = rows.where(F.col(vector).isNotNull()).select(sparse_cells(F.col(vector)).alias("c")).select("c.indices", "c.values")
    sums = cells.select(F.explode(F.arrays_zip("indices", "values")).alias("c")).groupBy("c.indices").agg(
        F.sum("c.values").alias("s"))
    n = cells.count()
    mean = np.zeros(width)
    for r in sums.collect():  # as many as the width
        mean[r[0]] = r.s / n
    k = min(k, width, n)
    size = min(k + extra, width)
    if width * size > MAX_BASIS:
        raise ValueError("width times components is too large for the driver")
    if not k:
        return Components(mean, np.zeros((width, 0)), np.zeros(0))
    basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))

    def centred(q: np.ndarray) -> np.ndarray:
        return _multiply(cells, q) - n * np.outer(mean, mean @ q)

    for _ in range(passes):
        basis, _ = np.linalg.qr(centred(basis))
    small = basis.T @ centred(basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:k]
    axes = basis @ vectors[:, order]
    axes *= np.where(np.take_along_axis(axes, np.abs(axes).argmax(0)[None], 0) < 0, -1.0, 1.0)
    return Components(mean, axes, np.maximum(values[order], 0.0) / max(n - 1, 1))


class ProjectOnAxes(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The coordinates of a vector column on given axes (not centred, as Spark's own components are)."""

    axes = Param(Params._dummy(), "axes", "width x k numbers, row by row", TypeConverters.toListFloat)
    k = Param(Params._dummy(), "k", "number of axes", TypeConverters.toInt)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        axes = np.array(self.getOrDefault(self.axes)).reshape(-1, self.getOrDefault(self.k))
        shared = dataset.sparkSession.sparkContext.broadcast(axes)

        def project(cells: pd.DataFrame) -> pd.Series:
            q = shared.value
            return pd.Series([np.asarray(v) @ q[np.asarray(i, dtype=int)] for i, v in zip(cells["indices"], cells["values"])])

        apply = F.pandas_udf(project, "array<double>")
        return dataset.withColumn(
            self.getOutputCol(), array_to_vector(apply(sparse_cells(F.col(self.getInputCol())))))


def components_stage(found: Components, source: str, name: str) -> Transformer:
    """The projection on fitted components as a pipeline stage."""
    stage = ProjectOnAxes()
    return stage._set(axes=found.axes.ravel().tolist(), k=found.axes.shape[1], inputCol=source, outputCol=name)
