"""Approximate nearest neighbours between two large tables of vectors: an inverted file.

Targets lie in cells around coarse centroids. A query looks at the cells whose centroids are closest to it; how many is
measured, so that a sample of queries finds a given share of its true neighbours. Small cells are packed into blocks and
large ones are dealt out to several; which block holds a cell stands in a table with a row per cell. The queries of a
block are cut into chunks by their count, so a target is sent only as often as chunks of queries look at its block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlab.session import stored

#: Cells are the square root of the targets, up to this number; the centroids are known to every task.
MAX_CELLS = 4096
#: The centroids are fitted on about this many targets per cell, chosen by a hash of the id. Every target is indexed.
FIT_ROWS = 64
FIT_ROUNDS = 8
#: Targets of a block, queries of a chunk, targets and queries that are compared at once, queries recall is measured on.
BLOCK_TARGETS = 65536
CHUNK_QUERIES = 16384
SLICE_TARGETS = 2048
SLICE_QUERIES = 1024
SAMPLE_QUERIES = 256
#: Pairs of a query and a cell that are ordered at once.
SLICE_LOOKS = 1 << 18

Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype="float64")


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of a and b by products: good enough to choose, not to report."""
    return (a ** 2).sum(axis=1)[:, None] + (b ** 2).sum(axis=1) - 2 * (a @ b.T)


def _order(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """All cells of each query, the closest centroid first."""
    return np.argsort(_squares(q, centroids), axis=1, kind="stable")


def _slices(part: pd.DataFrame, rows: int) -> Iterator[pd.DataFrame]:
    for start in range(0, len(part), rows):
        yield part.iloc[start:start + rows]


def _best(found: list[Found], k: int) -> Found:
    """The k smallest (distance, id) of each row among (row, id, distance)."""
    row, ids, distance = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((ids, distance, row))
    row, ids, distance = row[order], ids[order], distance[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], ids[kept], distance[kept]


def _closest(q: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int) -> Found:
    """At least the k targets closest to each query, with distances measured anew and ties of the k-th place."""
    d = _squares(q, values)
    if d.shape[1] > k:
        last = np.partition(d, k - 1, axis=1)[:, k - 1:k]
        row, col = np.nonzero(d <= last + 1e-9 * (1 + np.abs(last)))
    else:
        row, col = np.nonzero(np.ones(d.shape, dtype=bool))
    gap = q[row] - values[col]
    return _best([(row, ids[col], np.sqrt((gap * gap).sum(axis=1)))], k)


def _top(candidates: DataFrame, k: int) -> DataFrame:
    by_distance = Window.partitionBy("id").orderBy("distance", "neighbour")
    return candidates.withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") <= k)


def fit_centroids(targets: DataFrame, n_targets: int, n_cells: int, seed: int) -> np.ndarray:
    """Centroids of a K-means fit on a bounded sample of the targets."""
    share = min(1.0, FIT_ROWS * n_cells / max(1, n_targets))
    some = targets.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    points = stored(some.select(array_to_vector("vector").alias("v")), "points")
    if points.isEmpty():
        points = targets.limit(n_cells).select(array_to_vector("vector").alias("v"))
    model = KMeans(k=max(2, n_cells), featuresCol="v", maxIter=FIT_ROUNDS, initSteps=2, seed=seed).fit(points)
    return np.array(model.clusterCenters())


@dataclass
class InvertedFile:
    """Targets by cell: ``held`` is (id, vector, cell); ``rows`` counts the targets of each cell."""

    centroids: np.ndarray
    held: DataFrame
    rows: np.ndarray

    @cached_property
    def n_targets(self) -> int:
        return int(self.rows.sum())

    @cached_property
    def layout(self) -> pd.DataFrame:
        """(cell, block, pieces): the block of a cell, or the first of its blocks if it is dealt out to several."""
        pieces = np.maximum(1, -(-self.rows // BLOCK_TARGETS))
        small = np.where(pieces == 1, self.rows, 0)
        packed = (np.cumsum(small) - small) // BLOCK_TARGETS
        own = np.where(pieces > 1, pieces, 0)
        block = np.where(pieces > 1, packed.max(initial=0) + 1 + np.cumsum(own) - own, packed)
        return pd.DataFrame({"cell": np.arange(len(pieces)), "block": block, "pieces": pieces})

    def probes(self, queries: DataFrame, k: int, recall: float) -> int:
        """How many cells, closest first, hold the share ``recall`` of the true neighbours of a sample of queries.

        Copies of a query (distance 0) are always in its own cell and are not counted.
        """
        some = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_QUERIES).collect()
        sample = np.array([r["vector"] for r in some], dtype="float64")
        if not len(sample) or not self.n_targets:
            return 1

        def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best, cell_of = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))], {}
            for part in (s for p in parts for s in _slices(p, SLICE_TARGETS)):
                values, ids = _matrix(part["vector"]), part["id"].to_numpy()
                squares = _squares(sample, values)
                squares[squares < 1e-9] = np.inf
                col = np.argsort(squares, axis=1, kind="stable")[:, :k]
                near = np.take_along_axis(squares, col, axis=1).ravel()
                row = np.repeat(np.arange(len(sample)), col.shape[1])
                seen = np.isfinite(near)
                cell_of.update(zip(ids[col].ravel(), part["cell"].to_numpy()[col].ravel()))
                best = [_best([*best, (row[seen], ids[col].ravel()[seen], near[seen])], k)]
                cell_of = {i: cell_of[i] for i in set(best[0][1])}
            row, ids, near = best[0]
            yield pd.DataFrame({"id": row, "neighbour": ids, "distance": near, "cell": [cell_of[i] for i in ids]})

        schema = "id bigint, neighbour bigint, distance double, cell bigint"
        pairs = _top(self.held.mapInPandas(compare, schema), k).collect()  # k rows per query of the sample
        if not pairs:
            return 1
        place = np.argsort(_order(sample, self.centroids), axis=1)
        at = np.sort([place[r["id"], r["cell"]] for r in pairs])
        return int(at[max(0, int(np.ceil(recall * len(at))) - 1)]) + 1

    def visits(self, queries: DataFrame, probes: int, k: int) -> DataFrame:
        """(id, vector, block, cells, work): which cells of which blocks each query looks at; work counts their targets.

        A query looks at further cells until they hold k targets. Of a cell that is dealt out, every block is visited;
        its targets are counted with its first block.
        """
        centroids, rows, schema = self.centroids, self.rows, "id bigint, vector array<double>, block bigint, cells array<bigint>, work bigint"
        first, pieces = self.layout["block"].to_numpy(), self.layout["pieces"].to_numpy()

        def sent(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for some in (s for p in parts for s in _slices(p, max(1, min(SLICE_QUERIES, SLICE_LOOKS // len(rows))))):
                order = _order(_matrix(some["vector"]), centroids)
                own = rows[order]
                wanted = ((np.arange(order.shape[1]) < probes) | (np.cumsum(own, axis=1) - own < k)) & (own > 0)
                at, place = np.nonzero(wanted)
                cell = order[at, place]
                times = pieces[cell]
                piece = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                looks = pd.DataFrame({
                    "at": np.repeat(at, times), "block": np.repeat(first[cell], times) + piece,
                    "cells": np.repeat(cell, times), "work": np.where(piece == 0, np.repeat(rows[cell], times), 0)})
                per_block = looks.groupby(["at", "block"], as_index=False).agg({"cells": list, "work": "sum"})
                chosen = some.iloc[per_block["at"].to_numpy()].reset_index(drop=True)
                yield chosen[["id", "vector"]].assign(**{c: per_block[c] for c in ("block", "cells", "work")})

        some = queries.select("id", "vector").where(F.lit(self.n_targets > 0))
        return stored(some.mapInPandas(sent, schema), "visits")

    def search(self, visits: DataFrame, k: int) -> DataFrame:
        """(id, neighbour, rank, distance) of visiting queries; a task holds one block and one chunk of its queries."""
        spark = visits.sparkSession
        cores = spark.sparkContext.defaultParallelism
        least = -(-cores // (int(self.layout["block"].max()) + 1))
        chunks = visits.groupBy("block").agg(
            F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_QUERIES), F.lit(least)).alias("chunks"))
        of_queries = visits.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
        layout = spark.createDataFrame(self.layout, "cell bigint, block bigint, pieces bigint")
        of_targets = (
            self.held.join(F.broadcast(layout), "cell")  # a row per cell, MAX_CELLS at most
            .withColumn("block", F.col("block") + F.pmod(F.xxhash64("id"), F.col("pieces")))
            .join(chunks, "block")
            .select("id", "vector", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        )

        def compare(chunk: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            found = [pd.DataFrame({"id": [], "neighbour": [], "distance": []})]
            block = block.sort_values(["cell", "id"])
            cells, ids = block["cell"].to_numpy(), block["id"].to_numpy()
            values = _matrix(block["vector"]) if len(block) else None
            for some in _slices(chunk if len(block) else chunk.iloc[:0], SLICE_QUERIES):
                q = _matrix(some["vector"])
                at = np.repeat(np.arange(len(some)), some["cells"].map(len))
                looks = np.concatenate(some["cells"].tolist())
                best = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))]
                for cell in np.unique(looks):
                    who = at[looks == cell]
                    start, end = np.searchsorted(cells, [cell, cell + 1])
                    for cut in range(start, end, SLICE_TARGETS):
                        part = slice(cut, min(end, cut + SLICE_TARGETS))
                        row, neighbour, distance = _closest(q[who], ids[part], values[part], k)
                        best.append((who[row], neighbour, distance))
                    if sum(len(b[0]) for b in best) > 4 * k * len(q):
                        best = [_best(best, k)]
                row, neighbour, distance = _best(best, k)
                found.append(pd.DataFrame({"id": some["id"].to_numpy()[row], "neighbour": neighbour, "distance": distance}))
            return pd.concat(found)

        pairs = of_queries.select("id", "vector", "cells", "block", "chunk").groupBy("block", "chunk").cogroup(
            of_targets.groupBy("block", "chunk")).applyInPandas(compare, "id bigint, neighbour bigint, distance double")
        return _top(pairs, k).select("id", "neighbour", "rank", "distance")


def inverted_file(targets: DataFrame, n_cells: int | None = None, seed: int = 1) -> InvertedFile:
    """Index (id bigint, vector array<double>): fit the centroids, then give every target its cell.

    Rows without a vector are not indexed. Equal vectors share a cell.
    """
    targets = stored(targets.select("id", "vector").where(F.col("vector").isNotNull()), "targets")
    n_targets = targets.count()
    n_cells = n_cells or int(np.clip(round(n_targets ** 0.5), 1, MAX_CELLS))
    dim = len(targets.first()["vector"]) if n_targets else 1
    centroids = fit_centroids(targets, n_targets, n_cells, seed) if n_targets > 1 else np.zeros((1, dim))

    def celled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in (s for p in parts for s in _slices(p, SLICE_TARGETS)):
            yield some.assign(cell=np.argmin(_squares(_matrix(some["vector"]), centroids), axis=1))

    held = stored(targets.mapInPandas(celled, "id bigint, vector array<double>, cell bigint"), "held")
    rows = np.zeros(len(centroids), dtype="int64")
    for r in held.groupBy("cell").count().collect():  # a row per cell
        rows[r["cell"]] = r["count"]
    return InvertedFile(centroids, held, rows)


def nearest_approximate(queries: DataFrame, targets: DataFrame, k: int = 1, recall: float = 0.95,
                        n_cells: int | None = None, seed: int = 1) -> DataFrame:
    """(id, neighbour, rank, distance): probably the k nearest targets, closest first; ties go to the smaller id.

    For two large tables, where ``nearest`` is too much work. Every query with a vector gets k neighbours if there are
    k targets. Where vectors lie in groups few cells are looked at; where they do not, most are.
    """
    queries = queries.select("id", "vector").where(F.col("vector").isNotNull())
    index = inverted_file(targets, n_cells, seed)
    return index.search(index.visits(queries, index.probes(queries, k, recall), k), k)


def search_work(queries: DataFrame, targets: DataFrame, k: int = 1, recall: float = 0.95,
                n_cells: int | None = None, seed: int = 1) -> DataFrame:
    """(queries, targets, cells, probes, share): what such a search looks at, as a share of all query-target pairs."""
    queries = queries.select("id", "vector").where(F.col("vector").isNotNull())
    index = inverted_file(targets, n_cells, seed)
    probes = index.probes(queries, k, recall)
    return index.visits(queries, probes, k).agg(
        F.count_distinct("id").alias("queries"), F.lit(index.n_targets).cast("bigint").alias("targets"),
        F.lit(len(index.rows)).alias("cells"), F.lit(probes).alias("probes"),
        (F.sum("work") / (F.count_distinct("id") * F.lit(max(1, index.n_targets)))).alias("share"))
