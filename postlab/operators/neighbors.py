"""Exact Euclidean nearest neighbours of one table of vectors in another, given set of targets.

The work is queries times targets, and no bound saves it: on unit vectors of some dozens of dimensions the triangle
inequality excludes nothing. So it is cut evenly. Targets are dealt out in blocks and queries in chunks; a task
holds one block and one chunk, compares them as matrices and gives back k rows per query, never all pairs. A
target is sent once per chunk, a query once per block. A matrix product says which pairs can be among the k nearest, with room
for its rounding, and only their distances are measured one dimension at a time. Meant for a vocabulary against a target list
(distinct words, not tokens).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 32768
CHUNK_ROWS = 32768
#: Queries and targets that are compared at once.
SLICE_ROWS = 256
SLICE_TARGETS = 4096
#: Room for the rounding of a product, as a share of the squares that it is made of.
SLACK = 1e-11
#: Squares up to this size are compared by products.
LARGEST = 1e100


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype="float64")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between the rows of a and b, added up one dimension at a time."""
    total = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        total += (a[:, d, None] - b[None, :, d]) ** 2
    return np.sqrt(total)


def _first(row: np.ndarray, ids: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k smallest (distance, id) of each row; distances that are no number come last."""
    order = np.lexsort((ids, distance, row))
    row, ids, distance = row[order], ids[order], distance[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], ids[kept], distance[kept]


def _plain(q: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, distance) of the k targets closest to each query by all distances; ``ids`` ascend."""
    d = _distances(q, values)
    best = np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.repeat(np.arange(len(q)), best.shape[1]), ids[best].ravel(), np.take_along_axis(d, best, axis=1).ravel()


def _closest(q: np.ndarray, ids: np.ndarray, values: np.ndarray, squares: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for finite vectors: products leave few pairs, whose distances are measured."""
    own = (q ** 2).sum(axis=1)
    room = SLACK * (own + squares.max())
    bound = np.full(len(q), np.inf)  # no more than this for the k-th place
    found = []
    for start in range(0, len(values), SLICE_TARGETS):
        part = slice(start, start + SLICE_TARGETS)
        d = own[:, None] + squares[part] - 2 * (q @ values[part].T)
        if start == 0 and d.shape[1] >= k:
            bound = np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * room
        row, col = np.divmod(np.flatnonzero(d <= bound[:, None]), d.shape[1])
        total = np.zeros(len(row))
        for i in range(q.shape[1]):
            total += (q[row, i] - values[part][col, i]) ** 2
        near = row, ids[part][col], np.sqrt(total)
        found.append(_first(*near, k) if len(row) > 4 * k * len(q) else near)  # many copies are all equally near
    return _first(*map(np.concatenate, zip(*found)), k)


def nearest(queries: DataFrame, targets: DataFrame, k: int = 1,
            max_distance: float | None = None) -> DataFrame:
    """(id, neighbour, rank, distance): the k targets nearest to each query, closest first.

    Both frames are (id bigint, vector array<double>). Ties go to the smaller target id. With
    ``max_distance`` neighbours further away are left out; a distance equal to it still counts.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(1, -(-targets.count() // BLOCK_ROWS))
    n_chunks = max(cores, -(-queries.count() // CHUNK_ROWS))

    def dealt(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        return df.select(
            "id", "vector", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other),
        ).repartition(n_blocks * n_chunks, "block", "chunk").groupBy("block", "chunk")

    def compare(chunk: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"id": [], "neighbour": [], "distance": []})]
        if len(block) and len(chunk):
            block = block.sort_values("id")
            ids, values = block["id"].to_numpy(), _matrix(block["vector"])
            with np.errstate(over="ignore"):
                squares = (values ** 2).sum(axis=1)
            plain = ~(squares < LARGEST)  # also those with a missing number
            sides = [(ids[plain], values[plain], None)] if plain.any() else []
            if not plain.all():
                sides.append((ids[~plain], values[~plain], squares[~plain]))
            for start in range(0, len(chunk), SLICE_ROWS):
                some = chunk.iloc[start:start + SLICE_ROWS]
                names, q = some["id"].to_numpy(), _matrix(some["vector"])
                odd = ~((q ** 2).sum(axis=1) < LARGEST)
                for which in (odd, ~odd):
                    if not which.any():
                        continue
                    best = [
                        _plain(q[which], own, vectors, k) if which is odd or lengths is None
                        else _closest(q[which], own, vectors, lengths, k) for own, vectors, lengths in sides]
                    row, neighbour, distance = best[0] if len(best) == 1 else _first(*map(np.concatenate, zip(*best)), k)
                    found.append(pd.DataFrame({"id": names[which][row], "neighbour": neighbour, "distance": distance}))
        rows = pd.concat(found)
        return rows if max_distance is None else rows[rows["distance"] <= max_distance]

    candidates = dealt(queries, "chunk", n_chunks, "block", n_blocks).cogroup(
        dealt(targets, "block", n_blocks, "chunk", n_chunks)
    ).applyInPandas(compare, "id bigint, neighbour bigint, distance double")
    by_distance = Window.partitionBy("id").orderBy("distance", "neighbour")
    return (
        candidates.withColumn("rank", F.row_number().over(by_distance))
        .where(F.col("rank") <= k)
        .select("id", "neighbour", "rank", "distance")
    )


def closest_by_criterion(queries: DataFrame, targets: DataFrame, criterion: Column,
                         max_distance: float) -> DataFrame:
    """(id, neighbour, distance): the closest target that meets ``criterion`` within ``max_distance``.

    Queries without one stay, with nulls. The criterion is a plain predicate on the target columns and
    so filters the targets at their scan.
    """
    eligible = targets.where(criterion).select("id", "vector")
    found = nearest(queries.select("id", "vector"), eligible, 1, max_distance)
    return queries.select("id").join(found.select("id", "neighbour", "distance"), "id", "left")


def substitutions(vocabulary: DataFrame, targets: DataFrame, max_distance: float) -> DataFrame:
    """(word, n, substitute): nearest target word of each word with a vector, strictly within reach.

    ``vocabulary`` is (word, n, vector, id), ``targets`` (word, vector, id). Each distinct word is
    searched once.
    """
    found = nearest(vocabulary.select("id", "vector"), targets.select("id", "vector"), 1, max_distance)
    names = targets.select(F.col("id").alias("neighbour"), F.col("word").alias("substitute"))
    return (
        vocabulary.select("id", "word", "n")
        .join(found.where(F.col("distance") < max_distance), "id")
        .join(names, "neighbour")
        .select("word", "n", "substitute")
    )
