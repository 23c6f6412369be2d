"""Exact nearest binary codes by Hamming distance: incremental multi-index hashing.

Vectors become codes of their signs. Equal codes are kept together, and only the identifiers that a result can hold are
kept of each. The codes are dealt out in blocks and the queries in chunks; a task holds one block and one chunk.
In a block, the code is cut into segments with one table each, from segment value to codes. A query looks up all
values within a radius of its own segment, table after table, and then with the next radius. Once a tables
have been searched to radius r and the others to r - 1, every code within distance (number of tables) * r + a - 1
has been seen; the search ends when k codes lie within it. The best of all blocks are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlab.llm.common import tidy
from postlab.session import stored

#: Codes of a block and queries of a chunk.
BLOCK_ROWS = 1 << 18
CHUNK_ROWS = 1 << 14


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, width, code): one bit per entry, set if the entry is above 0, in a binary of whole 64-bit words.

    Null vectors and empty ones have no code and are left out; null and NaN entries count as not above 0.
    """
    chosen = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(
        F.size("vector") > 0)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            widths = np.asarray(lists.value_lengths())
            signs = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False).astype(float)) > 0
            codes = []
            for row in np.split(signs, np.cumsum(widths)[:-1]):
                bits = np.zeros(-(-len(row) // 64) * 64, dtype=bool)
                bits[:len(row)] = row
                codes.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(widths, pa.int32()), pa.array(codes, pa.binary())], names=["id", "width", "code"])

    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"id {kind}, width int, code binary")


@cache
def _masks(bits: int, weight: int) -> np.ndarray:
    """All values of ``bits`` bits with ``weight`` of them set."""
    return np.array([sum(1 << b for b in chosen) for chosen in combinations(range(bits), weight)], dtype=np.int64)


class MultiIndex:
    """The tables of one block of distinct codes."""

    def __init__(self, codes: list[bytes], width: int):
        self.words = np.frombuffer(b"".join(codes), dtype=np.uint64).reshape(len(codes), -1)
        self.width = width
        size = min(16, max(4, round(np.log2(len(codes) + 1))))
        count = -(-width // size)
        edges = [width * i // count for i in range(count + 1)]
        self.segments = list(zip(edges, edges[1:]))
        self.tables = []
        for values, (start, end) in zip(self._values(self.words).T, self.segments):
            order = np.argsort(values, kind="stable")
            self.tables.append((np.searchsorted(values[order], np.arange((1 << (end - start)) + 1)), order))

    def _values(self, words: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1)
        return np.stack([
            bits[:, s:e].astype(np.int64) @ (1 << np.arange(e - s, dtype=np.int64)) for s, e in self.segments], axis=1)

    def search(self, code: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the codes among which the ``k`` nearest are; all that tie with the last."""
        query = np.frombuffer(code, dtype=np.uint64)
        values = self._values(query[None, :])[0]
        distance = np.full(len(self.words), self.width + 1, dtype=np.int32)
        k, count = min(k, len(self.words)), len(self.segments)
        for radius in range(max(e - s for s, e in self.segments) + 1):
            for a, (value, (start, end), (place, order)) in enumerate(zip(values, self.segments, self.tables)):
                if radius <= end - start:
                    probes = value ^ _masks(end - start, radius)
                    low, n = place[probes], place[probes + 1] - place[probes]
                    hit = n > 0
                    low, n = low[hit], n[hit]
                    if len(n):
                        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                        seen = order[at]
                        distance[seen] = np.bitwise_count(self.words[seen] ^ query).sum(axis=1)
                covered = count * radius + a
                near = distance <= covered
                if near.sum() >= k:
                    last = np.partition(distance[near], k - 1)[k - 1]
                    rows = np.flatnonzero(distance <= last)
                    return rows, distance[rows]
        rows = np.flatnonzero(distance <= self.width)
        return rows, distance[rows]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(query_id, rank, id, distance): for every query row the ``k`` other rows of smallest Hamming distance.

    Ties go to the smaller identifier. A row is not its own neighbour; rows with its identifier are the same row.
    Only vectors of equal length are compared. Rows without identifier or vector take no part.
    """
    codes = stored(sign_codes(vectors, id_col, vector_col).where("id IS NOT NULL").join(
        vectors.select(F.col(id_col).alias("id")).where(is_query & F.col(id_col).isNotNull()).distinct()
        .withColumn("asked", F.lit(True)), "id", "left"), "codes")
    n_rows, n_queries = codes.agg(F.count(F.lit(1)), F.count("asked")).head()
    parallel = vectors.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(parallel, -(-n_rows // block_rows))
    n_chunks = max(1, -(-n_queries // chunk_rows))

    # a result needs no more than k + 1 identifiers of one code: k, and the query itself
    by_code = Window.partitionBy("width", "code").orderBy("id")
    few = codes.select("id", "width", "code").distinct().withColumn("rank", F.row_number().over(by_code)).where(F.col("rank") <= k + 1)
    held = few.groupBy("width", "code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    chunks = F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk")
    block = F.pmod(F.xxhash64("code"), F.lit(n_blocks)).cast("int").alias("block")
    left = held.select("width", "code", "ids", block, chunks)
    asked = codes.where("asked").select("id", "width", "code").distinct()
    right = asked.select(
        "id", "width", "code", F.pmod(F.xxhash64("id"), F.lit(n_chunks)).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))

    def search(block: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(block) and len(chunk):
            index = MultiIndex(list(block["code"]), int(block["width"].iloc[0]))
            ids = list(block["ids"])
            for query, code in zip(chunk["id"], chunk["code"]):
                rows, distances = index.search(code, k + 1)
                best = sorted(
                    (int(d), i) for row, d in zip(rows, distances) for i in ids[row] if i != query)[:k]
                found += [(query, i, d) for d, i in best]
        return pd.DataFrame(found, columns=["query_id", "id", "distance"])

    kind = codes.schema["id"].dataType.simpleString()
    keys = ["width", "block", "chunk"]
    # the rows are small, the work is not: each pair of block and chunk is to be a task
    tasks = n_blocks * n_chunks
    found = left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(
        search, f"query_id {kind}, id {kind}, distance int")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "id", "distance")
