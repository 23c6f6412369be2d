"""Exact join of documents by the Jaccard similarity of their word shingles, in the metric space of Jaccard distance.

Nearly all distances between unrelated documents are 1, where no pivot tells anything. So the space is first cut
exactly. Sets that differ in at most d elements agree on all but d parts of the universe, so two documents that link
share a signature (size class, part, elements in it). Of the documents that share one, two can link only if
their sketches allow it: the numbers of elements by hash, whose smaller ones add up to a bound of the overlap. The
regions joined below are the connected sets of documents that share signatures and pass this bound; no link leaves
a region.

Within a region pivots are chosen and the distance of every member to every pivot is computed exactly. A member
belongs to the Voronoi cell of its nearest pivot, and is copied into the cell of another pivot if its distance to it
exceeds that to its nearest pivot by no more than two link distances, and the farthest member of that cell by no
more than one: by the triangle inequality only then it can link with a member of the cell. Cells are joined the
same way until a few members are left, which are compared with each other. A cell whose members are already connected
is done.

A region within ``region_size`` shingles is joined inside one task. A larger one is cut into cells by Spark: chunks
of its members meet the pivots, and cells become regions. What does not get smaller in ``MAX_DEPTH`` rounds is joined
block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from math import ceil, floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlab.llm.common import ROW, Words, document_batches, mix64, numbered, text_slices, tidy, views
from postlab.llm.components import components
from postlab.session import stored

#: Shingles of a region that one task joins.
REGION_SIZE = 4 << 20
#: Signatures that a task collects before it sends them, and signatures of a partition that matches them.
FLUSH = 1 << 19
MATCH = 1 << 19
#: Parts beyond d + 1, as a share of these; as many of the smallest parts need no signature.
SPARE = 0.35
#: Elements per number of a sketch, its smallest length, and documents of a signature that one task compares.
SKETCH_FILL = 8
SKETCH = 64
SHARED = 10_000
#: Pivots of a large region, members of a chunk that meets them, rounds of cutting.
PIVOTS = 16
CHUNK = 2000
MAX_DEPTH = 6
#: Members of a cell that are compared with each other, and pivots of a cell inside a task.
LEAF = 12
CELL_PIVOTS = 4
#: Sizes of a class differ by this factor at most, or by what links allow if that is more.
CLASS_RATIO = 1.5
_TURN = np.uint64(0x9E3779B97F4A7C15)


# ---- shingle sets -------------------------------------------------------------------------------------------------

def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of ``n`` words, or of all if there are fewer; none without words."""
    words = Words(texts, lower=True)
    windows = words.windows(n)
    for begin, end in zip(words.first[:-1], words.first[1:]):
        if end - begin >= n:
            yield np.unique(windows[begin:end - n + 1])
        elif end > begin:
            placed = words.hash[begin:end] + np.arange(end - begin, dtype=np.uint64) * _TURN
            yield mix64(np.bitwise_xor.reduce(mix64(placed), keepdims=True) + np.uint64(end - begin))
        else:
            yield np.zeros(0, dtype=np.uint64)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent hashes of a set, as signed numbers."""
    size = np.array([len(shingles)], dtype=np.uint64)
    first = mix64(shingles.sum(dtype=np.uint64) + size * _TURN)
    second = mix64(mix64(shingles ^ _TURN).sum(dtype=np.uint64) + size)
    return int(first.view(np.int64)[0]), int(second.view(np.int64)[0])


class Signatures:
    """The signatures of a set, such that two sets of the given similarity share at least one."""

    def __init__(self, similarity: Fraction):
        self.similarity = similarity
        self.ratio = max(CLASS_RATIO, 1 / similarity)  # so that a set links with its own class and its neighbours only
        self.bounds = [2]  # class c holds the sizes from bounds[c - 1] to bounds[c] - 1

    def _class(self, size: int) -> int:
        while self.bounds[-1] <= size:
            self.bounds.append(max(self.bounds[-1] + 1, ceil(self.bounds[-1] * self.ratio)))
        return next(c for c, bound in enumerate(self.bounds) if size < bound)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        size = len(shingles)
        own = self._class(size)
        self._class(self.bounds[own])  # so that the next class has a bound
        found = [self._of_class(shingles, own)]
        if size >= self.similarity * self.bounds[own]:  # it can link with a set of the next class
            found.append(self._of_class(shingles, own + 1))
        return np.concatenate(found)

    def _of_class(self, shingles: np.ndarray, number: int) -> np.ndarray:
        # sets of at most ``most`` elements that link differ in at most ``d``
        most = self.bounds[number] - 1
        d = floor((1 - self.similarity) / (1 + self.similarity) * 2 * most)
        spare = ceil(SPARE * (d + 1)) if d else 0
        parts = d + 1 + spare
        part = (shingles % np.uint64(parts)).astype(np.int64)
        value = mix64(shingles + np.uint64(number))
        low = np.bincount(part, weights=(value & np.uint64(0xFFFFFFFF)).astype(float), minlength=parts)
        high = np.bincount(part, weights=(value >> np.uint64(32)).astype(float), minlength=parts)
        held = np.bincount(part, minlength=parts)
        named = np.arange(parts, dtype=np.uint64) * _TURN + np.uint64(number * 1000003 + 17)
        signatures = mix64(mix64(low.astype(np.uint64) + named) ^ high.astype(np.uint64))
        # Two linked sets agree on 1 + spare parts at least. Each set leaves out parts below a size of its own that no
        # more than ``spare`` of its parts are below; above the larger of both sizes an agreeing part is left.
        least = np.partition(held, spare)[spare]
        signatures = signatures[held >= max(least, 1)]
        # Sets with more than ``spare`` empty parts might agree on empty parts only: here elements are signatures too.
        return signatures if least else np.concatenate([signatures, mix64(value ^ _TURN)])


def sketch(shingles: np.ndarray) -> bytes:
    """How many elements have each lowest bits of the hash; empty if a number does not fit a byte."""
    length = SKETCH
    while length * SKETCH_FILL < len(shingles):
        length *= 2
    counts = np.bincount((shingles & np.uint64(length - 1)).astype(np.int64), minlength=length)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_link(sketches: list[bytes], sizes: np.ndarray, similarity: Fraction) -> list[int]:
    """The smallest index of the component of each set, connecting those that the sketches allow to link."""
    label, open_ = list(range(len(sizes))), np.arange(len(sizes))
    blind = any(len(s) == 0 for s in sketches)
    if blind:
        return [0] * len(sizes)
    length = min(map(len, sketches))
    table = np.stack([
        np.frombuffer(s, np.uint8).reshape(-1, length).sum(axis=0, dtype=np.uint16) for s in sketches])
    top, bottom = similarity.numerator, similarity.denominator
    while len(open_):
        front, root, open_ = [int(open_[0])], int(open_[0]), open_[1:]
        while front and len(open_):
            one = front.pop()
            common = np.minimum(table[open_], table[one]).sum(axis=1, dtype=np.int64)
            near = bottom * common >= top * (sizes[open_] + sizes[one] - common)
            for x in open_[near]:
                label[x] = root
                front.append(int(x))
            open_ = open_[~near]
    return label


# ---- regions inside a task --------------------------------------------------------------------------------------------

class _Forest:
    def __init__(self, size: int):
        self.parent = list(range(size))

    def find(self, a: int) -> int:
        while self.parent[a] != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def join_region(sets: list[np.ndarray], similarity: Fraction) -> list[int]:
    """The smallest index of the component of each set, linking sets of at least the given similarity."""
    forest, reach = _Forest(len(sets)), float(1 - similarity) + 1e-9
    size = np.array([len(s) for s in sets])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    values, element = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(values), dtype=bool)
    top, bottom = similarity.numerator, similarity.denominator

    def distances(pivot: int, cell: np.ndarray, of_cell: np.ndarray, begin: np.ndarray) -> np.ndarray:
        own = element[start[pivot]:start[pivot] + size[pivot]]
        marked[own] = True
        common = np.add.reduceat(marked[of_cell], begin, dtype=np.int64)
        marked[own] = False
        union = size[pivot] + size[cell] - common
        for other in cell[bottom * common >= top * union]:
            forest.link(pivot, int(other))
        return 1 - common / union

    cells = [np.arange(len(sets))]
    while cells:
        cell = cells.pop()
        roots = np.array([forest.find(int(x)) for x in cell])
        if (roots == roots[0]).all():
            continue
        n = size[cell]
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        of_cell = element[np.repeat(start[cell] - begin, n) + np.arange(n.sum())]
        if len(cell) <= LEAF:
            for pivot in cell[:-1]:
                distances(int(pivot), cell, of_cell, begin)
            continue
        chosen = np.unique(np.linspace(0, len(cell) - 1, CELL_PIVOTS).astype(int))
        table = np.stack([distances(int(cell[i]), cell, of_cell, begin) for i in chosen])
        rest = np.setdiff1d(np.arange(len(cell)), chosen)
        table, rest = table[:, rest], cell[rest]
        cells += _cut(rest, table, reach)
    return [forest.find(i) for i in range(len(sets))]


def _cut(members: np.ndarray, table: np.ndarray, reach: float) -> list[np.ndarray]:
    """The Voronoi cells with their windows; the members as they are if a cell would hold most of them."""
    nearest, near = table.argmin(axis=0), table.min(axis=0)
    found = []
    for pivot, row in enumerate(table):
        core = nearest == pivot
        if core.any():
            inside = core | (row <= np.minimum(near + 2 * reach, row[core].max() + reach))
            found.append(members[inside])
    if max(len(f) for f in found) > 0.7 * len(members):
        return [members]
    return [f for f in found if len(f) > 1]


# ---- tables ---------------------------------------------------------------------------------------------------------

def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _describe(docs: DataFrame, n: int) -> DataFrame:
    """(id, n, key, second) of every row."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1, 1 << 20):
            found = [(len(s), *set_key(s)) for s in shingle_sets(batch.column(1), n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), pa.int64()) for c in zip(*found))], names=["id", "n", "key", "second"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, n bigint, key bigint, second bigint")


def _match(signature: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(region, key) of keys that share a signature; equal lists of keys are one region."""
    order = np.lexsort((key, signature))
    signature, key = signature[order], key[order]
    new = np.concatenate([[True], (signature[1:] != signature[:-1]) | (key[1:] != key[:-1])])
    signature, key = signature[new], key[new]
    begin = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]]))
    count = np.diff(np.append(begin, len(key)))
    named = mix64(np.add.reduceat(mix64(key.view(np.uint64)), begin) + count.astype(np.uint64))
    several = np.flatnonzero(count > 1)
    several = several[np.unique(named[several], return_index=True)[1]]
    at = np.repeat(begin[several] - np.cumsum(count[several]) + count[several], count[several]) + np.arange(count[several].sum())
    return np.repeat(named[several], count[several]).view(np.int64), key[at]


def _shared_signatures(docs: DataFrame, n: int, similarity: Fraction, parts: int) -> DataFrame:
    """(region, key): keys of different sets that share a signature, packed by ranges of signatures on the way.

    A set is sent once per flush of a task, however many documents have it.
    """
    @tidy
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures, held, keys, seen = Signatures(similarity), [], [], set()

        def flush() -> pa.RecordBatch:
            signature, key = np.concatenate(held), np.repeat(np.array(keys, dtype=np.int64), [len(h) for h in held])
            part = ((signature >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            signature, key, part = signature[order], key[order], part[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            rows = [(p, signature[s:e].tobytes(), key[s:e].tobytes()) for p, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                names=["part", "signatures", "keys"])

        for batch in text_slices(batches, 0, 1 << 20):
            for shingles in shingle_sets(batch.column(0), n):
                key = set_key(shingles)[0] if len(shingles) else None
                if key is None or key in seen:
                    continue
                seen.add(key)
                held.append(signatures(shingles))
                keys.append(key)
            if sum(map(len, held)) >= FLUSH:
                yield flush()
                held, keys, seen = [], [], set()
        if held:
            yield flush()

    @tidy
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: dict[int, list] = {}
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), views(batch.column(1), np.uint64), views(batch.column(2), np.int64))
            for part, signature, key in rows:
                packed.setdefault(part, []).append((signature, key))
        while packed:
            _, rows = packed.popitem()
            region, key = _match(*(np.concatenate(c) for c in zip(*rows)))
            yield pa.RecordBatch.from_arrays([pa.array(region), pa.array(key)], names=["region", "key"])

    sent = docs.select("text").mapInArrow(collect, "part int, signatures binary, keys binary").repartition(parts, "part")
    return sent.mapInArrow(match, "region bigint, key bigint").distinct()


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(key, n, sketch, set) of ``wanted`` (key, id): the texts are read again for those that need it."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1, 1 << 20):
            rows = [
                (key, len(s), sketch(s), s.tobytes())
                for key, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), n))
                if len(s) and set_key(s)[0] == key  # rows may share an identifier
            ]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["key", "n", "sketch", "set"])

    asked = wanted.select(F.col("id").alias("asked"), "key")
    return docs.join(asked, F.col("id").eqNullSafe(F.col("asked"))).select("key", "text").mapInArrow(
        run, "key bigint, n bigint, sketch binary, set binary")


def _narrowed(shared: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """Links (a, b) that connect the keys of a region (region, key) whose sketches allow a link.

    Regions of more than ``SHARED`` keys are compared block by block.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, region in group.groupby("region", sort=False):
            region = region.drop_duplicates("key").sort_values("key")
            keys = region["key"].to_numpy()
            label = may_link(list(region["sketch"]), region["n"].to_numpy(), similarity)
            found += {(int(keys[r]), int(keys[i])) for i, r in enumerate(label) if r != i}
        return pd.DataFrame(list(set(found)), columns=["a", "b"], dtype="int64")

    counts = shared.groupBy("region").agg(F.ceil(F.count(F.lit(1)) * 2 / SHARED).cast("int").alias("blocks"))
    placed = shared.join(counts, "region")
    small = placed.where("blocks <= 2").select("region", "key")
    block, other = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    large = placed.where("blocks > 2").select("region", "key", block.alias("block"), other.alias("other")).select(
        F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other")).alias("region"), "key")
    rows = small.unionByName(large).join(sets.select("key", "n", "sketch"), "key")
    tasks = max(shared.sparkSession.sparkContext.defaultParallelism * 4, shared.count() // (4 * SHARED))
    bucket = F.pmod(F.xxhash64("region"), F.lit(tasks))
    return rows.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(run, "a bigint, b bigint").distinct()


def _unpack(packed: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(s, dtype=np.uint64) for s in packed]


def _join_small(members: DataFrame, similarity: Fraction, total: int, size: int) -> DataFrame:
    """Links (a, b) of every member with the smallest one of its component, for regions that fit a task."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, region in group.groupby("region", sort=False):
            region = region.drop_duplicates("key").sort_values("key")
            keys = region["key"].to_numpy()
            roots = join_region(_unpack(region["set"]), similarity) if len(keys) > 1 else [0]
            found += [(keys[r], keys[i]) for i, r in enumerate(roots) if r != i]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    tasks = max(members.sparkSession.sparkContext.defaultParallelism * 4, -(-total * 4 // size))
    bucket = F.pmod(F.xxhash64("region"), F.lit(tasks))
    return members.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(run, "a bigint, b bigint")


def _cut_large(members: DataFrame, similarity: Fraction, depth: int) -> tuple[DataFrame, DataFrame]:
    """One round of pivots for regions too large for a task: links (a, b), and the members of the cells as new regions."""
    reach = float(1 - similarity) + 1e-9
    top, bottom = similarity.numerator, similarity.denominator
    counts = members.groupBy("region").agg(F.count(F.lit(1)).alias("members"))
    chunked = members.join(counts, "region").withColumn("chunks", F.ceil(F.col("members") / CHUNK)).withColumn(
        "chunk", F.pmod(F.xxhash64("key"), F.col("chunks")))
    order = Window.partitionBy("region").orderBy(F.xxhash64("key", F.lit(depth)), "key")
    pivots = members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PIVOTS)
    pivots = pivots.join(counts, "region").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("members") / CHUNK) - 1))
    ).select(F.col("region").alias("p_region"), F.col("chunk").alias("p_chunk"), F.col("key").alias("p_key"),
             F.col("set").alias("p_set"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        chosen = list(zip(right["p_key"], _unpack(right["p_set"])))
        own = {key for key, _ in chosen}
        for region, key, shingles in zip(left["region"], left["key"], _unpack(left["set"])):
            measured = []
            for pivot, other in chosen:
                common = len(np.intersect1d(shingles, other, assume_unique=True))
                union = len(shingles) + len(other) - common
                measured.append((1 - common / union, pivot, bottom * common >= top * union))
            near, nearest, _ = min(measured)
            rows += [
                (region, pivot, key, d, near, pivot == nearest, linked, key in own) for d, pivot, linked in measured
                if linked or d <= near + 2 * reach]
        return pd.DataFrame(rows, columns=["region", "pivot", "key", "d", "near", "core", "linked", "is_pivot"])

    measured = stored(chunked.select("region", "chunk", "key", "set").groupBy("region", "chunk").cogroup(
        pivots.groupBy("p_region", "p_chunk")).applyInPandas(
        run, "region bigint, pivot bigint, key bigint, d double, near double, core boolean, linked boolean, is_pivot boolean"),
        "cells")
    links = measured.where("linked AND pivot <> key").select(F.col("pivot").alias("a"), F.col("key").alias("b"))
    cells = measured.where("NOT is_pivot")
    radius = cells.where("core").groupBy("region", "pivot").agg(F.max("d").alias("radius"))
    inside = cells.join(radius, ["region", "pivot"]).where(
        F.col("core") | (F.col("d") <= F.least(F.col("near") + 2 * reach, F.col("radius") + reach)))
    # a cell whose members all link with the pivot is connected
    open_cells = inside.groupBy("region", "pivot").agg(F.bool_and("linked").alias("done")).where("NOT done")
    kept = inside.join(open_cells, ["region", "pivot"], "left_semi").select(
        F.xxhash64("region", "pivot", F.lit(depth)).alias("cell"), "region", "key")
    return links, kept.join(members, ["region", "key"]).select(F.col("cell").alias("region"), "key", "n", "set")


def _join_blocks(members: DataFrame, similarity: Fraction, size: int) -> DataFrame:
    """Links of regions that pivots do not cut: every two blocks of a region meet in one task."""
    totals = members.groupBy("region").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") * 4 / size)).cast("int").alias("blocks"))
    placed = members.join(totals, "region").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = placed.withColumn("other", other).select(
        F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other")).alias("region"), "key", "n", "set")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("key").sort_values("key")
        keys = group["key"].to_numpy()
        roots = join_region(_unpack(group["set"]), similarity)
        return pd.DataFrame([(keys[r], keys[i]) for i, r in enumerate(roots) if r != i], columns=["a", "b"], dtype="int64")

    return paired.groupBy("region").applyInPandas(run, "a bigint, b bigint")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85,
                      region_size: int = REGION_SIZE) -> DataFrame:
    """(id, n_shingles, component_id) of every row: component_id is the smallest identifier reachable by links.

    Words are runs of characters other than blank and \\\\x09-\\\\x0D, with A-Z lower-cased; a document's set holds its
    distinct shingles of ``n`` words, or all its words as one if there are fewer. Two documents link if their sets
    have a Jaccard similarity of ``percent`` or more. A null text, or one without words, has no shingle and links
    with nothing: its component is its own identifier. Rows of equal sets link, whatever their identifiers; a null
    identifier counts only if a component has no other.
    """
    document_batches(docs.sparkSession)
    similarity = Fraction(percent, 100)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = stored(_describe(docs, n), "shingles")
    sets = rows.where("n > 0").groupBy("key").agg(
        F.min("id").alias("id"), F.min("n").alias("n"), F.max("n").alias("n2"),
        F.min("second").alias("second"), F.max("second").alias("second2"))
    sets = stored(sets, "sets")
    clash, total = sets.agg(F.coalesce(F.bool_or(F.expr("n <> n2 OR second <> second2")), F.lit(False)), F.sum("n")).head()
    if clash:
        raise RuntimeError("two different shingle sets have the same 64-bit key")
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, (total or 0) // 3 // MATCH)

    shared = stored(_shared_signatures(docs, n, similarity, parts), "shared")
    wanted = sets.join(shared.select("key").distinct(), "key").select("key", "id")
    kept = stored(_sets(docs, wanted, n).dropDuplicates(["key"]), "kept")
    regions = components(_narrowed(shared, kept, similarity))
    members = kept.select("key", "n", "set").join(
        regions.select(F.col("node").alias("key"), F.col("label").alias("region")), "key")

    links, large = [], members
    for depth in range(MAX_DEPTH + 1):
        sizes = large.groupBy("region").agg(F.sum("n").alias("size"))
        few = sizes.where(F.col("size") <= region_size).select("region")
        held = large.agg(F.sum("n")).head()[0] or 0
        links.append(_join_small(large.join(few, "region", "left_semi"), similarity, held, region_size))
        large = large.join(sizes.where(F.col("size") > region_size).select("region"), "region", "left_semi")
        if large.isEmpty():
            break
        if depth == MAX_DEPTH:
            links.append(_join_blocks(large, similarity, region_size))
            break
        found, cells = _cut_large(large, similarity, depth)
        links.append(found)
        large = stored(cells, "cells")
    linked = reduce(DataFrame.unionByName, links)
    # regions of the first round are disjoint: what their tasks say is final
    joined = stored(linked.select(F.col("b").alias("node"), F.col("a").alias("label")), "joined") if len(links) == 1 else (
        components(linked))

    named = sets.select("key", "id").join(joined.withColumnRenamed("node", "key"), "key", "left").select(
        "key", F.coalesce("label", "key").alias("label"), "id")
    smallest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    of_key = named.join(smallest, "label").select("key", "component_id")
    linkable = rows.where("n > 0").join(of_key, "key").select("id", "n", "component_id")
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linkable.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80,
                 **sizes: int) -> DataFrame:
    """The rows of ``docs`` with all their columns, but of each component only the one of the smallest identifier.

    Rows that share an identifier are told apart by their texts.
    """
    # one struct column, so that names in ``docs`` cannot clash with others
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("doc")
    rows = numbered(docs.select(whole, F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    kept = similar_documents(rows, ROW, "text", n, percent, **sizes).where(F.col(ROW) == F.col("component_id"))
    return rows.select(ROW, "doc").join(kept.select(ROW), ROW, "left_semi").select("doc.*")
