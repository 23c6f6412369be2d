"""Helpers for work on Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlab.operators.position import with_position
from postlab.session import stored


#: Rows of an Arrow batch: rows are whole texts here, and Spark's own number suits short rows.
BATCH_ROWS = 1000


def document_batches(spark: SparkSession) -> None:
    """Let the session send at most ``BATCH_ROWS`` rows at once to Python; a batch of long texts has to fit in memory
    several times, in the JVM and in Python, for each task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(task: Task) -> Task:
    """A task that gives its free memory back when it ends: Python workers wait for the next task and keep it otherwise."""
    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # only the C library of Linux has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def views(column: pa.Array, kind: type) -> list[np.ndarray]:
    """The packed numbers of each row of a binary column, not copied."""
    return [np.frombuffer(value.as_buffer(), dtype=kind) for value in column]


def text_slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts (or bytes) of ``column`` in one part hold about ``limit`` bytes, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = _lengths(batch.column(column))
        part = np.cumsum(lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield batch.slice(start, end - start)


def _lengths(values: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    found = pc.binary_length(values)
    return np.asarray(pc.fill_null(found, 0)).astype(np.int64)


# ---- words of whole batches -----------------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, one to one (the finishing step of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _byte_values(lower: bool) -> np.ndarray:
    values = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
    if lower:
        values[ord("A"):ord("Z") + 1] = values[ord("a"):ord("z") + 1]
    return values


class Words:
    """The words (runs of bytes other than blank and \\x09-\\x0D) of a batch of texts, with 64-bit hashes.

    ``first`` has, per text, the number of its first word, and at the end the number of all words. ``begin`` and
    ``end`` are byte positions in ``data``. With ``lower``, A-Z count as a-z. A null text has no words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        whole = texts.buffers()[2]
        self.data = np.frombuffer(whole, dtype=np.uint8)[bounds[0]:bounds[-1]] if whole else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        solid = ~_SPACE[self.data]
        opens = np.zeros(len(self.data) + 1, dtype=bool)
        opens[bounds] = True
        before = np.concatenate([[True], ~solid])
        self.begin = np.flatnonzero(solid & (before[:-1] | opens[:-1]))
        self.end = np.flatnonzero(solid & (np.concatenate([before[1:], [True]])[1:] | opens[1:])) + 1
        self.first = np.searchsorted(self.begin, bounds)
        length = self.end - self.begin
        if len(length):
            starts = np.concatenate([[0], np.cumsum(length)[:-1]])
            place = np.arange(length.sum()) - np.repeat(starts, length)
            power = np.cumprod(np.full(length.max(), _BASE))
            value = _byte_values(lower)[self.data[solid]] * power[place]
            self.hash = mix64(np.add.reduceat(value, starts) + length.astype(np.uint64))
        else:
            self.hash = np.zeros(0, dtype=np.uint64)

    def windows(self, n: int, base: np.uint64 = _BASE) -> np.ndarray:
        """Hashes of the ``n`` words from each word on, over the whole batch; a window may run into the next text.

        Another odd ``base`` gives another, independent hash.
        """
        count = max(0, len(self.hash) - n + 1)
        total = np.zeros(count, dtype=np.uint64)
        for k in range(n):
            total = (total + self.hash[k:k + count]) * base
            total ^= total >> np.uint64(29)
        return mix64(total)


def codes(text: str) -> np.ndarray:
    """Code points of a lower-cased text."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


@cache
def _letters() -> np.ndarray:
    """Which code points of the basic plane are letters."""
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def words_only(points: np.ndarray) -> np.ndarray:
    """Letters with one blank for each run of other characters; beyond the basic plane all count as letters."""
    table = _letters()
    letter = table[np.minimum(points, 0xFFFF)] | (points > 0xFFFF)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, points, np.uint32(32))[keep]


def grams(points: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Hashed buckets (0 … 2**bits - 1) of all n-grams of code points, repeats included."""
    found = []
    for n in orders:
        count = len(points) - n + 1
        if count <= 0:
            continue
        hashed = np.full(count, n, dtype=np.uint32)
        for k in range(n):
            hashed ^= points[k:k + count]
            hashed *= np.uint32(0x9E3779B1)
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x85EBCA6B)
        found.append(hashed >> np.uint32(32 - bits))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)


class Distinct:
    """Distinct buckets of an array without sorting; keeps one table of 2**bits entries."""

    def __init__(self, bits: int):
        self.last = np.zeros(1 << bits, dtype=np.int64)

    def __call__(self, buckets: np.ndarray) -> np.ndarray:
        at = np.arange(len(buckets))
        self.last[buckets] = at  # the last position of a bucket stays
        return buckets[self.last[buckets] == at]


# ---- samples ----------------------------------------------------------------------------------------------------

def below(id_col: Column, share: Column) -> Column:
    """Whether the hash of an identifier is among the lowest ``share`` of all; keeps a ranking of hashes small."""
    return F.xxhash64(id_col).cast("double") / 2.0**64 + 0.5 < share


# ---- rows of their own ----------------------------------------------------------------------------------------

ROW = "_row_number"


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with a number of its own for each row in ``ROW``, in the order of the identifiers.

    Identifiers that are whole numbers, present and unique are the numbers. Otherwise rows are numbered by
    identifier, null last; rows that share one follow by a hash of their text.
    """
    kind = docs.schema[id_col].dataType.typeName()
    ids = docs.select(F.col(id_col).alias("id"))
    odd = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("id IS NULL OR n > 1")
    if kind in ("byte", "short", "integer", "long") and odd.isEmpty():
        return docs.withColumn(ROW, F.col(id_col).cast("bigint"))
    tagged = stored(docs.withColumn("_tag", F.monotonically_increasing_id()), "tagged")
    order = [F.col("id").asc_nulls_last(), F.col("hash"), F.col("_tag")]
    numbers = with_position(tagged.select(
        F.col(id_col).alias("id"), "_tag", F.sha2(F.col(text_col), 256).alias("hash")), order, name=ROW)
    return tagged.join(numbers.select("_tag", ROW), "_tag").drop("_tag")
