"""A linear text classifier that learns embeddings: mean of term vectors, one output layer, softmax.

The vectors are a table (bucket, vector) and never whole in one place. Documents are dealt to shards of about ``shard_rows``
by a hash of their key. In every epoch a shard gets the vectors of its own buckets, goes once over its documents by stochastic
gradient descent, and returns the vectors; of each bucket the mean over the shards that hold it, weighted by their documents
with it, is the vector of the next epoch. The output layer is kept as further rows of the table with negative buckets. Means
are sums of whole numbers, and documents are met in the order of a hash, so the result is the same on any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab.operators.parts import own_names
from postlab.session import stored

# ---- fixed values: default settings ---------------------------------------------------------------------
DIM, RATE, EPOCHS, BUCKETS, WORD_NGRAMS = 100, 0.1, 5, 2_000_000, 1
SHARD_ROWS = 2000
# ---- end of fixed values -----------------------------------------------------------------------------------
#: Vectors are averaged in steps of 1/STEPS: sums of whole numbers do not depend on the order of the rows.
STEPS = 1 << 24
#: Rows that are added up at once.
MERGE_ROWS = 20_000
_SIDE = "bucket bigint, docs bigint, parts array<bigint>"


@dataclass(frozen=True)
class Settings:
    """Settings of a fit. ``word_ngrams`` 2 adds pairs of neighbouring terms."""

    dim: int = DIM
    rate: float = RATE
    epochs: int = EPOCHS
    buckets: int = BUCKETS
    word_ngrams: int = WORD_NGRAMS
    shard_rows: int = SHARD_ROWS
    seed: int = 1


def bags(docs: DataFrame, key: str, terms: str, settings: Settings) -> DataFrame:
    """(key, bucket, n) of the terms of each document; a document without terms has no row.

    A bucket is the remainder of a 64-bit hash, so different terms may share one.
    """
    words = F.coalesce(F.col(terms), F.array().cast("array<string>"))
    if settings.word_ngrams > 1:
        pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                           lambda a, b: F.concat(a, F.lit(" "), b))
        words = F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))
    term = docs.select(key, F.explode_outer(words).alias("_term")).where(F.col("_term").isNotNull())
    bucket = F.pmod(F.xxhash64("_term"), F.lit(settings.buckets)).alias("bucket")
    return term.groupBy(key, bucket).agg(F.count(F.lit(1)).alias("n"))


def _first_vector(settings: Settings) -> Column:
    """Values spread evenly over -1/dim to 1/dim, from a hash of bucket and place; zeros for the output layer."""
    def value(i: Column) -> Column:
        even = F.pmod(F.xxhash64(F.col("bucket"), i, F.lit(settings.seed)), F.lit(STEPS)) / F.lit(STEPS / 2) - 1
        return F.when(F.col("bucket") < 0, 0.0).otherwise(even / settings.dim)

    return F.transform(F.sequence(F.lit(0), F.lit(settings.dim - 1)), value)


def _descend(classes: int, rates: tuple[float, float]):
    """One pass over the documents of a shard; the rate falls from the first to the second value on the way."""
    def run(docs: pa.Table, vectors: pa.Table) -> pa.Table:
        names = vectors["bucket"].to_numpy()
        table = vectors["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).copy()
        order = np.argsort(names)
        output = order[np.searchsorted(names, [-1 - c for c in range(classes)], sorter=order)]
        docs = docs.take(pc.sort_indices(docs["turn"]))
        buckets, counts = docs["buckets"].combine_chunks(), docs["counts"].combine_chunks()
        ends = np.r_[0, np.cumsum(pc.list_value_length(buckets).to_numpy())]
        place = order[np.searchsorted(names, buckets.flatten().to_numpy(), sorter=order)]
        times = counts.flatten().to_numpy().astype(float)
        for step, label in enumerate(docs["label"].to_numpy()):
            rate = rates[0] + (rates[1] - rates[0]) * step / len(docs)
            rows, share = place[ends[step]:ends[step + 1]], times[ends[step]:ends[step + 1]]
            share = share / np.sum(share)
            hidden = share @ table[rows]
            score = table[output] @ hidden
            score = np.exp(score - score.max())
            error = -score / score.sum()
            error[int(label)] += 1.0
            back = error @ table[output]
            table[output] += rate * np.outer(error, hidden)
            table[rows] += rate * np.outer(share, back)
        parts = np.rint(table * STEPS).astype(np.int64) * vectors["docs"].to_numpy()[:, None]
        return _rows(names, {"docs": vectors["docs"].to_numpy()}, "parts", parts)

    return run


def _rows(buckets: np.ndarray, more: dict[str, np.ndarray], name: str, values: np.ndarray) -> pa.Table:
    """A table with a row of ``values`` for each bucket."""
    ends = np.arange(len(values) + 1, dtype="int32") * values.shape[1]
    return pa.table({"bucket": buckets, **more, name: pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))})


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, vector): the parts of each bucket added up as whole numbers, divided by its documents."""
    def added(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        names, sums = np.concatenate([n for n, _ in some]), np.concatenate([v for _, v in some])
        order = np.argsort(names, kind="stable")
        names = names[order]
        first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        return names[first], np.add.reduceat(sums[order], first, axis=0)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column("parts").flatten().to_numpy().reshape(batch.num_rows, -1)
        held.append((batch.column("bucket").to_numpy(), np.column_stack([batch.column("docs").to_numpy(), parts])))
        if sum(len(n) for n, _ in held[1:]) > max(len(held[0][0]), MERGE_ROWS):
            held = [added(held)]
    if held:
        names, sums = added(held)
        for at in range(0, len(names), MERGE_ROWS):
            some = sums[at:at + MERGE_ROWS].astype(float)
            yield from _rows(names[at:at + MERGE_ROWS], {}, "vector", some[:, 1:] / some[:, :1] / STEPS).to_batches()


@dataclass
class EmbeddedText:
    """A fitted classifier: ``vectors`` is (bucket, vector), with the output layer of class c as bucket -1 - c."""

    vectors: DataFrame
    classes: int
    key: str
    terms: str
    settings: Settings
    majority: int

    def transform(self, docs: DataFrame) -> DataFrame:
        """``docs`` with a column ``prediction``; ties go to the smaller class, documents of unknown terms only to the largest.

        Each bucket gets its scores first, so a document's terms are joined with one number per class.
        """
        layer = {r["bucket"]: r["vector"] for r in self.vectors.where("bucket < 0").collect()}  # one row per class

        def dot(c: int) -> Column:
            out = F.array(*[F.lit(float(x)) for x in layer[-1 - c]])
            return F.aggregate(F.zip_with("vector", out, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

        each = self.vectors.where("bucket >= 0").select("bucket", *[dot(c).alias(f"_s{c}") for c in range(self.classes)])
        scores = bags(docs, self.key, self.terms, self.settings).join(each, "bucket").groupBy(self.key).agg(
            *[F.sum(F.col("n") * F.col(f"_s{c}")).alias(f"_s{c}") for c in range(self.classes)])
        best = F.greatest(*[F.col(f"_s{c}") for c in range(self.classes)])
        choice = F.coalesce(*[F.when(F.col(f"_s{c}") == best, F.lit(c)) for c in range(self.classes)])
        return docs.join(scores.select(self.key, choice.cast("double").alias("_best")), self.key, "left").withColumn(
            "prediction", F.coalesce("_best", F.lit(float(self.majority)))).drop("_best")


def fit(train: DataFrame, key: str, terms: str, label: str, classes: int, settings: Settings = Settings()) -> EmbeddedText:
    """Fit on rows (key, terms, label) with unique keys and labels 0 to ``classes`` - 1; rows without label or terms are left out."""
    labelled = train.where(F.col(label).isNotNull())
    sizes = labelled.groupBy(F.col(label).cast("int").alias("c")).count().collect()  # one row per class
    if not sizes:
        raise ValueError("no labelled rows")
    majority = max(sizes, key=lambda r: (r["count"], -r["c"]))["c"]
    shards = max(1, -(-sum(r["count"] for r in sizes) // settings.shard_rows))
    names = own_names(train.sparkSession, shards)  # so that no two shards meet in a task
    shard = F.element_at(F.lit(names), F.pmod(F.xxhash64(F.col(key), F.lit(settings.seed)), F.lit(shards)).cast("int") + 1).alias("shard")
    pairs = bags(labelled, key, terms, settings).select(key, shard, "bucket", "n")
    docs = stored(
        pairs.groupBy(key, "shard").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("bag"))
        .join(labelled.select(key, F.col(label).cast("int").alias("label")), key)
        .select(key, "shard", "label", F.col("bag.bucket").alias("buckets"), F.col("bag.n").alias("counts")), "shards")
    layer = docs.groupBy("shard").agg(F.count(F.lit(1)).alias("docs")).select(
        "shard", F.explode(F.array(*[F.lit(-1 - c).cast("bigint") for c in range(classes)])).alias("bucket"), "docs")
    sides = stored(
        docs.select("shard", F.explode("buckets").alias("bucket")).groupBy("shard", "bucket")
        .agg(F.count(F.lit(1)).alias("docs")).unionByName(layer.select("shard", "bucket", "docs")), "sides")

    vectors = sides.select("bucket").distinct().withColumn("vector", _first_vector(settings))
    vectors = stored(vectors, "first") if settings.epochs else vectors
    for epoch in range(settings.epochs):
        rates = tuple(settings.rate * (1 - (epoch + e) / settings.epochs) for e in (0, 1))
        turned = docs.select(
            "shard", F.xxhash64(F.col(key), F.lit(settings.seed), F.lit(epoch)).alias("turn"), "label", "buckets", "counts")
        # by key, never broadcast: a row is far larger than Spark takes an array to be
        held = sides.join(vectors.hint("merge"), "bucket")
        both = [t.repartition(shards, "shard").groupBy("shard") for t in (turned, held)]
        passed = both[0].cogroup(both[1]).applyInArrow(_descend(classes, rates), _SIDE)
        n_tasks = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        vectors = stored(passed.repartition(n_tasks, "bucket").mapInArrow(_means, "bucket bigint, vector array<double>"), "vectors")
    return EmbeddedText(vectors, classes, key, terms, settings, majority)
