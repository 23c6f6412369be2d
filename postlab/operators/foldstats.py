"""Feature statistics of all training sides from one count.

A corpus is counted once, as a cube: (feature, value, held-out set, classes) with its number of documents. What a training
side holds is the total minus its held-out set, so document frequencies, idf and chi-square of every fold, of the hold-out split
and of the whole corpus, for all tasks, come from that one table, and nothing is counted again for a fold or a model.

Features are numbers: hashed terms from 0 to ``width`` - 1, dense scores from ``width`` on. A cell is a nonzero value of a
feature in a document; zeros follow from the class sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlab.functions.chi2 import log_p_value
from postlab.operators.parts import Matches, fields, flat, tallied
from postlab.operators.terms import chi_square_counts

#: Documents whose buckets are counted at once.
COUNT_ROWS = 1000
#: The side that holds out nothing.
WHOLE = -1


def six_digits(value: Column) -> Column:
    """A value rounded to six digits; ratios of small numbers lie at the edge between two of them, and go up whatever the
    noise in their last bit."""
    return F.round(value + 1e-9, 6) + 0.0


def hashed(term: Column) -> Column:
    """Hash of a term that plain SQL can repeat: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint")


def bucket(term: Column, width: int) -> Column:
    """``hashed`` to 0 … width - 1."""
    return (hashed(term) % width).cast("int")


def counts_column(width: int) -> str:
    """The column of a feature table that has the ``part_buckets`` of its stems."""
    return f"tf{width}"


#: An ML vector in Arrow.
_INDICES, _VALUES = (pa.list_(pa.field("element", kind, False)) for kind in (pa.int32(), pa.float64()))
_VECTOR = [pa.field("type", pa.int8(), False), pa.field("size", pa.int32()), pa.field("indices", _INDICES), pa.field("values", _VALUES)]


def part_buckets(stem: Matches, widths: tuple[int, ...]) -> list[pa.Array]:
    """The ``bucket`` counts of each document of a part as sparse ML vectors, one array per width; the word table has the stems' ``hash``."""
    hashes = pc.fill_null(stem.table["hash"].combine_chunks(), -1).to_numpy()
    known = stem.at >= 0
    known[known] = hashes[stem.at[known]] >= 0
    owner, hashed = stem.group[stem.row[known]], hashes[stem.at[known]]
    place = pa.array(np.where(stem.null_key, stem.groups, stem.group))  # the last one is empty
    made = []
    for width in widths:
        pair, times = tallied(owner * width + hashed % width)
        ends = pa.array(np.searchsorted(pair, np.arange(stem.groups + 2) * width).astype("int32"))
        made.append(pa.StructArray.from_arrays([
            pa.array(np.zeros(len(place), dtype="int8")), pa.array(np.full(len(place), width, dtype="int32")),
            pa.ListArray.from_arrays(ends, pa.array((pair % width).astype("int32")), type=_INDICES).take(place),
            pa.ListArray.from_arrays(ends, pa.array(times.astype("float64")), type=_VALUES).take(place)], fields=_VECTOR))
    return made


def bucket_counts(docs: DataFrame, keys: list[str], width: int, tokens: str = "stems") -> DataFrame:
    """(keys, feature, value): how often each bucket occurs in a document."""
    hit = docs.select(*keys, F.explode_outer(tokens).alias("_term")).where(F.col("_term").isNotNull())
    return hit.groupBy(*keys, bucket(F.col("_term"), width).alias("feature")).agg(
        F.count(F.lit(1)).cast("double").alias("value"))


def row_bucket_counts(docs: DataFrame, keys: list[str], width: int, tokens: str = "stems") -> DataFrame:
    """``bucket_counts`` for keys that no two rows share: each row is counted where it lies, and no pair is moved.

    Rows that come with their counts (``counts_column``) are not counted again.
    """
    if counts_column(width) in docs.columns:
        raw = F.unwrap_udt(counts_column(width))
        cells = docs.select(*keys, F.explode(F.arrays_zip(raw["indices"].alias("f"), raw["values"].alias("v"))).alias("_cell"))
        return cells.select(*keys, F.col("_cell.f").alias("feature"), F.col("_cell.v").alias("value"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, COUNT_ROWS):
                some = batch.slice(start, COUNT_ROWS)
                hit, sizes = flat(pa.chunked_array([some.column("_buckets")]))
                pair = np.repeat(np.arange(some.num_rows), sizes) * width + hit.to_numpy(zero_copy_only=False)
                pair, times = tallied(pair)
                own = some.select(keys).take(pa.array(pair // width))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array((pair % width).astype("int32")), pa.array(times.astype("float64"))],
                                                 [*keys, "feature", "value"])

    there = F.filter(tokens, lambda t: t.isNotNull())
    hashed = docs.select(*keys, F.transform(there, lambda t: bucket(t, width)).alias("_buckets"))
    return hashed.mapInArrow(counted, f"{fields(docs, keys)}, feature int, value double")


def dense_cells(docs: DataFrame, keys: list[str], values: Column, first: int) -> DataFrame:
    """(keys, feature, value) of the nonzero entries of an array, numbered from ``first`` on."""
    cells = docs.select(*keys, F.posexplode(values).alias("_at", "value"))
    return cells.where(F.col("value") != 0).select(*keys, (F.col("_at") + first).alias("feature"), "value")


def cube(cells: DataFrame, parts: list[str], tasks: list[str]) -> DataFrame:
    """(feature, value, parts, tasks, n): the number of documents; one shuffle of pre-aggregated counts.

    ``parts`` name the columns that say which held-out sets a document belongs to, ``tasks`` its classes.
    """
    return cells.groupBy("feature", "value", *parts, *tasks).agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Side:
    """A training side: ``number`` names it, ``held`` is true for documents that it does not see."""

    number: int
    held: Column


def sides(k: int, fold: str = "fold", holdout: str | None = None) -> list[Side]:
    """The whole corpus, the ``k`` folds, and with ``holdout`` (a boolean column) the side -2 without those rows."""
    found = [Side(WHOLE, F.lit(False)), *(Side(f, F.col(fold) == f) for f in range(k))]
    return found + ([Side(-2, F.col(holdout))] if holdout else [])


def _trained(n: Column, side: Side) -> Column:
    """Total minus what the side holds out."""
    return F.sum(n) - F.sum(F.when(side.held, n).otherwise(0))


def side_rows(rows: DataFrame, parts: list[Side], task: str, classes: list[int]) -> dict[int, list[int]]:
    """Documents per class on each training side; a few numbers."""
    row = rows.agg(*[
        _trained(F.when(F.col(task) == c, 1).otherwise(0), s).alias(f"s{i}_{c}") for i, s in enumerate(parts) for c in classes
    ]).first()
    return {s.number: [int(row[f"s{i}_{c}"] or 0) for c in classes] for i, s in enumerate(parts)}


def document_frequencies(counted: DataFrame, parts: list[Side]) -> DataFrame:
    """(side, feature, df): how many documents of a training side have a feature; without those that none has."""
    wide = counted.groupBy("feature").agg(*[_trained(F.col("n"), s).alias(f"s{i}") for i, s in enumerate(parts)])
    each = F.explode(F.array(*[F.struct(F.lit(s.number).alias("side"), F.col(f"s{i}").alias("df")) for i, s in enumerate(parts)]))
    return wide.select("feature", each.alias("e")).select("e.side", "feature", "e.df").where("df > 0")


def idf_sides(counted: DataFrame, parts: list[Side], sizes: dict[int, list[int]]) -> DataFrame:
    """(side, feature, df, idf) with idf = ln((N + 1) / (df + 1)) over the N documents of a training side."""
    return document_frequencies(counted, parts).withColumn("idf", F.ln((_per_side(sizes, sum) + 1) / (F.col("df") + 1)))


def _per_side(sizes: dict[int, list[int]], value) -> Column:
    """A number that depends on the side, as a literal lookup; there are as many entries as sides."""
    pairs = [F.lit(x) for number, rows in sizes.items() for x in (number, float(value(rows)))]
    return F.create_map(*pairs)[F.col("side")]


def chi_square_sides(counted: DataFrame, parts: list[Side], task: str, classes: list[int],
                     sizes: dict[int, list[int]]) -> DataFrame:
    """(side, feature, statistic, dof) of every feature on every training side."""
    wide = counted.groupBy("feature", "value").agg(*[
        _trained(F.when(F.col(task) == c, F.col("n")).otherwise(0), s).alias(f"s{i}_{c}")
        for i, s in enumerate(parts) for c in classes])
    each = F.explode(F.array(*[
        F.struct(F.lit(s.number).alias("side"), *[F.col(f"s{i}_{c}").alias(f"o{c}") for c in classes])
        for i, s in enumerate(parts)]))
    names = [f"o{c}" for c in classes]
    observed = wide.select("feature", each.alias("e")).select("feature", "e.*").where(
        sum((F.col(o) for o in names[1:]), F.col(names[0])) > 0)
    return chi_square_counts(observed, ["side", "feature"], names,
                             [_per_side(sizes, lambda rows, i=i: rows[i]) for i in range(len(classes))])


def ranked_features(counted: DataFrame, parts: list[Side], task: str, classes: list[int], sizes: dict[int, list[int]],
                    width: int) -> DataFrame:
    """(side, feature, statistic, dof, log_p, idf, rank): features by p-value, then by number.

    ``idf`` is null for dense scores. A term of every document weighs nothing and so tells nothing: its statistic is 0.
    One side has at most as many features as there are numbers, so its ranking is one bounded window.
    """
    total = _per_side(sizes, sum)
    frequencies = document_frequencies(counted, parts).select(
        F.col("side").alias("_side"), F.col("feature").alias("_feature"), "df")
    found = chi_square_sides(counted, parts, task, classes, sizes)
    joined = found.join(frequencies, (F.col("side") == F.col("_side")) & (F.col("feature") == F.col("_feature")))
    hashed = F.col("feature") < width
    blank = hashed & (F.col("df") == total)
    weighed = joined.select(
        "side", "feature", F.when(blank, 0.0).otherwise(F.col("statistic")).alias("statistic"),
        F.when(blank, 0).otherwise(F.col("dof")).cast("bigint").alias("dof"),
        F.when(hashed, F.ln((total + 1) / (F.col("df") + 1))).alias("idf"))
    scored = weighed.withColumn("log_p", six_digits(log_p_value(F.col("statistic"), F.col("dof"))))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy("log_p", "feature")))
