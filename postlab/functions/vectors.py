"""Arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(squared_distance(a, b))


def argmax(vector: Column) -> Column:
    """0-based index of the largest entry; the first one on ties."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def one_hot(index: Column, width: int) -> Column:
    return F.concat(
        F.array_repeat(F.lit(0.0), index), F.array(F.lit(1.0)),
        F.array_repeat(F.lit(0.0), F.lit(width - 1) - index),
    )


def sequence_vector(vectors: Column, length: int, dim: int) -> Column:
    """The first ``length`` vectors end to end, zeros after the last one, values through float."""
    flat = F.transform(
        F.flatten(F.slice(vectors, 1, length)), lambda x: x.cast("float").cast("double")
    )
    missing = F.greatest(F.lit(length * dim) - F.size(flat), F.lit(0))
    return F.concat(flat, F.array_repeat(F.lit(0.0), missing))


def nearest_center(vector: Column, centers: Column) -> Column:
    """Struct (distance, center) of the closest entry of an ``array<struct<center, vector>>``.

    The lower center wins ties. The centers travel as one bounded value beside each row, so assigning
    a point is a projection.
    """
    return F.array_min(F.transform(
        centers,
        lambda c: F.struct(
            distance(vector, c["vector"]).alias("distance"), c["center"].alias("center")
        ),
    ))


def majority(votes: Column) -> Column:
    """Most frequent vote after rounding half up; the smallest label wins ties."""
    rounded = F.transform(votes, lambda v: F.floor(v + 0.5).cast("int"))
    ranked = F.transform(
        F.array_distinct(rounded),
        lambda v: F.struct(F.size(F.filter(rounded, lambda x: x == v)).alias("n"), (-v).alias("neg")),
    )
    return -F.array_max(ranked)["neg"]


def soft_vote(*distributions: Column) -> Column:
    """Add the class distributions entry by entry and take the first largest class."""
    total = distributions[0]
    for other in distributions[1:]:
        total = add(total, other)
    return argmax(total)
