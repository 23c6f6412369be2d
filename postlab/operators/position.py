"""Row numbers over a whole table without gathering the table, or a hot group of it, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlab.session import stored


def with_position(df: DataFrame, order: list[Column], groups: list[str] | None = None,
                  name: str = "position") -> DataFrame:
    """Add the 1-based position of each row in ``order``, per combination of the ``groups`` columns.

    The sort is a range-partitioned one, so a group of any size is spread over many tasks. Inside a
    partition the running id numbers the rows; one count per (partition, group) gives the offsets, and
    that table has no more rows than partitions plus groups. The sorted rows are stored with their ids because
    counting and numbering must see the same partitions. Offsets of groups are joined by partition and group, so
    there can be any number of groups and no key of that join has more rows than a partition.
    """
    groups = groups or []
    id_, part = F.col("_id"), F.col("_part")
    ordered = df.orderBy(*[F.col(g) for g in groups], *order).withColumn(
        "_id", F.monotonically_increasing_id()
    )
    ordered = stored(ordered, "ordered").withColumn("_part", F.shiftright(id_, 33))

    per_part = ordered.groupBy("_part", *groups).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")
    )
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        F.col("_part").alias("_opart"), *[F.col(g).alias(f"_o_{g}") for g in groups],
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    same = part == F.col("_opart")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    # without groups there is one offset per partition; with groups their number is not bounded
    return (
        ordered.join(offsets if groups else F.broadcast(offsets), same)
        .withColumn(name, (id_ + F.col("_shift") + 1).cast("bigint"))
        .select(*df.columns, name)
    )
