"""Confusion counts and F1 scores as aggregations, nearest fixed centers and their cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab.functions.vectors import nearest_center


def confusion_matrix(df: DataFrame, actual: str, predicted: str, n_classes: int) -> DataFrame:
    """(actual, predicted, n) on the full grid of classes, zeros included."""
    classes = F.sequence(F.lit(0), F.lit(n_classes - 1))
    grid = (
        df.sparkSession.range(1)
        .select(F.explode(classes).alias("actual"))
        .select("actual", F.explode(classes).alias("predicted"))
    )
    counts = (
        df.select(F.col(actual).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted"))
        .groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    )
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def weighted_f1(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(f1): class F1 weighted by the share of the class among the actual labels."""
    counts = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # each cell counts once for its actual and once for its predicted class
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("a").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called"),
                 F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called"),
                 F.lit(0).cast("bigint").alias("hit")),
    )).alias("s")).select("s.*")
    per_class = sides.groupBy("c").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit")
    )
    f1 = 2 * F.col("hit") / (F.col("support") + F.col("called"))
    return per_class.agg((F.sum(F.col("support") * f1) / F.sum("support")).alias("f1"))


def micro_f1(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(f1): for one label per row this is the share of right predictions."""
    return df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("f1"))


def center_table(points: DataFrame, label: str, vector: str, dim: int) -> Column:
    """Mean vector per label as one scalar ``array<struct<center, vector>>``, ordered by label.

    There is one entry per class, a number fixed by the task.
    """
    means = points.groupBy(F.col(label).alias("center")).agg(
        F.array(*[F.avg(F.col(vector)[i]) for i in range(dim)]).alias("vector")
    )
    return means.agg(F.array_sort(F.collect_list(F.struct("center", "vector"))).alias("centers")).scalar()


def assign_centers(points: DataFrame, vector: str, centers: Column) -> DataFrame:
    """Add (center, distance) of the nearest center."""
    return (
        points.withColumn("_centers", centers)
        .withColumn("_nearest", nearest_center(F.col(vector), F.col("_centers")))
        .withColumns({"center": F.col("_nearest.center"), "distance": F.col("_nearest.distance")})
        .drop("_nearest", "_centers")
    )


def within_cost(assigned: DataFrame, distance: str = "distance") -> DataFrame:
    """(wssse): sum of squared distances to the assigned centers."""
    return assigned.agg(F.sum(F.col(distance) * F.col(distance)).alias("wssse"))
