"""Fold assignment, sampling and shuffling by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab.functions.labels import hash_fold, key_hash
from postlab.operators.position import with_position


def contiguous_folds(df: DataFrame, order: list[Column], k: int = 5) -> DataFrame:
    """Chunks of n div k rows in the given order; the remainder gets fold ``k`` and only trains."""
    placed = with_position(df, order, name="_position")
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    chunk = F.greatest(F.floor(n / k), F.lit(1))
    fold = F.least(F.floor((F.col("_position") - 1) / chunk), F.lit(k)).cast("int")
    return placed.withColumn("fold", fold).drop("_position")


def keyed_folds(df: DataFrame, key: str, k: int = 5, seed: int = 1) -> DataFrame:
    """Folds from the hash of the key: no shuffle, the same on every run."""
    return df.withColumn("fold", hash_fold(F.col(key), k, seed))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """A repeatable sample of ``n`` rows: the smallest key hashes."""
    return df.orderBy(key_hash(F.col(key), seed), F.col(key)).limit(n)


def seeded_shuffle(df: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """All rows with their position in a repeatable random order."""
    return with_position(df, [key_hash(F.col(key), seed), F.col(key)])
