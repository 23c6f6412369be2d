"""Label coding, prediction names, and the hash that folds, samples and shuffles are keyed on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: label codes --------------------------------------------------------------------
NEGATIVE, NEUTRAL, POSITIVE = 0, 1, 2
SENTIMENT_NAMES = ["negative", "neutral", "positive"]
# ---- end of fixed values --------------------------------------------------------------------------


def sentiment_code(name: Column, base: int = 0) -> Column:
    """negative, neutral and anything else as 0, 1, 2 (or from ``base`` on)."""
    return (
        F.when(name == "negative", base).when(name == "neutral", base + 1).otherwise(base + 2)
    )


def sentiment_name(prediction: Column) -> Column:
    code = round_half_up(prediction)
    return F.when(code == 0, "negative").when(code == 1, "neutral").otherwise("positive")


def relevance_code(relevant: Column) -> Column:
    return F.when(relevant, 1).otherwise(0)


def relevance_name(prediction: Column) -> Column:
    return F.when(round_half_up(prediction) == 0, "false").otherwise("true")


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("int")


def key_hash(key: Column, seed: int) -> Column:
    """Repeatable 32-digit hash of a key; the same for the same seed on any partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def hash_fold(key: Column, k: int, seed: int) -> Column:
    """Fold 0..k-1 from the key hash: a projection, no shuffle."""
    return (F.conv(F.substring(key_hash(key, seed), 1, 8), 16, 10).cast("bigint") % k).cast("int")
