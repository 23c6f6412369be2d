"""Corpus statistics, relative length and side-by-side lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab.functions.normalize import blank_split
from postlab.operators.position import with_position
from postlab.session import checkpointed


def word_count(text: Column) -> Column:
    """Number of blank-split pieces."""
    return F.size(blank_split(text))


def relative_length(docs: DataFrame, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """(keys, n_tokens, relative_length): tokens per mean number of tokens in this dataset.

    The sizes are written first: the mean and the ratio both need them, the tokens are made once.
    """
    sizes = checkpointed(docs.select(*keys, F.size(tokens).cast("bigint").alias("n_tokens")))
    mean = sizes.agg(F.avg("n_tokens").alias("m")).scalar()
    return sizes.withColumn("relative_length", F.col("n_tokens") / mean)


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows, mean and sample deviation of the word count by split and class, in one pass.

    ``docs`` has split, relevance and sentiment (null where unlabelled). Labelled splits give one row
    per relevance class and one per sentiment class; every split gives one row as a whole.
    """
    counted = docs.select("split", "relevance", "sentiment", word_count(F.col(text)).alias("wc"))
    return (
        counted.groupingSets(
            [("split", "relevance"), ("split", "sentiment"), ("split",)],
            "split", "relevance", "sentiment",
        )
        .agg(
            F.grouping_id().alias("_g"),
            F.count(F.lit(1)).alias("n"),
            F.avg("wc").alias("mean_words"),
            F.stddev_samp("wc").alias("sd_words"),
        )
        # drop the class rows of unlabelled splits: both label columns are null there
        .where((F.col("_g") == 3) | F.col("relevance").isNotNull() | F.col("sentiment").isNotNull())
        .drop("_g")
    )


def word_counts_wide(docs: DataFrame, class_col: str, classes: list[str], order: str,
                     text: str = "text") -> DataFrame:
    """(position, one column per class): the word counts of each class listed side by side.

    Columns end at different positions; the longest one decides the number of rows.
    """
    counted = docs.select(class_col, order, word_count(F.col(text)).alias("wc"))
    placed = with_position(counted, [F.col(order)], groups=[class_col])
    return placed.groupBy("position").pivot(class_col, classes).agg(F.first("wc"))


def side_by_side(wide: DataFrame, classes: list[str]) -> Column:
    """One ``;``-separated line of a wide row, empty where a list has ended."""
    return F.concat_ws(";", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in classes])
