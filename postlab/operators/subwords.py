"""Vectors for unknown words, composed of the vectors of their character n-grams."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab.operators.foldstats import bucket
from postlab.operators.parts import Matches, in_parts
from postlab.operators.wordvectors import part_means, token_vectors_with_default

# ---- fixed values: lengths of the n-grams and number of buckets ---------------------------------------
SHORTEST, LONGEST = 3, 6
BUCKETS = 2_000_000
# ---- end of fixed values --------------------------------------------------------------------------------


def subwords(word: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """All character n-grams of ``<word>``, in order of length; an array without entries for null."""
    marked = F.concat(F.lit("<"), word, F.lit(">"))

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(marked) - (n - 1))
        grams = F.transform(starts, lambda i: F.substring(marked, i, F.lit(n)))
        return F.when(F.length(marked) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of_length(n) for n in range(shortest, longest + 1)])


def word_buckets(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(word, bucket): one row per n-gram of each word, repeats included; buckets are hashes as text."""
    grams = words.select("word", F.explode(subwords(F.col("word"), shortest, longest)).alias("gram"))
    return grams.select("word", bucket(F.col("gram"), buckets).cast("string").alias("bucket"))


def _mean(rows: DataFrame, key: str, dim: int) -> DataFrame:
    """(key, vector): one plain average per dimension, so it is partly added up before the shuffle."""
    means = rows.groupBy(key).agg(*[F.avg(F.col("vector")[i]).alias(f"_m{i}") for i in range(dim)])
    return means.select(key, F.array(*[F.col(f"_m{i}") for i in range(dim)]).alias("vector"))


def bucket_vectors(vectors: DataFrame, dim: int, shortest: int = SHORTEST, longest: int = LONGEST,
                   buckets: int = BUCKETS) -> DataFrame:
    """(bucket, vector): the mean vector of the n-grams of known words; ``vectors`` is (word, vector)."""
    held = word_buckets(vectors, shortest, longest, buckets).join(vectors.select("word", "vector"), "word")
    return _mean(held, "bucket", dim)


def composed_vectors(words: DataFrame, of_buckets: DataFrame, dim: int, shortest: int = SHORTEST,
                     longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(word, vector): the mean over the n-grams of each word that have a bucket vector; words without one go.

    ``words`` are distinct. They are dealt out as rows with their n-grams, and a bucket's vector is sent once per part.
    """
    gram = F.transform(subwords(F.col("word"), shortest, longest), lambda g: bucket(g, buckets).cast("string"))
    spelled = words.select("word", gram.alias("_grams"))

    def means(found: Matches) -> pa.Table:
        some = found.sums(found.at >= 0)[found.group] > 0
        return pa.table({"word": found.docs["word"], "vector": part_means(found, dim, present=True)}).filter(pa.array(some))

    table = of_buckets.withColumnRenamed("bucket", "word")
    return in_parts(spelled, ["word"], [table], means, "word string, vector array<double>", "_grams")


def vocabulary_vectors(words: DataFrame, vectors: DataFrame, of_buckets: DataFrame, dim: int,
                       shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(word, known, vector) of all distinct ``words``: their own vector, else a composed one, else zeros."""
    words = words.select("word")
    unknown = words.join(vectors.select("word"), "word", "left_anti")
    composed = composed_vectors(unknown, of_buckets, dim, shortest, longest, buckets)
    zeros = F.array_repeat(F.lit(0.0), dim)
    known = words.join(vectors.select("word", "vector"), "word").select("word", F.lit(True).alias("known"), "vector")
    return known.unionByName(
        unknown.join(composed, "word", "left").select(
            "word", F.lit(False).alias("known"), F.coalesce("vector", zeros).alias("vector")))


def token_vectors_composed(docs: DataFrame, vectors: DataFrame, of_buckets: DataFrame, keys: list[str], dim: int,
                           words: DataFrame, tokens: str = "tokens", shortest: int = SHORTEST, longest: int = LONGEST,
                           buckets: int = BUCKETS) -> DataFrame:
    """(keys, pos, word, vector) of every token; each distinct unknown word is composed once.

    ``words`` is the vocabulary (word, n) of the documents.
    """
    table = vocabulary_vectors(words, vectors, of_buckets, dim, shortest, longest, buckets).select("word", "vector")
    return token_vectors_with_default(docs, table, keys, dim, tokens, words)
