"""Word-vector lookups, mean vectors and padded sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab.functions.vectors import sequence_vector
from postlab.operators.lookup import lookup_join
from postlab.operators.parts import Matches, fields, in_parts, matrix, vector_sums
from postlab.operators.terms import explode_tokens, regroup, restore_empty


def _lookup(docs: DataFrame, vectors: DataFrame, keys: list[str], tokens: str, words: DataFrame | None) -> DataFrame:
    return lookup_join(
        explode_tokens(docs, keys, tokens), vectors, "word", ["vector"],
        [F.col(k) for k in keys] + [F.col("pos")], words,
    )


def token_vectors(docs: DataFrame, vectors: DataFrame, keys: list[str],
                  tokens: str = "tokens", words: DataFrame | None = None) -> DataFrame:
    """(keys, pos, word, vector) for tokens with a vector; the others go. ``vectors``: (word, vector).

    ``words`` is the vocabulary (word, n) of the documents, here and below; without it, it is counted.
    """
    return _lookup(docs, vectors, keys, tokens, words).where(F.col("vector").isNotNull())


def token_vectors_with_default(docs: DataFrame, vectors: DataFrame, keys: list[str], dim: int,
                               tokens: str = "tokens", words: DataFrame | None = None,
                               default: Column | None = None) -> DataFrame:
    """As ``token_vectors``, but every token stays; unknown words get zeros, or ``default``."""
    default = F.array_repeat(F.lit(0.0), dim) if default is None else default
    return _lookup(docs, vectors, keys, tokens, words).withColumn(
        "vector", F.coalesce(F.col("vector"), default)
    )


def word_vector(words: DataFrame, vectors: DataFrame, word: str = "word") -> DataFrame:
    """Vector of single words, looked up in lower case; an empty array for unknown words."""
    lowered = words.withColumn("_lower", F.lower(word))
    table = vectors.select(F.col("word").alias("_lower"), "vector")
    return lookup_join(lowered, table, "_lower", ["vector"], [F.col(word)]).withColumn(
        "vector", F.coalesce(F.col("vector"), F.array().cast("array<double>"))
    ).drop("_lower")


def vector_sequences(docs: DataFrame, vectors: DataFrame, keys: list[str],
                     tokens: str = "tokens", name: str = "vectors",
                     words: DataFrame | None = None) -> DataFrame:
    """(keys, vectors): the known vectors of each document in token order, possibly none."""
    known = token_vectors(docs, vectors, keys, tokens, words)
    return restore_empty(docs, regroup(known, keys, "vector", name), keys, name)


def known_tokens(docs: DataFrame, vectors: DataFrame, keys: list[str], tokens: str = "tokens",
                 words: DataFrame | None = None) -> DataFrame:
    """(keys, n_known) of the documents that have any token with a vector. No vector is touched."""
    def counted(found: Matches) -> pa.Table:
        known = found.sums(found.at >= 0).astype("int64")
        rows = found.first_rows()
        rows, known = rows[known > 0], known[known > 0]
        return pa.table({**found.keys_of(rows), "n_known": known})

    table = vectors.select("word")
    return in_parts(docs, keys, [table], counted, f"{fields(docs, keys)}, n_known bigint", tokens, words)


def padded_sequences(docs: DataFrame, vectors: DataFrame, keys: list[str], length: int, dim: int,
                     tokens: str = "tokens", name: str = "sequence", words: DataFrame | None = None) -> DataFrame:
    """(keys, sequence): the first ``length`` known vectors end to end, for documents that have any.

    Documents stay rows: only the vectors of a part's distinct words are moved.
    """
    def firsts(found: Matches) -> pa.Table:
        order = found.in_order(lambda: _vector_rank(found, dim))
        order = order[found.at[order] >= 0]
        owner = found.group[found.row][order]
        place = np.arange(len(order)) - np.searchsorted(owner, owner)
        order, owner = order[place < length], owner[place < length]
        sizes = np.bincount(owner, minlength=found.groups)
        ends = np.r_[0, np.cumsum(sizes)].astype("int32")
        vector = found.table["vector"].combine_chunks().take(pa.array(found.at[order]))  # of these entries only
        some = pa.ListArray.from_arrays(pa.array(ends), vector)
        rows, kept = found.first_rows(), np.flatnonzero(sizes > 0)
        return pa.table({**found.keys_of(rows[kept]), "_vectors": some.take(pa.array(kept))})

    schema = f"{fields(docs, keys)}, _vectors array<array<double>>"
    table = vectors.select("word", "vector").where(F.col("vector").isNotNull())
    grouped = in_parts(docs, keys, [table], firsts, schema, tokens, words)
    return grouped.select(*keys, sequence_vector(F.col("_vectors"), length, dim).alias(name))


def _vector_rank(found: Matches, dim: int) -> np.ndarray:
    """The place of each entry's vector among all of them, first number first."""
    values, _ = matrix(found.table["vector"].combine_chunks(), dim)
    rank = np.empty(len(values) + 1, dtype="int64")
    rank[np.lexsort(values.T[::-1])] = np.arange(len(values))
    rank[-1] = -1
    return rank[found.at]


def part_means(found: Matches, dim: int, present: bool = False) -> pa.Array:
    """The mean vector of each document of a part; with ``present`` a missing entry does not count in the mean of its place."""
    values, holes = matrix(found.table["vector"].combine_chunks(), dim)
    known = found.at >= 0
    owner, at = found.group[found.row[known]], found.at[known]
    count = np.bincount(owner, minlength=found.groups)
    means, shares = vector_sums(owner, at, values, found.groups), count[:, None]
    missing = np.zeros(means.shape, dtype=bool)
    if holes is not None:
        there = vector_sums(owner, at, (~holes).astype("float64"), found.groups)
        missing, shares = (there == 0) & (count > 0)[:, None], there if present else shares
    means = means / np.maximum(shares, 1)
    means, missing = np.r_[means, np.zeros((1, dim))], np.r_[missing, np.zeros((1, dim), dtype=bool)]
    place = np.where(found.null_key, found.groups, found.group)  # a null key meets nothing
    flat = pa.array(means[place].ravel(), mask=missing[place].ravel() if holes is not None else None)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1, dtype="int32") * dim), flat)


def mean_vectors(docs: DataFrame, vectors: DataFrame, keys: list[str], dim: int,
                 tokens: str = "tokens", name: str = "mean_vector", words: DataFrame | None = None) -> DataFrame:
    """(keys, mean_vector): mean over the known tokens, repeats counted; zeros if none is known.

    The sums are made where the documents are, from the vectors of their part's distinct words.
    """
    def means(found: Matches) -> pa.Table:
        return pa.table({**found.keys_of(np.arange(len(found.docs))), name: part_means(found, dim)})

    table = vectors.select("word", "vector").where(F.col("vector").isNotNull())
    return in_parts(docs, keys, [table], means, f"{fields(docs, keys)}, {name} array<double>", tokens, words)


def long_form(df: DataFrame, keys: list[str], vector: str | Column) -> DataFrame:
    """(keys, dim, value) of an array column without nulls (outer for the reason given in ``terms``)."""
    column = F.col(vector) if isinstance(vector, str) else vector
    return df.select(*keys, F.posexplode_outer(column).alias("dim", "value")).where(
        F.col("dim").isNotNull()
    )
