"""Vocabulary, term statistics, chi-square and vocabulary-level stemming."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab.operators.parts import Dealt, Matches, fields, in_parts, lists, tallied, text_rank
from postlab.operators.position import with_position


def _words(docs: DataFrame, tokens: str | Column, keys: list[str], name: str) -> DataFrame:
    """(keys, name), one row per token.

    Exploded as outer, then without the rows of empty arrays: for an inner explode Catalyst infers a
    filter on the array's size, moves it below, and there the tokens would be computed a second time.
    """
    return docs.select(*keys, F.explode_outer(tokens).alias(name)).where(F.col(name).isNotNull())


def explode_tokens(docs: DataFrame, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """(keys, pos, word), one row per token; ``pos`` counts from 0."""
    return docs.select(*keys, F.posexplode_outer(tokens).alias("pos", "word")).where(
        F.col("word").isNotNull()
    )


def distinct_words(docs: DataFrame, keys: list[str], tokens: str = "tokens",
                   name: str = "word") -> DataFrame:
    """(keys, name), one row per distinct token of each document, without a shuffle."""
    return _words(docs, F.array_distinct(tokens), keys, name)


def term_counts(docs: DataFrame, keys: list[str], tokens: str = "tokens",
                term: str = "term") -> DataFrame:
    """(keys, term, tf). A document sits in one partition, so the map side already does the counting."""
    return (
        _words(docs, tokens, keys, term)
        .groupBy(*keys, term).agg(F.count(F.lit(1)).alias("tf"))
    )


def vocabulary(docs: DataFrame | Dealt, tokens: str = "tokens") -> DataFrame:
    """(word, n): every distinct word with its number of occurrences. Documents that are stored by part are counted already."""
    if isinstance(docs, Dealt):
        return docs.counts.groupBy("word").agg(F.sum("n").alias("n"))
    return _words(docs, tokens, [], "word").groupBy("word").agg(
        F.count(F.lit(1)).alias("n")
    )


def ranked_vocabulary(docs: DataFrame | Dealt, tokens: str = "tokens") -> DataFrame:
    """(word, n, rank): rank 1 is the most frequent word, ties go by the word."""
    return with_position(vocabulary(docs, tokens), [F.desc("n"), F.asc("word")], name="rank")


def document_frequency(docs: DataFrame | Dealt, tokens: str = "tokens", term: str = "term") -> DataFrame:
    """(term, df) from the distinct tokens of each row: one shuffle, counted on the map side first."""
    if isinstance(docs, Dealt):
        return docs.counts.groupBy(F.col("word").alias(term)).agg(F.sum("df").alias("df"))
    return distinct_words(docs, [], tokens, term).groupBy(term).agg(
        F.count(F.lit(1)).alias("df")
    )


def idf(frequencies: DataFrame, n_docs: Column) -> DataFrame:
    """Add ``idf`` = ln((N + 1) / (df + 1))."""
    return frequencies.withColumn("idf", F.ln((n_docs + 1) / (F.col("df") + 1)))


def row_count(df: DataFrame) -> Column:
    """The number of rows as a scalar subquery."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def tfidf(docs: DataFrame, keys: list[str], n_docs: Column, tokens: str = "tokens", words: DataFrame | None = None) -> DataFrame:
    """(keys, term, tf, idf, tfidf) over the distinct (document, term) pairs.

    Documents are dealt out to parts once, as rows: the document frequencies are counted in the parts, where all rows of a key lie
    together, and a part gets the weights of its distinct words back. No pair goes through a shuffle. ``words`` is the vocabulary
    (word, n) of the documents; without it, the tokens are counted.
    """
    def weights(dealt: DataFrame) -> list[DataFrame]:
        pairs = distinct_words(dealt, ["_part", *keys], tokens).distinct()  # several rows may share a key
        frequencies = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        return [idf(frequencies, n_docs).select("word", "idf")]

    def weighed(found: Matches) -> pa.Table:
        n_words = max(1, len(found.table))
        pair, tf = tallied(found.group[found.row] * n_words + found.at)  # every token has a weight
        entry, first = found.table.take(pa.array(pair % n_words)), found.first_rows()
        weight = entry["idf"].to_numpy()
        return pa.table({**found.keys_of(first[pair // n_words]), "term": entry["word"], "tf": tf.astype("int64"),
                         "idf": weight, "tfidf": tf * weight})

    schema = f"{fields(docs, keys)}, term string, tf bigint, idf double, tfidf double"
    return in_parts(docs, keys, weights, weighed, schema, tokens, words)


def chi_square(values: DataFrame, feature: str, value: str, label: str, classes: list,
               class_sizes: Column) -> DataFrame:
    """Chi-square statistic and degrees of freedom of each feature against the label.

    ``values`` holds the nonzero cells only, one row per (document, feature); zero is one more category
    and follows from the class sizes. ``class_sizes`` is a struct column c0, c1, ... in the order of
    ``classes``. With o observed in a cell of row total r and class size c, the statistic is
    N * (sum of o*o/(r*c) - 1), so empty cells need no rows.
    """
    observed = values.groupBy(feature, value).agg(
        *[F.count(F.when(F.col(label) == c, 1)).alias(f"o{i}") for i, c in enumerate(classes)]
    )
    return chi_square_counts(observed, [feature], [f"o{i}" for i in range(len(classes))],
                             [class_sizes[f"c{i}"] for i in range(len(classes))])


def chi_square_counts(observed: DataFrame, keys: list[str], counts: list[str], sizes: list[Column]) -> DataFrame:
    """(keys, statistic, dof) from a row per nonzero value of a feature with its ``counts`` per class.

    ``sizes`` are the class sizes; they may depend on ``keys``.
    """
    size = [s.cast("double") for s in sizes]
    total = sum(size[1:], size[0])

    def share(cells: list[Column]) -> Column:
        row = sum(cells[1:], cells[0])
        return sum((F.when(s > 0, c * c / (row * s)).otherwise(0.0) for c, s in zip(cells, size)), F.lit(0.0))

    per_feature = observed.groupBy(*keys).agg(
        F.sum(share([F.col(o).cast("double") for o in counts])).alias("_s"), F.count(F.lit(1)).alias("_rows"),
        *[F.sum(o).alias(o) for o in counts],
    )
    zeros = [s - F.col(o) for o, s in zip(counts, size)]
    n_zero = sum(zeros[1:], zeros[0])
    has_zero = n_zero > 0
    n_classes = sum(((s > 0).cast("int") for s in size), F.lit(0))
    return per_feature.select(
        *keys,
        (total * (F.col("_s") + F.when(has_zero, share(zeros)).otherwise(0.0) - 1)).alias("statistic"),
        ((F.col("_rows") + has_zero.cast("int") - 1) * (n_classes - 1)).cast("bigint").alias("dof"),
    )


def class_sizes(labelled: DataFrame, label: str, classes: list) -> Column:
    """Struct c0, c1, ... with the number of rows per class, as a scalar subquery."""
    return labelled.agg(F.struct(
        *[F.count(F.when(F.col(label) == c, 1)).alias(f"c{i}") for i, c in enumerate(classes)]
    ).alias("sizes")).scalar()


def stem_table(words: DataFrame, stemmer: Callable[[Column], Column]) -> DataFrame:
    """(word, n, stem): each distinct word is stemmed once."""
    return words.withColumn("stem", stemmer(F.col("word")))


def stem_tokens(docs: DataFrame, keys: list[str], stemmer: Callable[[Column], Column],
                words: DataFrame | None = None, tokens: str = "tokens",
                name: str = "stems") -> DataFrame:
    """(keys, stems): the token array with every token replaced by its stem, order kept.

    ``words`` is the vocabulary (word, n); without it, it is counted from ``docs``. Documents without
    tokens keep an empty array.
    """
    words = words if words is not None else vocabulary(docs, tokens)

    def stemmed(found: Matches) -> pa.Table:
        return pa.table({**found.keys_of(np.arange(len(found.docs))), name: part_stems(found)})

    table = stem_table(words, stemmer).select("word", "stem")
    return in_parts(docs, keys, [table], stemmed, f"{fields(docs, keys)}, {name} array<string>", tokens, words)


def part_stems(found: Matches) -> pa.Array:
    """The stems of each document of a part, in the order of its tokens."""
    stem = found.value("stem")
    return lists(found, found.in_order(lambda: text_rank(stem)), stem)


def part_kept(found: Matches, entries: list[str]) -> pa.Array:
    """The tokens of each document of a part that are among ``entries``, each once, in the order of their first places."""
    among = pc.is_in(found.words, value_set=pa.array(entries, pa.string())).to_numpy(zero_copy_only=False).astype(bool)
    place = np.flatnonzero(among[found.code])
    n_words = max(1, len(found.words))
    pair = found.row[place] * n_words + found.code[place]
    order = np.argsort(pair, kind="stable")
    first = np.sort(order[np.r_[True, np.diff(pair[order]) != 0]]) if len(pair) else order
    row = found.row[place][first]
    ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(found.docs)))].astype("int32")
    missing = found.docs["tokens"].combine_chunks().is_null()
    return pa.ListArray.from_arrays(pa.array(ends), found.words.take(pa.array(found.code[place][first])), mask=missing)


def regroup(tokens: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the values of each document in token order, as the document row had them."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("pos"), F.col(value).alias("v"))))
    return tokens.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias(name))


def restore_empty(docs: DataFrame, collected: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Give documents that lost all their tokens an empty array back."""
    element = collected.schema[name].dataType.simpleString()
    return docs.select(*keys).join(collected, keys, "left").select(
        *keys, F.coalesce(F.col(name), F.array().cast(element)).alias(name)
    )


def stem_groups(words: DataFrame, stemmer: Callable[[Column], Column]) -> DataFrame:
    """(stem, n_words, n): how many words share a stem and how often they occur."""
    return stem_table(words, stemmer).groupBy("stem").agg(
        F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("n")
    )
