"""Lexicon presence features and the misspelling ratio."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.operators.parts import Matches, distinct, fields, in_parts

# ---- fixed value: tokens of the normaliser that stand for something else ---------------------------
PLACEHOLDER_PREFIX = "<<<"
# ---- end of fixed value ----------------------------------------------------------------------------


def number_entries(lexicon: DataFrame) -> DataFrame:
    """(word, polarity, idx): entries in lower case with their slot in the lexicon vector.

    Slots 0 and 1 hold the two counts; positive entries follow from 2 on, then the negative ones.
    """
    n_positive = lexicon.agg(F.count(F.when(F.col("polarity") == "positive", 1)).alias("n")).scalar()
    return lexicon.select(
        F.lower("word").alias("word"), "polarity",
        (F.col("idx") + 2 + F.when(F.col("polarity") == "negative", n_positive).otherwise(0))
        .cast("int").alias("idx"),
    )


def lexicon_hits(docs: DataFrame, lexicon: DataFrame, keys: list[str],
                 tokens: str = "tokens", words: DataFrame | None = None) -> DataFrame:
    """(keys, word, polarity, idx): each entry present in a document, however often it occurs there.

    ``words`` is the vocabulary (word, n) of the documents, here and below; without it, it is counted.
    """
    def present(found: Matches) -> pa.Table:
        row, at = part_hits(found)
        entry = found.table.take(pa.array(at))
        return pa.table({**found.keys_of(row), **{c: entry[c] for c in ("word", "polarity", "idx")}})

    schema = f"{fields(docs, keys)}, word string, polarity string, idx int"
    entries = number_entries(lexicon).where(F.col("idx").isNotNull())
    return in_parts(docs, keys, [entries], present, schema, tokens, words)


def part_hits(found: Matches) -> tuple[np.ndarray, np.ndarray]:
    """Each entry present in a document of a part, once: the document's row and the entry's row."""
    known = found.at >= 0
    pair = distinct(found.row[known] * max(1, len(found.table)) + found.at[known])
    return pair // max(1, len(found.table)), pair % max(1, len(found.table))


def part_unknown(found: Matches) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and tokens outside the dictionary of each key of a part."""
    stands_in = pc.starts_with(found.words, PLACEHOLDER_PREFIX).to_numpy(zero_copy_only=False).astype(bool)
    strange = (found.at < 0) & ~stands_in[found.code]
    return found.sums(np.ones(len(found.row))).astype("int64"), found.sums(strange).astype("int64")


def lexicon_counts(docs: DataFrame, lexicon: DataFrame, keys: list[str],
                   tokens: str = "tokens", words: DataFrame | None = None) -> DataFrame:
    """(keys, positive, negative): number of present entries per polarity, zero included."""
    counts = lexicon_hits(docs, lexicon, keys, tokens, words).groupBy(*keys).agg(
        F.count(F.when(F.col("polarity") == "positive", 1)).alias("positive"),
        F.count(F.when(F.col("polarity") == "negative", 1)).alias("negative"),
    )
    return docs.select(*keys).join(counts, keys, "left").select(
        *keys,
        F.coalesce("positive", F.lit(0)).cast("bigint").alias("positive"),
        F.coalesce("negative", F.lit(0)).cast("bigint").alias("negative"),
    )


def lexicon_vectors(docs: DataFrame, lexicon: DataFrame, keys: list[str],
                    tokens: str = "tokens", name: str = "lexicon", words: DataFrame | None = None) -> DataFrame:
    """(keys, lexicon map<int,double>): the nonzero slots, both counts always present."""
    per_doc = lexicon_hits(docs, lexicon, keys, tokens, words).groupBy(*keys).agg(
        F.count(F.when(F.col("polarity") == "positive", 1)).cast("double").alias("_p"),
        F.count(F.when(F.col("polarity") == "negative", 1)).cast("double").alias("_n"),
        F.array_sort(F.collect_list("idx")).alias("_slots"),
    )
    slots = F.coalesce(F.col("_slots"), F.array().cast("array<int>"))
    zero = F.lit(0.0)
    return docs.select(*keys).join(per_doc, keys, "left").select(*keys, F.map_from_arrays(
        F.concat(F.array(F.lit(0), F.lit(1)), slots),
        F.concat(F.array(F.coalesce("_p", zero), F.coalesce("_n", zero)),
                 F.transform(slots, lambda _: F.lit(1.0))),
    ).alias(name))


def misspelling_ratio(docs: DataFrame, dictionary: DataFrame, keys: list[str],
                      tokens: str = "tokens", words: DataFrame | None = None) -> DataFrame:
    """(keys, n_tokens, n_unknown, ratio): tokens outside the dictionary per token.

    ``dictionary`` has a column word. Placeholders are never misspelled but do
    count as tokens; a document without tokens counts as one empty piece.
    """
    def counted(found: Matches) -> pa.Table:
        n, u = (np.where(found.null_key, 0, x[found.group]) for x in part_unknown(found))
        return pa.table({**found.keys_of(np.arange(len(found.docs))), "n_tokens": n, "n_unknown": u, "ratio": u / np.maximum(n, 1)})

    schema = f"{fields(docs, keys)}, n_tokens bigint, n_unknown bigint, ratio double"
    return in_parts(docs, keys, [dictionary.select("word")], counted, schema, tokens, words)
