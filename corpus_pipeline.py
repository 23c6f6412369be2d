"""A training corpus from ``documents``: language, exact and near copies, mix of sources, tokens.

Each stage takes the rows that the stage before has written and returns a table; all but the last return the columns of
``documents``. The stages fit and count on all the rows that they get.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlab.llm import bpe, exact_dedup, jaccard_join, langid, mixing
from postlab.session import stored
from postlab.sources.readers import read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# ---- fixed values: settings ---------------------------------------------------------------------------------
SHINGLE, PERCENT = 5, 80
WEIGHTS, MOST, BLOCK, SHARD_SLOTS, SEED = (1, 2, 3), 3, 64, 4096, 1
RANKS = "byte_bpe_multi_50k.tiktoken"
# ---- end of fixed values --------------------------------------------------------------------------------------


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject; it is fitted on the languages that are given."""
    return langid.drop_rejected(docs, langid.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one of the largest identifier."""
    return exact_dedup.drop_copies(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similar shingle sets the one of the smallest identifier."""
    return jaccard_join.drop_similar(docs, n=SHINGLE, percent=PERCENT)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What a mix of the sources uses: a row for each use of a document, with the words that are used then."""
    mix = mixing.mixed_texts(
        docs, weights=WEIGHTS, most=MOST, block=BLOCK, shard_slots=SHARD_SLOTS, seed=SEED)
    return mix.withColumn("n_chars", F.length("text").cast("bigint"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): packed token ids, and whether they decode to the text."""
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.encode(docs, ranks, pattern, verify=True)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixed_sources", mixed_sources),
    ("tokens", tokens),
]

#: The fitted language model and the tokenizer have no SQL form; tests hold the pipeline against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
