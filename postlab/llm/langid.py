"""Language of whole texts by the nearest of several clustered centroids per language.

A text is a vector of hashed character n-grams over its letters, with one blank for anything between, weighted by TF-IDF and normalised. Document frequencies come from
all training rows. Up to ``sample_rows`` training rows of each language, chosen by a hash of identifier and text (so
identifiers may be missing or repeat; copies of a row count once), are
grouped by spherical k-means; the means are the language's centroids. A text gets the language of the centroid
of largest cosine. It is rejected if that cosine is below ``slack`` times the smallest one that a sampled row of
the language has with its own centroids, or if it has no letter. A text of few n-grams cannot come near a
centroid, so below ``FULL`` n-grams the bound shrinks in proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlab.llm.common import below, codes, document_batches, grams, text_slices, tidy, words_only
from postlab.session import stored

ORDERS = (1, 2, 3)
BITS = 13
SAMPLE_ROWS = 400
CLUSTERS = 4
SLACK = 0.5
FULL = 300
#: The centroids are sent to every executor, so the number of languages is bounded.
MAX_LANGUAGES = 500
UNKNOWN = "und"


class LanguageModel(NamedTuple):
    languages: list[str]
    owner: np.ndarray      # language index of each centroid
    centroids: np.ndarray  # one normalised row each
    least: np.ndarray      # smallest cosine that is not rejected, by language
    idf: np.ndarray


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, float]:
    """The normalised vector, and the share of ``FULL`` n-grams that the text has, 1 at most."""
    found = grams(words_only(codes(text)), ORDERS, BITS)
    weights = np.log1p(np.bincount(found, minlength=1 << BITS)) * idf
    return (weights / max(np.linalg.norm(weights), 1e-12)).astype(np.float32), min(1.0, len(found) / FULL)


def _frequencies(rows: DataFrame) -> np.ndarray:
    """Rows that hold each bucket, then the number of rows; one sum per bucket comes to the driver."""
    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((1 << BITS) + 1, dtype=np.int64)
        for batch in text_slices(batches, 0):
            for text in batch.column(0).to_pylist():
                found[:-1] += np.bincount(grams(words_only(codes(text)), ORDERS, BITS), minlength=1 << BITS) > 0
                found[-1] += 1
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(found[held])], names=["bucket", "n"])

    sums = rows.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = sums.toArrow()
    total = np.zeros((1 << BITS) + 1)
    total[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return total


def cluster(vectors: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means of normalised rows; the first centers are the farthest from the ones before."""
    mean = vectors.mean(axis=0)
    chosen = [int(np.argmin(vectors @ mean))]
    while len(chosen) < min(k, len(vectors)):
        near = (vectors @ vectors[chosen].T).max(axis=1)
        near[chosen] = np.inf
        chosen.append(int(np.argmin(near)))
    centers = vectors[chosen]
    for _ in range(rounds):
        own = np.argmax(vectors @ centers.T, axis=1)
        sums = np.stack([vectors[own == c].sum(axis=0) if (own == c).any() else centers[c] for c in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers.astype(np.float32)


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_rows: int = SAMPLE_ROWS, clusters: int = CLUSTERS, slack: float = SLACK) -> LanguageModel:
    """Fit on the rows whose language is known and whose text has a letter. Without any, there are no languages."""
    document_batches(train.sparkSession)
    rows = train.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull() & has_letter(F.col("text")))
    total = _frequencies(rows)
    idf = np.log((1 + total[-1]) / (1 + total[:-1])) + 1

    keyed = rows.select("lang", "text", F.xxhash64("id", "text").alias("key"))
    counts = stored(keyed.select("lang", "key").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n_lang")), "languages")
    if counts.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    sample = keyed.join(F.broadcast(counts), "lang").where(
        below(F.col("key"), 2 * sample_rows / F.col("n_lang"))
    ).groupBy("lang", "key").agg(F.min("text").alias("text")).withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= sample_rows)

    def centers(group: pd.DataFrame) -> pd.DataFrame:
        made = [_vector(text, idf) for text in group["text"]]
        vectors, full = np.stack([v for v, _ in made]), np.array([f for _, f in made])
        found = cluster(vectors, clusters)
        least = float(((vectors @ found.T).max(axis=1) / full).min()) * slack
        return pd.DataFrame({"lang": group["lang"].iloc[0], "center": list(found), "least": least})

    found = sample.groupBy("lang").applyInPandas(centers, "lang string, center array<float>, least double").collect()
    languages = sorted({row["lang"] for row in found})
    found.sort(key=lambda row: (row["lang"], row["center"]))
    return LanguageModel(
        languages, np.array([languages.index(row["lang"]) for row in found], dtype=int),
        np.array([row["center"] for row in found], dtype=np.float32).reshape(len(found), 1 << BITS),
        np.array([next(row["least"] for row in found if row["lang"] == lang) for lang in languages]), idf)


def _judge(m: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text; None is a text without a letter."""
    lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
    known = [i for i, text in enumerate(texts) if text is not None and m.languages]
    for start in range(0, len(known), 256):
        some = known[start:start + 256]
        made = [_vector(texts[i], m.idf) for i in some]
        cosines = np.stack([v for v, _ in made]) @ m.centroids.T
        best = cosines.argmax(axis=1)
        score[some] = np.clip(cosines[np.arange(len(some)), best], 0, 1)
        rejected[some] = score[some] < m.least[m.owner[best]] * np.array([f for _, f in made])
        for i, b in zip(some, best):
            lang[i] = m.languages[m.owner[b]]
    return lang, score, rejected


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every row: score is the largest cosine, from 0 to 1.

    A null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text if the model
    knows no language. Other rejected texts still get the nearest language.
    """
    document_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col(id_col).alias(id_col), F.when(has_letter(F.col(text_col)), F.col(text_col)).alias("_text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1, 1 << 20):
            lang, score, rejected = _judge(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang), pa.array(score), pa.array(rejected)],
                names=[id_col, "lang_pred", "score", "rejected"])

    kind = chosen.schema[0].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the model does not reject, with all their columns."""
    document_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lettered = docs.where(has_letter(F.col(text_col)))
    at = docs.columns.index(text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, at, 1 << 20):
            yield batch.filter(pa.array(~_judge(shared.value, batch.column(at).to_pylist())[2]))

    return lettered.mapInArrow(run, docs.schema)
