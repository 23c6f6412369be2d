"""Toxicity of whole texts: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed character n-grams. Each bucket is scaled by the logarithm of the ratio between its
share in the rows of label 1 and of label 0. A bucket that the labels do not clearly differ in (by the likelihood ratio)
gets ratio 0. Copies of a text under one label count once. A logistic regression is
fitted on the scaled sets. Ratios and regression are fitted on at most ``fit_rows`` rows of each label, the ones of
the smallest hash of the identifier; every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlab.llm.common import Distinct, below, codes, document_batches, grams, text_slices, tidy

ORDERS = (3, 4, 5)
BITS = 18
#: Rows of each label to fit on.
FIT_ROWS = 3000
#: Least likelihood-ratio statistic of a bucket.
LEAST_RATIO = 8.0
SCALE = 0.1
ROUNDS = 300
STEP = 0.1
PENALTY = 1e-5


class ToxicityModel(NamedTuple):
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float  # share of label 1 among all training rows


def log_ratios(sets: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Logarithm of (share of a bucket in label 1) / (share in label 0), with one added to every count; 0 if not clear."""
    def counts(label: int) -> tuple[np.ndarray, int]:
        own = [s for s, y in zip(sets, labels) if y == label]
        return np.bincount(np.concatenate([*own, np.zeros(0, np.uint32)]).astype(np.int64), minlength=1 << BITS), len(own)

    def part(seen: np.ndarray, due: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(due, 1e-9)), 0)

    (ones, n1), (zeros, n0) = counts(1), counts(0)
    share = (ones + zeros) / max(1, n1 + n0)
    likelihood = 2 * (part(ones, n1 * share) + part(zeros, n0 * share)
                      + part(n1 - ones, n1 * (1 - share)) + part(n0 - zeros, n0 * (1 - share)))
    clear = likelihood >= LEAST_RATIO
    return np.where(clear, np.log((ones + 1) / (n1 + 2) / ((zeros + 1) / (n0 + 2))), 0).astype(np.float32)


def regress(sets: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on the scaled sets by gradient steps with per-weight step sizes.

    Both labels count alike, whatever their number of rows.
    """
    y, n = labels.astype(float), len(labels)
    weight, bias = np.zeros(1 << BITS, dtype=np.float32), 0.0
    if not 0 < y.sum() < n:
        return weight, float(np.clip(y.sum() * 2 - n, -5, 5))
    clear = np.flatnonzero(ratio)
    place = np.full(1 << BITS, -1)
    place[clear] = np.arange(len(clear))
    kept = [place[s[ratio[s] != 0]] for s in sets]
    at, row = np.concatenate(kept), np.repeat(np.arange(n), [len(k) for k in kept])
    value = SCALE * ratio[clear].astype(float)[at]
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    now, first, second = np.zeros(len(clear) + 1), np.zeros(len(clear) + 1), np.zeros(len(clear) + 1)
    for turn in range(1, ROUNDS + 1):
        z = np.bincount(row, weights=value * now[at], minlength=n) + now[-1]
        error = each * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        slope = np.bincount(at, weights=value * error[row], minlength=len(clear)) + PENALTY * now[:-1]
        slope = np.append(slope, error.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        now = now - STEP * (first / (1 - 0.9 ** turn)) / (np.sqrt(second / (1 - 0.99 ** turn)) + 1e-9)
    weight[clear] = now[:-1]
    return weight, float(now[-1])


def fit(train: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit on the rows of ``train`` that ``labels`` (identifier, 0 or 1) names. Other labels, and null, are left out.

    One task fits the model on the sampled rows. Without rows of both labels every text scores near 0 or 1 alike;
    without any row, one half.
    """
    document_batches(train.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("id").isNotNull()).dropDuplicates(["id"])
    known = known.join(train.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    number = {row["label"]: row["n"] for row in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("label") == 1, 2 * fit_rows / max(1, number.get(1, 0))).otherwise(2 * fit_rows / max(1, number.get(0, 0)))
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    some = known.where(below(F.col("id"), share)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= fit_rows)
    # at most 2 * fit_rows identifiers
    rows = train.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(
        F.broadcast(some), "id").select("label", "rank", "text")
    rows = rows.groupBy("label", "rank").agg(F.min("text").alias("text"))  # identifiers may repeat

    @tidy
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = Distinct(BITS)
        for batch in text_slices(batches, 2):
            sets = [distinct(grams(codes(text), ORDERS, BITS)).tobytes() for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.binary())], names=["label", "rank", "set"])

    @tidy
    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(
            (label, rank, value) for b in batches for label, rank, value in zip(*(c.to_pylist() for c in b.columns)))
        found = list({(label, value): (label, rank, value) for label, rank, value in reversed(found)}.values())[::-1]  # copies once
        sets, marks = [np.frombuffer(s, dtype=np.uint32) for _, _, s in found], np.array([y for y, _, _ in found])
        del found
        ratio = log_ratios(sets, marks)
        weight, bias = regress(sets, marks, ratio) if sets else (np.zeros(1 << BITS, dtype=np.float32), 0.0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([ratio.tobytes()], pa.binary()), pa.array([weight.tobytes()], pa.binary()), pa.array([bias])],
            names=["ratio", "weight", "bias"])

    sets = rows.mapInArrow(features, "label int, rank int, set binary").repartition(1)
    fitted = sets.mapInArrow(model, "ratio binary, weight binary, bias double").collect()
    prior = number.get(1, 0) / max(1, sum(number.values())) if number else 0.5
    if not fitted:
        return ToxicityModel(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, prior)
    ratio, weight = (np.frombuffer(fitted[0][c], dtype=np.float32) for c in ("ratio", "weight"))
    return ToxicityModel(ratio, weight, fitted[0]["bias"], prior)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row. A null text, or one too short for an n-gram, scores the share of label 1."""
    document_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, distinct = shared.value, Distinct(BITS)
        scaled = (SCALE * m.ratio * m.weight).astype(np.float64)
        for batch in text_slices(batches, 1):
            found = np.full(batch.num_rows, m.prior)
            for i, text in enumerate(batch.column(1).to_pylist()):
                held = distinct(grams(codes(text), ORDERS, BITS)) if text else ()
                if len(held):
                    found[i] = 1 / (1 + np.exp(-np.clip(scaled[held].sum() + m.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                names=[id_col, "score", "predicted"])

    kind = chosen.schema[0].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
