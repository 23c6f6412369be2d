"""Cross-validation with one metric per fold."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark.ml import Transformer
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.operators.folds import keyed_folds

Fit = Callable[[DataFrame], Transformer]


def score(model: Transformer, validation: DataFrame, task: str, metric: str = "f1") -> float:
    """Weighted F1 (or ``accuracy``, which is micro F1 for single labels) on a validation set."""
    predicted = model.transform(validation.withColumn(task, F.col(task).cast("double")))
    evaluator = MulticlassClassificationEvaluator(
        labelCol=task, predictionCol="prediction", metricName=metric
    )
    return evaluator.evaluate(predicted.select(task, "prediction"))


def cross_validate(data: DataFrame, fits: dict[str, Fit], task: str, key: str, k: int = 5,
                   seed: int = 1, validation: DataFrame | None = None,
                   augmentation: DataFrame | None = None, metric: str = "f1",
                   parallelism: int = 1) -> DataFrame:
    """(param_set, fold, f1): every fit function on every fold.

    Folds come from the key hash. With ``validation`` each fold trains on its part of ``data`` and is
    scored on the same-numbered fold of ``validation``; with ``augmentation`` those rows join the
    training side of every fold. ``parallelism`` folds run at the same time.
    """
    folded = keyed_folds(data, key, k, seed)
    held_out = folded if validation is None else keyed_folds(validation, key, k, seed)

    def run(job: tuple[str, int]) -> tuple[str, int, float]:
        name, fold = job
        train = folded.where(F.col("fold") != fold).drop("fold")
        if augmentation is not None:
            train = train.unionByName(augmentation)
        model = fits[name](train)
        return name, fold, score(model, held_out.where(F.col("fold") == fold).drop("fold"), task, metric)

    jobs = [(name, fold) for name in fits for fold in range(k)]
    with ThreadPool(max(1, parallelism)) as pool:
        results = pool.map(run, jobs)
    return data.sparkSession.createDataFrame(results, f"param_set string, fold int, {metric} double")


def mean_metric(results: DataFrame, metric: str = "f1") -> DataFrame:
    """(param_set, average): the mean over the folds."""
    return results.groupBy("param_set").agg(F.avg(metric).alias("average"))


def holdout(train: DataFrame, validation: DataFrame, fit: Fit, task: str, metric: str = "f1") -> float:
    """One fit on the training set, scored on the validation set."""
    return score(fit(train), validation, task, metric)
