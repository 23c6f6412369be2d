"""The named combinations of feature blocks and classifiers."""

from __future__ import annotations

from dataclasses import replace
from hashlib import md5
from multiprocessing.pool import ThreadPool
from statistics import mean

from pyspark.ml import Transformer
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.operators.folds import keyed_folds
from postlab.operators.foldstats import Side, sides
from postlab.plans.models import PCA_WIDTH, TASK_CLASSES, TOP_FEATURES, Plan, fit, fold_features, predict
from postlab.plans.selection import FoldFeatures
from postlab.plans.validation import cross_validate, score
from postlab.sources.writers import submission

# ---- fixed values: the combinations and their settings ------------------------------------------------
EVERYTHING = 16384 + 93
NO_HIDDEN = {"mlp": {"hidden": []}}
DEFAULT_TREES = {"trees": 20, "depth": 5}
LINEAR_TEXT = {"standardize": False}
PLANS: dict[str, Plan] = {
    # predictions for submission
    "submit_embeddings": Plan(("w2v", "dict", "lex")),
    "submit_terms": Plan(("tfidf", "dict"), top=TOP_FEATURES),
    "submit_linear_text": Plan(("grams",), models=("logreg",), settings=LINEAR_TEXT),
    # feature and model comparison
    "compare_terms_dict": Plan(("tfidf", "dict"), top=TOP_FEATURES, models=("gbt", "mlp")),
    "compare_terms": Plan(("tfidf",), top=TOP_FEATURES, models=("gbt", "mlp")),
    "compare_terms_spell": Plan(("tfidf", "spell"), top=TOP_FEATURES, models=("gbt", "mlp")),
    "compare_embeddings": Plan(("w2v",), models=("gbt", "mlp"), settings=NO_HIDDEN),
    "compare_embeddings_dict": Plan(("w2v", "dict"), models=("gbt", "mlp"), settings=NO_HIDDEN),
    "compare_embeddings_lex": Plan(("w2v", "lex"), models=("gbt", "mlp"), settings=NO_HIDDEN),
    "compare_embeddings_dict_lex": Plan(("w2v", "dict", "lex"), models=("gbt", "mlp"), settings=NO_HIDDEN),
    "compare_linear_text": Plan(("grams",), models=("logreg",), settings=LINEAR_TEXT),
    # single studies
    "bare_terms": Plan(
        ("tfidf",), top=TOP_FEATURES, models=("mlp", "gbt", "svc", "logreg"), settings={"gbt": DEFAULT_TREES}),
    "terms_lexicon_clusters": Plan(
        ("tfidf", "dict"), ("lexc", "km"), top=TOP_FEATURES, settings={"trees": 100}),
    "terms_components": Plan(
        ("tfidf",), ("lex", "dict", "spell"), pca=PCA_WIDTH, tf_width=8192,
        models=("mlp", "gbt", "svc", "logreg"),
        settings={"gbt": DEFAULT_TREES, "mlp": {"hidden": [100], "iterations": 200}}),
    "embeddings": Plan(
        ("w2v", "dict", "lex"), models=("mlp", "logreg", "gbt", "svc"),
        settings={**NO_HIDDEN, "gbt": {"trees": 20, "depth": {"sentiment": 10, "relevance": 5}}}),
    "embeddings_clusters": Plan(
        ("w2v", "dict", "lex", "km"), models=("gbt", "logreg"), tasks=("sentiment",), folds=3,
        settings={"gbt": {"trees": 20, "depth": 5}}),
    "embeddings_clusters_spell": Plan(
        ("w2v", "dict", "lex", "km", "spell"), models=("gbt", "logreg"), tasks=("sentiment",), folds=2,
        settings={"gbt": {"trees": 20, "depth": 8}}),
    "linear_text": Plan(("grams",), models=("logreg",), settings=LINEAR_TEXT),
    "scores_only": Plan(("dict",), models=("mlp",), settings={"hidden": [50]}),
    "matrix_clusters": Plan(("w2v",), ("km",), models=()),
    "matrix_all": Plan(("w2v", "dict", "km"), models=()),
    "terms_all_selected": Plan(("tfidf", "dict"), top=EVERYTHING, models=()),
}
# ---- end of fixed values --------------------------------------------------------------------------------


def with_settings(plan: Plan, **settings) -> Plan:
    """The same combination with other model settings."""
    return replace(plan, settings={**plan.settings, **settings})


def train_and_predict(train: DataFrame, test: DataFrame, plan: Plan, kind: str, task: str, key: str,
                      lexicon_words: list[str] | None = None) -> tuple[Transformer, DataFrame]:
    model = fit(train, plan, kind, task, lexicon_words)
    return model, predict(model, test, key)


def submit(train: DataFrame, test: DataFrame, texts: DataFrame, plan: Plan, task: str, key: str,
           kind: str | None = None, lexicon_words: list[str] | None = None) -> DataFrame:
    """Train on all labelled rows, predict the test rows, one submission row per id."""
    _, predictions = train_and_predict(
        train, test, plan, kind or plan.models[0], task, key, lexicon_words)
    return submission(texts.join(predictions, key), task, id_col=key)


def compare(data: DataFrame, plans: dict[str, Plan], task: str, key: str,
            lexicon_words: list[str] | None = None, k: int | None = None,
            parallelism: int = 1) -> DataFrame:
    """(param_set, fold, f1) of every plan and model for a task."""
    parts = []
    for name, plan in plans.items():
        if task not in plan.tasks:
            continue
        fits = {
            f"{name}:{kind}": (lambda train, p=plan, m=kind: fit(train, p, m, task, lexicon_words))
            for kind in plan.models
        }
        parts.append(cross_validate(data, fits, task, key, k or plan.folds, parallelism=parallelism))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.withColumn("task", F.lit(task))


class ScoreLog:
    """Scores of single fits in a shared folder, so that a run whose driver was lost goes on where it ended.

    Each fit has a folder of its own, named by a digest of all that decides its score but the data; fits may be written at the same
    time and once more, and one that was broken off leaves nothing to read. A folder belongs to one feature table.
    """

    SCHEMA = "fit string, task string, fold int, f1 double"

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    @staticmethod
    def name(plan: Plan, kind: str, task: str, number: int, seed: int) -> str:
        return md5(repr((plan, kind, task, number, seed)).encode()).hexdigest()

    def known(self) -> dict[str, float]:
        rows = self.spark.read.schema(self.SCHEMA).option("recursiveFileLookup", "true")
        try:
            return {r["fit"]: r["f1"] for r in rows.parquet(self.folder).collect()}  # a row per fit
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}

    def add(self, fit_name: str, task: str, number: int, f1: float) -> None:
        row = self.spark.createDataFrame([(fit_name, task, number, f1)], self.SCHEMA).coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.folder}/{fit_name}")


#: Folds below 0 in a table of scores: the mean of the folds, and the fit on one split that is scored on the other.
MEAN, HOLDOUT = -1, -2


class Scores:
    """Fold and hold-out scores of plans on one feature table, with the statistics of all training sides counted once.

    ``data`` has the feature blocks, the labels and a boolean column ``dev``. The folds come from the key hash. Plans
    that start from the same terms share a cube; folds, hold-out, tasks and models run in one pool. With a folder ``log``
    each score is written there when its fit is done, and a later run over the same data fits only the rest.
    """

    def __init__(self, data: DataFrame, key: str, lexicon_words: list[str] | None = None, seed: int = 1,
                 log: str | None = None):
        self.log = ScoreLog(data.sparkSession, log) if log else None
        self.data, self.key, self.lexicon_words, self.seed = data, key, lexicon_words, seed
        self._counts: dict[tuple, FoldFeatures | None] = {}

    def _side(self, k: int, number: int) -> Side:
        return next(s for s in sides(k, "fold", "dev") if s.number == number)

    def _folded(self, k: int) -> DataFrame:
        return keyed_folds(self.data, self.key, k, self.seed)

    def counts(self, plan: Plan) -> FoldFeatures | None:
        """The counts of a plan's terms for all its training sides and both tasks."""
        sort = (plan.base, plan.tf_width, plan.folds)
        if sort not in self._counts:
            self._counts[sort] = fold_features(
                self._folded(plan.folds), plan, sides(plan.folds, "fold", "dev"), ("fold", "dev"), tuple(TASK_CLASSES))
        return self._counts[sort]

    def table(self, plan: Plan, kind: str, tasks: tuple[str, ...] | None = None, parallelism: int = 8) -> list[tuple[str, int, float]]:
        """(task, fold, f1) rows: each fold, the mean and the hold-out score."""
        jobs = [(task, n) for task in tasks or plan.tasks for n in [HOLDOUT, *range(plan.folds)]]
        names = {job: ScoreLog.name(plan, kind, *job, self.seed) for job in jobs}
        known = self.log.known() if self.log else {}
        done = [(*job, known[names[job]]) for job in jobs if names[job] in known]
        left = [job for job in jobs if names[job] not in known]
        folded, counts = self._folded(plan.folds), self.counts(plan) if left else None
        chosen = {task: counts.chosen(task, plan.top) for task, _ in left} if counts else {}

        def run(job: tuple[str, int]) -> tuple[str, int, float]:
            task, number = job
            held = self._side(plan.folds, number).held
            model = fit(folded.where(~held), plan, kind, task, self.lexicon_words,
                        chosen[task][number] if counts else None)
            f1 = score(model, folded.where(held), task)
            if self.log:
                self.log.add(names[job], task, number, f1)
            return task, number, f1

        with ThreadPool(max(1, parallelism)) as pool:
            found = done + pool.map(run, left, chunksize=1)
        means = [(task, MEAN, mean(f for t, n, f in found if t == task and n >= 0)) for task in dict.fromkeys(t for t, _ in jobs)]
        return sorted([*found, *means])


def only_models(plan: Plan, *kinds: str) -> Plan:
    return replace(plan, models=kinds)
