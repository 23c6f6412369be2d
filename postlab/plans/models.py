"""Pipelines: feature stages in front of a classifier, and how to fit and apply them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest,
)
from pyspark.ml.feature import (
    CountVectorizerModel, HashingTF, NGram, Normalizer, SQLTransformer, VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.operators.foldstats import WHOLE, Side, counts_column, sides
from postlab.plans.components import components_stage, fit_components
from postlab.plans.selection import Chosen, FoldFeatures, chosen_stages

# ---- fixed values: default settings -----------------------------------------------------------------
TASK_CLASSES = {"relevance": 2, "sentiment": 3}
TF_WIDTH = 16384
TOP_FEATURES = 1000
PCA_WIDTH = 100
GBT_DEPTH = 10
GBT_TREES = {"relevance": 100, "sentiment": 30}
MLP_HIDDEN = [500]
MLP_BLOCK = 128
MLP_ITERATIONS = 100
SEQUENCE_HIDDEN = [128, 100]
BUCKETS = 1 << 18
#: A training set has a partition for so many rows at most: solvers start a job with a task per partition in every step.
FIT_ROWS = 2000
# ---- end of fixed values ------------------------------------------------------------------------------


#: Rows of a partition beyond which a training set has more partitions than there are cores.
MOST_ROWS = 20_000


def n_partitions(rows: int, cores: int) -> int:
    """Partitions of a training set: a further one only costs a task in every step, unless it gives a core work or bounds the memory."""
    return max(1, min(-(-rows // FIT_ROWS), max(cores, -(-rows // MOST_ROWS))))


@dataclass(frozen=True)
class Plan:
    """Feature blocks and classifiers of one named combination.

    ``base`` blocks are assembled first and may be cut down by chi-square (``top``) or PCA (``pca``);
    ``extra`` blocks are appended after that. ``settings`` hold for all classifiers, or under the name of one
    for that one; a value may be given per task.
    """

    base: tuple[str, ...]
    extra: tuple[str, ...] = ()
    top: int | None = None
    pca: int | None = None
    tf_width: int = TF_WIDTH
    models: tuple[str, ...] = ("gbt",)
    tasks: tuple[str, ...] = ("sentiment", "relevance")
    folds: int = 5
    settings: dict = field(default_factory=dict)


def feature_stages(plan: Plan, lexicon_words: list[str] | None = None) -> tuple[list, list[str], list[str]]:
    """Stages of the blocks other than terms, and the columns of the base and of what is appended to it.

    With selection the dense blocks of the base are assembled to ``_dense``, whose entries are chosen later.
    """
    stages: list = []

    def column(block: str) -> list[str]:
        if block == "tfidf":
            return []
        if block == "grams":
            grams = "stems"
            if plan.settings.get("word_ngrams", 1) == 2:
                stages.append(NGram(n=2, inputCol="stems", outputCol="_bigrams"))
                stages.append(SQLTransformer(
                    statement="SELECT *, concat(stems, _bigrams) AS _grams FROM __THIS__"))
                grams = "_grams"
            stages.append(HashingTF(inputCol=grams, outputCol="_counts",
                                    numFeatures=plan.settings.get("bucket", BUCKETS)))
            stages.append(Normalizer(inputCol="_counts", outputCol="_unit", p=2.0))
            return ["_unit"]
        if block == "lex":
            stages.append(CountVectorizerModel.from_vocabulary(
                lexicon_words, inputCol="tokens", outputCol="_present", binary=True))
            return ["lexc", "_present"]
        return [block]

    base = [c for block in plan.base for c in column(block)]
    if (plan.top or "tfidf" in plan.base) and base:
        stages.append(VectorAssembler(inputCols=base, outputCol="_dense"))
        base = ["_dense"]
    return stages, base, [c for block in plan.extra for c in column(block)]


def fold_features(data: DataFrame, plan: Plan, parts: list[Side] | None = None, marks: tuple[str, ...] = (),
                  tasks: tuple[str, ...] | None = None) -> FoldFeatures | None:
    """The counts behind the term features of a plan; None for a plan without terms and selection."""
    if "tfidf" not in plan.base and not plan.top:
        return None
    return FoldFeatures(data, plan.base, plan.tf_width, parts or sides(0), list(marks), tuple(tasks or plan.tasks))


def fit_features(train: DataFrame, plan: Plan, task: str, lexicon_words: list[str] | None = None,
                 chosen: Chosen | None = None) -> PipelineModel:
    """The stages of a plan, ending in the column ``features``.

    Terms and selected scores need no fit: ``chosen`` says which, from the statistics of this training side; without it
    they are counted here. Selection looks at the rounded features, and the classifier gets the unrounded ones.
    """
    stages, base, extra = feature_stages(plan, lexicon_words)
    if chosen is None and (counts := fold_features(train, plan, tasks=(task,))):
        chosen = counts.chosen(task, plan.top)[WHOLE]
    if chosen is not None:
        counts_col = counts_column(plan.tf_width)
        own, base = chosen_stages(
            chosen, plan.tf_width, "_dense" if base else None, counts_col if counts_col in train.columns else None)
        stages = [*stages, *own]
    if plan.pca:
        stages.append(VectorAssembler(inputCols=base, outputCol="_base"))
        rows = PipelineModel(stages=list(stages)).transform(train).select(F.col("_base").alias("_base", metadata={}))
        first = rows.head()
        found = fit_components(rows, "_base", first["_base"].size if first else 0, plan.pca)
        stages.append(components_stage(found, "_base", "_components"))
        base = ["_components"]
    stages.append(VectorAssembler(inputCols=base + extra, outputCol="features"))
    return PipelineModel(stages=stages)


def classifier(kind: str, task: str, width: int, settings: dict) -> Estimator:
    """The classifier of a plan; ``width`` is the number of features it will see."""
    common = {"featuresCol": "features", "labelCol": task}
    multiclass = TASK_CLASSES[task] > 2
    own = {**settings, **settings.get(kind, {})}
    settings = {k: v.get(task) if isinstance(v, dict) else v for k, v in own.items()}
    seed = settings.get("seed", 1)
    if kind == "gbt":
        model = GBTClassifier(
            **common, maxIter=settings.get("trees", GBT_TREES[task]),
            maxDepth=settings.get("depth", GBT_DEPTH), seed=seed,
        )
        return OneVsRest(classifier=model, parallelism=TASK_CLASSES[task], **common) if multiclass else model
    if kind == "svc":
        model = LinearSVC(**common, maxIter=settings.get("iterations", 100))
        return OneVsRest(classifier=model, parallelism=TASK_CLASSES[task], **common) if multiclass else model
    if kind == "logreg":
        return LogisticRegression(
            **common, maxIter=settings.get("iterations", 100),
            standardization=settings.get("standardize", True),
        )
    if kind == "mlp":
        return MultilayerPerceptronClassifier(
            **common, layers=[width, *settings.get("hidden", MLP_HIDDEN), TASK_CLASSES[task]],
            blockSize=MLP_BLOCK, maxIter=settings.get("iterations", MLP_ITERATIONS), seed=seed,
        )
    raise ValueError(f"unknown classifier {kind}")


def fit(train: DataFrame, plan: Plan, kind: str, task: str,
        lexicon_words: list[str] | None = None, chosen: Chosen | None = None) -> Transformer:
    """Fit feature stages and classifier on ``train`` (feature blocks and the task's label column)."""
    labelled = train.withColumn(task, F.col(task).cast("double"))
    stages = fit_features(labelled, plan, task, lexicon_words, chosen)
    few = n_partitions(labelled.count(), labelled.sparkSession.sparkContext.defaultParallelism)
    # without the names of its entries: the plan, and with it each task of each step, would carry one for every feature
    plain = F.col("features").alias("features", metadata={})
    features = stages.transform(labelled).select(task, plain).coalesce(few).persist()
    try:
        first = features.select("features").head()
        model = classifier(kind, task, first["features"].size, plan.settings).fit(features)
    finally:
        features.unpersist()
    return PipelineModel(stages=[stages, model])


def predict(model: Transformer, df: DataFrame, key: str, name: str = "prediction") -> DataFrame:
    """(key, prediction) for every row."""
    return model.transform(df).select(key, F.col("prediction").alias(name))
