"""Catalogue queries that fit models. Results depend on the fit, so they have no SQL counterpart."""

from __future__ import annotations

from functools import partial

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.functions.normalize import normalize_tokens, raw_tokens
from postlab.functions.stem import stem_german
from postlab.operators import evaluation, foldstats
from postlab.operators import wordvectors as wv
from postlab.operators.terms import stem_tokens, vocabulary
from postlab.plans import catalog, embedtext
from postlab.plans.features import cluster_features, fit_clusters, fit_word_vectors
from postlab.plans.models import PCA_WIDTH, SEQUENCE_HIDDEN, TASK_CLASSES, TF_WIDTH, TOP_FEATURES, Plan, fit, predict
from postlab.plans.validation import cross_validate, holdout, mean_metric
from postlab.queries import FOLDS, SEED, query, r6
from postlab.session import stored
from postlab.sources.writers import feature_line
from postlab.testtables import DIM, N_CLUSTERS, Tables, in_dev, tables

# ---- fixed values: settings of the feature queries; models have those of their plans --------------------
WORD_DIM, WORD_MIN_COUNT, WORD_PARTITIONS = 100, 5, 8
SEQUENCE = 15
# ---- end of fixed values ----------------------------------------------------------------------------------

_BOW = catalog.PLANS["bare_terms"]
_EMBEDDED = catalog.PLANS["submit_embeddings"]


def _predictions(t: Tables, plan: Plan, kind: str, task: str) -> DataFrame:
    """Fit on the labelled documents, predict all of them and the unlabelled ones."""
    model = fit(t.labelled_features, plan, kind, task, t.lexicon_words)
    scored = predict(model, t.features, "doc_id")
    return t.features.select("doc_id", F.col(task).alias("label")).join(scored, "doc_id")


@query
def gbt_relevance(spark, sf):
    return _predictions(tables(spark, sf), _EMBEDDED, "gbt", "relevance")


@query
def ovr_gbt_sentiment(spark, sf):
    return _predictions(tables(spark, sf), _EMBEDDED, "gbt", "sentiment")


@query
def svc_relevance(spark, sf):
    return _predictions(tables(spark, sf), _BOW, "svc", "relevance")


@query
def ovr_svc_sentiment(spark, sf):
    return _predictions(tables(spark, sf), _BOW, "svc", "sentiment")


@query
def logreg_relevance(spark, sf):
    return _predictions(tables(spark, sf), _BOW, "logreg", "relevance")


@query
def logreg_sentiment(spark, sf):
    return _predictions(tables(spark, sf), _BOW, "logreg", "sentiment")


@query
def mlp_relevance(spark, sf):
    return _predictions(tables(spark, sf), catalog.PLANS["scores_only"], "mlp", "relevance")


@query
def mlp_sentiment(spark, sf):
    return _predictions(tables(spark, sf), catalog.PLANS["scores_only"], "mlp", "sentiment")


@query
def linear_text_relevance(spark, sf):
    return _predictions(tables(spark, sf), catalog.PLANS["linear_text"], "logreg", "relevance")


@query
def linear_text_sentiment(spark, sf):
    return _predictions(tables(spark, sf), catalog.PLANS["linear_text"], "logreg", "sentiment")


@query
def terms_lexicon_clusters_relevance(spark, sf):
    return _predictions(tables(spark, sf), catalog.PLANS["terms_lexicon_clusters"], "gbt", "relevance")


@query
def terms_components_relevance(spark, sf):
    """Principal components of the term weights with lexicon, scores and spelling."""
    return _predictions(tables(spark, sf), catalog.PLANS["terms_components"], "logreg", "relevance")


@query
def embeddings_clusters_sentiment(spark, sf):
    return _predictions(tables(spark, sf), catalog.PLANS["embeddings_clusters_spell"], "gbt", "sentiment")


@query
def embeddings_logreg_sentiment(spark, sf):
    return _predictions(tables(spark, sf), catalog.PLANS["embeddings"], "logreg", "sentiment")


@query
def linear_text_raw_sentiment(spark, sf):
    """The linear text classifier on stems of the uncleaned tokens."""
    t = tables(spark, sf)
    docs = stored(t.texts.select("doc_id", raw_tokens(F.col("text")).alias("tokens")))
    stems = stored(
        stem_tokens(docs, ["doc_id"], stem_german).join(t.labels, "doc_id", "left"))
    plan = catalog.PLANS["linear_text"]
    model = fit(stems.where(F.col("sentiment").isNotNull()), plan, "logreg", "sentiment")
    return stems.select("doc_id", F.col("sentiment").alias("label")).join(predict(model, stems, "doc_id"), "doc_id")


def _stems(t: Tables, tokenise) -> DataFrame:
    """(doc_id, stems, relevance, sentiment) of every document; labels are null where there are none."""
    docs = stored(t.texts.select("doc_id", tokenise(F.col("text")).alias("tokens")))
    return stored(stem_tokens(docs, ["doc_id"], stem_german).select("doc_id", "stems").join(t.labels, "doc_id", "left"))


def _embedded_text(t: Tables, tokenise, task: str) -> DataFrame:
    """The text classifier with learned embeddings, fitted on the labelled documents, on all documents."""
    stems = _stems(t, tokenise)
    model = embedtext.fit(stems, "doc_id", "stems", task, TASK_CLASSES[task])
    return stems.select("doc_id", F.col(task).alias("label")).join(predict(model, stems, "doc_id"), "doc_id")


@query
def embedded_text_relevance(spark, sf):
    return _embedded_text(tables(spark, sf), normalize_tokens, "relevance")


@query
def embedded_text_sentiment(spark, sf):
    return _embedded_text(tables(spark, sf), normalize_tokens, "sentiment")


@query
def embedded_text_raw_relevance(spark, sf):
    """On stems of the uncleaned tokens."""
    return _embedded_text(tables(spark, sf), raw_tokens, "relevance")


@query
def embedded_text_raw_sentiment(spark, sf):
    return _embedded_text(tables(spark, sf), raw_tokens, "sentiment")


def _submission(t: Tables, name: str, task: str) -> DataFrame:
    """Train on the labelled documents, submission rows for the others."""
    plan = catalog.PLANS[name]
    test = t.features.where(F.col("relevance").isNull())
    return catalog.submit(
        t.labelled_features, test, t.texts, plan, task, "doc_id", lexicon_words=t.lexicon_words)


@query
def submit_embeddings_sentiment(spark, sf):
    return _submission(tables(spark, sf), "submit_embeddings", "sentiment")


@query
def submit_embeddings_relevance(spark, sf):
    return _submission(tables(spark, sf), "submit_embeddings", "relevance")


@query
def submit_terms_sentiment(spark, sf):
    return _submission(tables(spark, sf), "submit_terms", "sentiment")


@query
def submit_terms_relevance(spark, sf):
    return _submission(tables(spark, sf), "submit_terms", "relevance")


@query
def submit_linear_text_sentiment(spark, sf):
    return _submission(tables(spark, sf), "submit_linear_text", "sentiment")


@query
def submit_linear_text_relevance(spark, sf):
    return _submission(tables(spark, sf), "submit_linear_text", "relevance")


@query
def cluster_matrix_lines(spark, sf):
    """Feature matrix lines of mean vector, scores and cluster membership."""
    parts = [vector_to_array(c) for c in ("w2v", "dict", "km")]
    return tables(spark, sf).features.select("doc_id", feature_line(F.concat(*parts)).alias("line"))


@query
def matrix_cluster_lines(spark, sf):
    """Feature matrix lines of the cluster membership of the mean vector, after the label."""
    t = tables(spark, sf)
    return t.labelled_features.select(
        "doc_id", feature_line(vector_to_array("km"), F.col("sentiment")).alias("line"))


def _sequence_predictions(t: Tables, task: str) -> DataFrame:
    """Word vectors trained on the corpus, padded sequences, a perceptron on top."""
    docs = stored(t.tokens)
    vectors = fit_word_vectors(docs, WORD_DIM, WORD_MIN_COUNT, SEED, partitions=WORD_PARTITIONS).join(vocabulary(docs), "word")
    padded = wv.padded_sequences(docs, stored(vectors), ["doc_id"], SEQUENCE, WORD_DIM)
    blocks = stored(
        padded.select("doc_id", array_to_vector("sequence").alias("sequence"))
        .join(t.labels, "doc_id", "left")
    )
    plan = Plan(("sequence",), models=("mlp",), settings={"hidden": SEQUENCE_HIDDEN})
    model = fit(blocks.where(F.col(task).isNotNull()), plan, "mlp", task)
    return blocks.select("doc_id", F.col(task).alias("label")).join(predict(model, blocks, "doc_id"), "doc_id")


@query
def sequence_mlp_relevance(spark, sf):
    return _sequence_predictions(tables(spark, sf), "relevance")


@query
def sequence_mlp_sentiment(spark, sf):
    return _sequence_predictions(tables(spark, sf), "sentiment")


# ---- feature stages on their own ----------------------------------------------------------------------------

@query
def hashed_tf(spark, sf):
    """(doc_id, bucket, tf) of the hashed stem counts."""
    cells = foldstats.bucket_counts(tables(spark, sf).features, ["doc_id"], TF_WIDTH)
    return cells.select("doc_id", F.col("feature").alias("bucket"), F.col("value").alias("tf"))


@query
def fold_statistics(spark, sf):
    """Documents, document frequency and idf of every bucket on every training side (fold, -1: all, -2: the train split)."""
    counts = _scores(tables(spark, sf)).counts(catalog.PLANS["compare_terms_dict"])
    return counts.frequencies().select("side", "feature", "df", foldstats.six_digits(F.col("idf")).alias("idf"))


def _selected(spark, sf, task: str, top: int | None) -> DataFrame:
    ranked = _scores(tables(spark, sf)).counts(catalog.PLANS["compare_terms_dict"]).ranked(task)
    chosen = ranked.where(F.col("rank") <= top) if top else ranked
    return chosen.select("side", "feature", (F.col("feature") >= TF_WIDTH).alias("dense"), foldstats.six_digits(F.col("statistic")).alias("statistic"),
                         "dof", "log_p", "rank")


@query
def chi2_select(spark, sf):
    """The features kept by chi-square out of hashed TF-IDF and scores for relevance, on every training side."""
    return _selected(spark, sf, "relevance", TOP_FEATURES)


@query
def chi2_select_sentiment(spark, sf):
    """The same for sentiment."""
    return _selected(spark, sf, "sentiment", TOP_FEATURES)


@query
def chi2_all_features(spark, sf):
    """All hashed terms and scores by chi-square with relevance."""
    return _selected(spark, sf, "relevance", None)


@query
def chi2_all_features_sentiment(spark, sf):
    """All hashed terms and scores by chi-square with sentiment."""
    return _selected(spark, sf, "sentiment", None)


def _dense_among_best(spark, sf, task: str) -> DataFrame:
    best = _selected(spark, sf, task, TOP_FEATURES).where(F.col("side") == foldstats.WHOLE)
    place = F.when(F.col("dense"), F.col("feature") - TF_WIDTH + 1)
    return best.agg(F.count(place).alias("n_selected"), F.array_join(
        F.transform(F.array_sort(F.collect_list(place)), lambda i: i.cast("string")), " ").alias("selected"))


@query
def dense_among_best(spark, sf):
    """How many of the dense scores, and which (from 1 on), are among the best features of the corpus for relevance."""
    return _dense_among_best(spark, sf, "relevance")


@query
def dense_among_best_sentiment(spark, sf):
    """The same for sentiment."""
    return _dense_among_best(spark, sf, "sentiment")


@query
def pca_embeddings(spark, sf):
    points = tables(spark, sf).embeddings.select("vec_id", array_to_vector("vector").alias("v"))
    reduced = PCA(k=min(PCA_WIDTH, DIM), inputCol="v", outputCol="p").fit(points).transform(points)
    return wv.long_form(reduced, ["vec_id"], vector_to_array("p")).withColumn("value", r6(F.col("value")))


@query
def kmeans_fit(spark, sf):
    """Centers of a K-means fit, one row per dimension."""
    model = fit_clusters(tables(spark, sf).embeddings, k=N_CLUSTERS, seed=SEED)
    rows = [(c, [float(x) for x in center]) for c, center in enumerate(model.clusterCenters())]
    return wv.long_form(spark.createDataFrame(rows, "center int, v array<double>"), ["center"], "v")


@query
def kmeans_cost(spark, sf):
    t = tables(spark, sf)
    return spark.createDataFrame([(float(t.clusters.summary.trainingCost),)], "wssse double")


@partial(query, name="cluster_features")
def cluster_features_of_documents(spark, sf):
    t = tables(spark, sf)
    scored = cluster_features(t.features.select("doc_id", "w2v"), t.clusters, "w2v", "km")
    return wv.long_form(scored, ["doc_id"], vector_to_array("km")).where(F.col("value") != 0)


@query
def word2vec_vocab(spark, sf):
    vectors = fit_word_vectors(
        tables(spark, sf).tokens, WORD_DIM, WORD_MIN_COUNT, SEED, partitions=WORD_PARTITIONS)
    return vectors.select("word", F.size("vector").alias("dim"))


# ---- evaluation -----------------------------------------------------------------------------------------------

def _cv_fits(task: str):
    return {"logreg": lambda train: fit(train, _BOW, "logreg", task)}


@query
def kfold_f1(spark, sf):
    t = tables(spark, sf)
    return cross_validate(
        t.labelled_features, _cv_fits("relevance"), "relevance", "doc_id", FOLDS, SEED, parallelism=FOLDS)


@query
def kfold_paired(spark, sf):
    """Train folds from the train split, validation folds from the dev split."""
    t = tables(spark, sf)
    train, dev = t.labelled_splits
    return cross_validate(
        train, _cv_fits("relevance"), "relevance", "doc_id", FOLDS, SEED, validation=dev, parallelism=FOLDS)


@query
def kfold_augmented(spark, sf):
    """The items of the benchmark table join the training side of each fold as relevant texts; folds and their mean.

    The mean stands under fold -1.
    """
    t = tables(spark, sf)
    items = t.table("benchmark").select(
        (-F.col("item_id") - 1).alias("doc_id"), normalize_tokens(F.col("text")).alias("tokens"))
    added = stem_tokens(items, ["doc_id"], stem_german).withColumn("relevance", F.lit(1))
    data = t.labelled_features.select("doc_id", "stems", "relevance")
    folds = cross_validate(
        data, _cv_fits("relevance"), "relevance", "doc_id", FOLDS, SEED, augmentation=added, parallelism=FOLDS)
    mean = mean_metric(folds).select("param_set", F.lit(-1).alias("fold"), F.col("average").alias("f1"))
    return folds.unionByName(mean)


@query
def holdout_f1(spark, sf):
    t = tables(spark, sf)
    train, dev = t.labelled_splits
    f1 = holdout(train, dev, _cv_fits("relevance")["logreg"], "relevance")
    return spark.createDataFrame([("logreg", f1)], "param_set string, f1 double")


@query
def plan_comparison(spark, sf):
    """Fold scores of the embedding combinations under the perceptron, for both tasks."""
    t = tables(spark, sf)
    names = ("compare_embeddings", "compare_embeddings_dict", "compare_embeddings_lex", "compare_embeddings_dict_lex")
    one_model = {n: catalog.only_models(catalog.PLANS[n], "mlp") for n in names}
    by_task = [
        catalog.compare(t.labelled_features, one_model, task, "doc_id", t.lexicon_words, parallelism=FOLDS)
        for task in ("relevance", "sentiment")
    ]
    return by_task[0].unionByName(by_task[1])


@query
def scores_only_confusion(spark, sf):
    """Confusion counts of the perceptron on dense scores over the labelled documents."""
    t = tables(spark, sf)
    scored = _predictions(t, catalog.PLANS["scores_only"], "mlp", "sentiment").where(F.col("label").isNotNull())
    return evaluation.confusion_matrix(scored, "label", "prediction", 3)


_SCORES: dict[int, catalog.Scores] = {}


def _scores(t: Tables) -> catalog.Scores:
    """The scores of a folder; the counts behind them are shared by all queries of one session."""
    if id(t) not in _SCORES:
        data = stored(t.labelled_features.withColumn("dev", in_dev(F.col("doc_id"))), "labelled")
        _SCORES[id(t)] = catalog.Scores(data, "doc_id", t.lexicon_words, SEED)
    return _SCORES[id(t)]


def _plan_scores(spark, sf, name: str, kind: str, task: str) -> DataFrame:
    """Folds, mean (fold -1) and hold-out score (fold -2) of a plan with one of its models for a task."""
    rows = _scores(tables(spark, sf)).table(catalog.PLANS[name], kind, (task,))
    return spark.createDataFrame(rows, "task string, fold int, f1 double").withColumn("param_set", F.lit(f"{name}:{kind}"))


# One query per plan, model and task, last in the catalogue: they fit six models each, the components take longest. Boosted
# trees of full depth and the regression over 2^18 buckets take minutes on any table and are left to ``Scores.table``.
_DEEP = [n for n, p in catalog.PLANS.items() if "gbt" in p.models and p.settings.get("gbt", p.settings).get("trees", 100) >= 100]
_WIDE = [n for n, p in catalog.PLANS.items() if "grams" in p.base]
for _name, _plan in sorted(catalog.PLANS.items(), key=lambda item: bool(item[1].pca)):
    for _kind in _plan.models:
        for _task in _plan.tasks:
            if _name not in _WIDE and not (_kind == "gbt" and _name in _DEEP):
                query(partial(_plan_scores, name=_name, kind=_kind, task=_task), f"scores_{_name}_{_kind}_{_task}")
