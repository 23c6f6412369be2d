"""The document feature table every model reads: one row per document, one column per feature block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postlab.functions.vectors import one_hot
from postlab.operators import foldstats
from postlab.operators import lexicon as lex
from postlab.operators import terms
from postlab.operators import wordvectors as wv
from postlab.operators.parts import Dealt, Matches, fields, in_parts, met


def two_digits(value: Column) -> Column:
    """A count rounded to two significant digits.

    Chi-square selection takes every distinct value as a category; this bounds their number (90 per
    power of ten) however large the corpus gets.
    """
    size = F.floor(F.log10(F.greatest(F.abs(value), F.lit(1e-9)))) - 1
    step = F.pow(F.lit(10.0), size)
    return F.when(value == 0, 0.0).otherwise(F.round(value / step) * step)


def document_features(docs: DataFrame | Dealt, key: str, *, vectors: DataFrame, dim: int, lexicon: DataFrame,
                      dictionary: DataFrame, words: DataFrame,
                      stemmer: Callable[[Column], Column],
                      clusters: KMeansModel | None = None, labels: DataFrame | None = None,
                      widths: tuple[int, ...] = (), kept: list[str] | None = None) -> DataFrame:
    """(key, tokens, stems, w2v, dict, dictbins, lexc, spell, spellbins, km, tf..., labels) for ``docs`` (key, tokens, scores).

    A document meets the words of all blocks in one pass over its part (``operators.parts``) and is moved once. A key that stands
    for several rows gives what joins of the blocks on it give; rows without a key go. ``labels`` (key, labels) are brought to the
    parts, so that no wide row is moved for them; they join as from the right of a left join. For each of ``widths`` there is a
    vector of hashed stem counts (``foldstats.counts_column``). With ``kept``, only those tokens stay, once a document.
    """
    counted = [foldstats.counts_column(w) for w in widths]
    own = [c for c in labels.columns if c != key] if labels is not None else []
    rows = docs.docs if isinstance(docs, Dealt) else docs

    def blocks(stem: Matches, vector: Matches, entry: Matches, known: Matches, labelled: pa.Table | None = None) -> pa.Table:
        row, at = lex.part_hits(entry)
        polarity = entry.table["polarity"].combine_chunks().take(pa.array(at))
        group = stem.group
        signs = [np.bincount(group[row], weights=pc.fill_null(pc.equal(polarity, p), False).to_numpy(zero_copy_only=False),
                             minlength=stem.groups).astype("float64")[group] for p in ("positive", "negative")]
        n, u = lex.part_unknown(known)
        made = pa.table({
            key: stem.docs[key], "tokens": stem.docs["tokens"] if kept is None else terms.part_kept(stem, kept),
            "scores": stem.docs["scores"], "stems": terms.part_stems(stem), **dict(zip(counted, foldstats.part_buckets(stem, widths) if widths else [])),
            "mean_vector": wv.part_means(vector, dim), "positive": signs[0], "negative": signs[1],
            "ratio": (u / np.maximum(n, 1))[group]})
        times = np.where(stem.null_key, 0, np.bincount(group, minlength=stem.groups)[group] ** 4)
        if not (times == 1).all():
            made = made.take(pa.array(np.repeat(np.arange(len(made)), times)))
        if labelled is None:
            return made
        place, at = met(made[key].combine_chunks(), labelled[key].combine_chunks())
        if len(place) > len(made):
            made = made.take(pa.array(place))
        for c in own:
            made = made.append_column(c, labelled[c].combine_chunks().take(pa.array(at, mask=at < 0)))
        return made

    stems = terms.stem_table(words, stemmer).select("word", "stem")
    tables = [
        stems.withColumn("hash", foldstats.hashed(F.col("stem"))) if widths else stems,
        vectors.select("word", "vector").where(F.col("vector").isNotNull()),
        lex.number_entries(lexicon).where(F.col("idx").isNotNull()), dictionary.select("word"),
    ]
    schema = StructType.fromDDL(f"{fields(rows, [key, 'tokens', 'scores'])}, stems array<string>")
    for name in counted:
        schema.add(name, VectorUDT())
    schema = StructType(schema.fields + StructType.fromDDL(
        "mean_vector array<double>, positive double, negative double, ratio double" + (f", {fields(labels, own)}" if own else "")).fields)
    found = in_parts(docs, [key], tables, blocks, schema, words=words, columns=("scores",), beside=labels)
    joined = found.select(
        key, "tokens", "stems",
        array_to_vector("mean_vector").alias("w2v"),
        array_to_vector("scores").alias("dict"),
        array_to_vector(F.transform("scores", two_digits)).alias("dictbins"),
        array_to_vector(F.array("positive", "negative")).alias("lexc"),
        array_to_vector(F.array("ratio")).alias("spell"),
        array_to_vector(F.array(two_digits(F.col("ratio")))).alias("spellbins"), *counted, *own,
    )
    if clusters is None:
        return joined
    return cluster_features(joined, clusters, "w2v", "km").select(*[c for c in joined.columns if c not in own], "km", *own)


def fit_clusters(vectors: DataFrame, k: int = 100, seed: int = 1, max_iter: int = 20,
                 vector: str = "vector") -> KMeansModel:
    """K-means on word vectors (``array<double>``)."""
    points = vectors.select(array_to_vector(vector).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features").fit(points)


def cluster_features(df: DataFrame, model: KMeansModel, features: str, name: str) -> DataFrame:
    """Add the one-hot cluster membership of a vector column."""
    scored = model.copy().setFeaturesCol(features).setPredictionCol("_cluster").transform(df)
    hot = one_hot(F.col("_cluster"), len(model.clusterCenters()))
    return scored.withColumn(name, array_to_vector(hot)).drop("_cluster")


def fit_word_vectors(docs: DataFrame, dim: int = 100, min_count: int = 5, seed: int = 1,
                     max_iter: int = 1, partitions: int = 1, tokens: str = "tokens") -> DataFrame:
    """(word, vector) trained on the documents, one row each."""
    model = Word2Vec(
        vectorSize=dim, minCount=min_count, seed=seed, maxIter=max_iter, numPartitions=partitions,
        inputCol=tokens, outputCol="_unused",
    ).fit(docs)
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))
