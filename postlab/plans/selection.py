"""Term features of a plan from fold statistics: bucket, idf and slot as plain parameters instead of fitted stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, SQLTransformer, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.operators import foldstats
from postlab.operators.foldstats import Side
from postlab.session import stored

CLASSES = {"relevance": [0, 1], "sentiment": [0, 1, 2]}
#: Blocks of unrounded numbers and the rounded ones that chi-square sees in their place, since it takes values as categories.
BINNED = {"dict": "dictbins", "spell": "spellbins"}


@dataclass(frozen=True)
class Chosen:
    """The features of one training side: (bucket, idf) of the terms and the places of the dense scores, both ascending."""

    terms: tuple[tuple[int, float], ...]
    dense: tuple[int, ...]


def plan_cells(data: DataFrame, base: tuple[str, ...], width: int, keys: list[str]) -> DataFrame:
    """(keys, feature, value): hashed stems, then the dense blocks of ``base`` one after the other, rounded; ``keys`` name one row."""
    dense = [vector_to_array(BINNED[b]) for b in base if b != "tfidf"]
    cells = foldstats.dense_cells(data, keys, F.concat(*dense), width) if dense else None
    if "tfidf" not in base:
        return cells
    hashed = foldstats.row_bucket_counts(data, keys, width)
    return hashed.unionByName(cells) if dense else hashed


class FoldFeatures:
    """Selections for every training side of ``data`` and every task, out of one cube of counts.

    ``parts`` are the sides; ``marks`` the columns of ``data`` that their conditions read. The driver gets at most ``top``
    features a side, never more than there are buckets and dense scores.
    """

    def __init__(self, data: DataFrame, base: tuple[str, ...], width: int, parts: list[Side], marks: list[str],
                 tasks: tuple[str, ...]):
        self.parts, self.width, self.data = parts, width, data
        rows = data.withColumn("_row", F.monotonically_increasing_id())  # identifiers need not be unique, or be there
        cells = plan_cells(rows, base, width, ["_row", *marks, *tasks])
        self.cube = stored(foldstats.cube(cells, marks, list(tasks)), "cube")
        self._chosen: dict[tuple[str, int | None], dict[int, Chosen]] = {}

    def ranked(self, task: str) -> DataFrame:
        """(side, feature, statistic, dof, log_p, idf, rank)."""
        sizes = foldstats.side_rows(self.data, self.parts, task, CLASSES[task])
        return foldstats.ranked_features(self.cube, self.parts, task, CLASSES[task], sizes, self.width)

    def frequencies(self) -> DataFrame:
        """(side, feature, df, idf) of the terms."""
        sizes = foldstats.side_rows(self.data, self.parts, next(iter(CLASSES)), CLASSES[next(iter(CLASSES))])
        return foldstats.idf_sides(self.cube.where(F.col("feature") < self.width), self.parts, sizes)

    def chosen(self, task: str, top: int | None) -> dict[int, Chosen]:
        """The best ``top`` features of each side, or all of them."""
        if (task, top) not in self._chosen:
            ranked = self.ranked(task)
            best = ranked.where(F.col("rank") <= top) if top else ranked
            rows = best.select("side", "feature", "idf").orderBy("side", "feature").collect()
            self._chosen[task, top] = {
                s.number: Chosen(
                    tuple((r.feature, r.idf) for r in rows if r.side == s.number and r.feature < self.width),
                    tuple(r.feature - self.width for r in rows if r.side == s.number and r.feature >= self.width))
                for s in self.parts}
        return self._chosen[task, top]


def bucket_stage(width: int) -> Transformer:
    """Adds ``_buckets``: the bucket of every stem, as text."""
    return SQLTransformer(statement=(
        "SELECT *, transform(stems, s -> cast(cast(conv(substring(md5(s), 1, 8), 16, 10) as bigint) "
        f"% {width} as string)) AS _buckets FROM __THIS__"))


def chosen_stages(chosen: Chosen, width: int, dense_col: str | None, counts_col: str | None = None) -> tuple[list[Transformer], list[str]]:
    """Stages that need no fit, and the columns they give: weights of the chosen terms, chosen entries of ``dense_col``.

    The terms come from ``counts_col``, if the rows have their bucket counts, else from the stems.
    """
    stages: list[Transformer] = []
    columns: list[str] = []
    if chosen.terms:
        buckets = [b for b, _ in chosen.terms]
        stages += [VectorSlicer(inputCol=counts_col, outputCol="_tf", indices=buckets)] if counts_col else [
            bucket_stage(width), CountVectorizerModel.from_vocabulary([str(b) for b in buckets], inputCol="_buckets", outputCol="_tf")]
        stages += [
            ElementwiseProduct(scalingVec=Vectors.dense([w for _, w in chosen.terms]), inputCol="_tf", outputCol="_tfidf"),
        ]
        columns.append("_tfidf")
    if chosen.dense and dense_col:
        stages.append(VectorSlicer(inputCol=dense_col, outputCol="_picked", indices=list(chosen.dense)))
        columns.append("_picked")
    return stages, columns
