"""Readers. Schemas are declared, nothing is inferred; parsing is column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlab.functions.labels import sentiment_code
from postlab.functions.normalize import normalize_tokens, raw_tokens, strip_punct_tokens
from postlab.operators.position import with_position

# ---- fixed values: file layouts -------------------------------------------------------------------
SCORE_OFFSET = 5
REVIEW_FIELDS = (3, 4)
PRODUCT_REVIEW = T.StructType([
    T.StructField("reviewID", T.StringType()),
    T.StructField("asin", T.StringType()),
    T.StructField("reviewerName", T.StringType()),
    T.StructField("helpful", T.ArrayType(T.IntegerType())),
    T.StructField("reviewText", T.StringType()),
    T.StructField("overall", T.IntegerType()),
    T.StructField("summary", T.StringType()),
    T.StructField("unixReviewTime", T.LongType()),
    T.StructField("reviewTime", T.StringType()),
])
# ---- end of fixed values --------------------------------------------------------------------------


def decimal_comma(cell: Column) -> Column:
    """A number written with a decimal comma; null if the cell is no number."""
    return F.replace(cell, F.lit(","), F.lit(".")).try_cast("double")


def parse_corpus(lines: DataFrame, line: str = "line", n_scores: int | None = None,
                 score_offset: int = SCORE_OFFSET, tolerant: bool = False,
                 raw: bool = False) -> DataFrame:
    """Corpus rows from tab-separated lines: id, text, relevance, sentiment, one unread cell, scores.

    With ``n_scores`` only rows with exactly that many scores are kept. ``tolerant`` skips cells that
    are no number instead of keeping them as null. ``raw`` gives uncleaned blank-split tokens.
    """
    cells = F.col("_cells")
    parsed = lines.withColumn("_cells", F.split(F.col(line), "\t", -1))
    scores = F.transform(
        F.slice(cells, score_offset + 1, F.greatest(F.size(cells) - score_offset, F.lit(0))),
        decimal_comma,
    )
    if tolerant:
        scores = F.filter(scores, lambda s: s.isNotNull())
    rows = parsed.select(
        F.get(cells, F.lit(0)).alias("id"),
        F.get(cells, F.lit(1)).alias("text"),
        (F.get(cells, F.lit(2)) == "true").alias("relevant"),
        sentiment_code(F.get(cells, F.lit(3))).alias("sentiment"),
        scores.alias("scores"),
    )
    if n_scores is not None:
        rows = rows.where(F.size("scores") == n_scores)
    tokens = raw_tokens(F.col("text")) if raw else normalize_tokens(F.col("text"))
    return rows.withColumn("tokens", tokens)


def read_corpus(spark: SparkSession, path: str, n_scores: int | None = None, **options) -> DataFrame:
    """Labelled or unlabelled corpus files with a header line that starts with the first column name.

    The files are read as text lines, so a quote in a post never swallows the following lines; the CSV
    reader drops one header per file, and its separator is a character no text holds.
    """
    lines = (
        spark.read.schema("line string")
        .csv(path, sep="\x01", header=True, quote="", escape="", enforceSchema=True,
             ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .where(F.col("line").isNotNull())
    )
    return parse_corpus(lines, "line", n_scores, **options)


def parse_word_vectors(lines: DataFrame, line: str, dim: int) -> DataFrame:
    """``word v1 ... vN`` lines; lines of another dimension (such as a ``count dim`` header) go."""
    cells = F.split(F.rtrim(F.col(line)), " ", -1)
    return (
        lines.select(
            F.get(cells, F.lit(0)).alias("word"),
            F.transform(F.slice(cells, 2, 1 << 30), lambda v: v.try_cast("double")).alias("vector"),
        )
        .where(F.size("vector") == dim)
    )


def read_word_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    return parse_word_vectors(spark.read.text(path), "value", dim)


def read_lexicon(spark: SparkSession, positive: str, negative: str) -> DataFrame:
    """(word, polarity, idx) from two files of ``entry <tab> ...`` lines; ``idx`` is the line number from 0.

    A lexicon is one short file per polarity, read as a whole, so the lines keep their order. Negative entries
    are numbered on after the positive ones by the feature builder, not here.
    """
    def one(path: str, polarity: str) -> DataFrame:
        whole = F.regexp_replace("value", r"(\r\n|[\r\n])$", "")
        lines = spark.read.text(path, wholetext=True).where(F.length("value") > 0)
        return lines.select(F.posexplode(F.split(whole, r"\r\n|[\r\n]")).alias("idx", "line")).select(
            F.get(F.split("line", "\t"), F.lit(0)).alias("word"), F.lit(polarity).alias("polarity"), "idx")

    return one(positive, "positive").unionByName(one(negative, "negative"))


def read_review_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of fields 3 and 4 of semicolon-separated review lines."""
    cells = F.split(F.col("value"), ";", -1)
    return spark.read.text(path).select(
        strip_punct_tokens(*[F.get(cells, F.lit(i)) for i in REVIEW_FIELDS]).alias("words")
    )


def read_product_reviews(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRODUCT_REVIEW).json(path)


def read_dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc, pos, line) of text files; ``pos`` counts the lines of each file from 0.

    A file's splits are ordered by the byte at which they begin, and inside a split the row id grows with the lines,
    however Spark deals splits out to tasks.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    placed = with_position(lines, [F.col("_block"), F.col("_id")], ["doc"], name="pos")
    return placed.select("doc", (F.col("pos") - 1).alias("pos"), "line")


def read_dump_splits(spark: SparkSession, path: str) -> DataFrame:
    """(doc, split, row, line) of text files as they are scanned: splits in the order of ``split`` make up a file, and
    ``row`` grows with the lines of a split."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))


#: A session that sets this to true spreads its input over its cores: one small file is one partition.
SPREAD_INPUT = "spark.postlab.spreadInput"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The input as it is, or dealt out by ``keys`` if the session asks for it (benches and tests on one file do)."""
    session = df.sparkSession
    if session.conf.get(SPREAD_INPUT, "false") == "true":
        return df.repartition(session.sparkContext.defaultParallelism, *keys)
    return df


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")
