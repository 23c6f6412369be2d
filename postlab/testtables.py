"""How the given tables feed the analyses: corpus, labels, word vectors, lexicon, dictionary, centers.

The files an analysis normally reads (a scored corpus, a word-vector file, lexicons, a spelling
dictionary) are derived from the tables by Spark jobs. Word-level resources stand for files and are
written once per session through the checkpoint folder.
"""

from __future__ import annotations

from functools import cached_property, partial

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlab.functions.labels import SENTIMENT_NAMES, hash_fold
from postlab.functions.normalize import normalize_tokens
from postlab.functions.stem import stem_german
from postlab.functions.vectors import as_double
from postlab.operators import subwords, terms
from postlab.operators.evaluation import center_table
from postlab.operators.lexicon import number_entries
from postlab.operators.parts import Dealt, deal
from postlab.plans.catalog import PLANS
from postlab.plans.features import document_features, fit_clusters
from postlab.session import stored, stored_in_turn
from postlab.sources.readers import read_table, spread

# ---- fixed values: settings of the derived inputs ---------------------------------------------------
DIM = 64
N_CENTERS = 10
N_CLUSTERS = 100
LEXICON_RANKS = 50
DICTIONARY_MIN_DF = 5
SPLIT_PARTS, SPLIT_SEED = 5, 7
SCORE_CHARACTERS = [" ", "\n", ".", ",", "!", "?", "-"]
SCORE_CLASSES = ["[0-9]", "[A-Z]"]
N_SCORES = 1 + len(SCORE_CHARACTERS) + len(SCORE_CLASSES)
# ---- end of fixed values -----------------------------------------------------------------------------


def dense_scores(text: Column) -> Column:
    """Character counts of a text as ``array<double>``, the stand-in for dictionary scores."""
    def left_over(reduced: Column) -> Column:  # in bytes, which Spark knows without counting: each of these characters is one
        return (F.octet_length(text) - F.octet_length(reduced)).cast("double")

    return F.array(
        F.length(text).cast("double"),
        *[left_over(F.replace(text, F.lit(c), F.lit(""))) for c in SCORE_CHARACTERS],
        *[left_over(F.regexp_replace(text, p, "")) for p in SCORE_CLASSES],
    )


def vector_line(vector: str | Column) -> Column:
    """All values of a vector, in millionths, as one text."""
    return F.array_join(F.transform(vector, lambda v: F.round(v * 1e6).cast("bigint").cast("string")), " ")


def sentiment_of(toxic: Column, quality: Column) -> Column:
    return F.when(toxic == 1, 0).when(quality == 0, 1).otherwise(2)


def in_dev(doc_id: Column) -> Column:
    """Labelled documents are split by key hash into train and dev."""
    return hash_fold(doc_id, SPLIT_PARTS, SPLIT_SEED) == 0


def sentiment_text(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in SENTIMENT_NAMES]), code + 1)


class Tables:
    """The given tables of one folder and what is derived from them."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.directory, name)

    @property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @property
    def texts(self) -> DataFrame:
        """(doc_id, text), spread over the cores."""
        return spread(self.documents.select("doc_id", "text"), "doc_id")

    @property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings").select(
            "vec_id", as_double(F.col("embedding")).alias("vector"), "label"
        )

    @property
    def tokens(self) -> DataFrame:
        """(doc_id, tokens) of every document."""
        return self.texts.select("doc_id", normalize_tokens(F.col("text")).alias("tokens"))

    @cached_property
    def dealt_tokens(self) -> Dealt:
        """(doc_id, tokens, scores) of every document, written once by part: what the feature table starts from."""
        text = F.col("text")
        tight = text
        for blank in " \t\r\n":
            tight = F.replace(tight, F.lit(blank), F.lit(""))
        blanks = F.octet_length(text) - F.octet_length(tight) + 1  # about as many as its tokens
        n_tokens = self.documents.agg(F.sum(blanks).alias("n")).first()["n"] or 0
        return deal(self.texts.select(
            "doc_id", normalize_tokens(text).alias("tokens"), dense_scores(text).alias("scores"),
        ), ["doc_id"], n_tokens)

    @property
    def scored_tokens(self) -> DataFrame:
        """``dealt_tokens`` as rows."""
        return self.dealt_tokens.docs

    @cached_property
    def stored_tokens(self) -> DataFrame:
        """``tokens``, written once: the rules run once for the vocabulary, the dictionary and the lookups together."""
        if "dealt_tokens" in self.__dict__:
            return self.scored_tokens.select("doc_id", "tokens")
        return stored(self.tokens)

    @property
    def counted_tokens(self) -> DataFrame | Dealt:
        """What the vocabulary is counted from."""
        return self.dealt_tokens if "dealt_tokens" in self.__dict__ else self.stored_tokens

    @property
    def labels(self) -> DataFrame:
        """(doc_id, relevance, sentiment)."""
        return self.table("labels").select(
            "doc_id", F.col("quality").alias("relevance"),
            sentiment_of(F.col("toxic"), F.col("quality")).alias("sentiment"),
        )

    @property
    def corpus(self) -> DataFrame:
        """Every document with its labels (null in the test split) and its split."""
        split = (
            F.when(F.col("relevance").isNull(), "test")
            .when(in_dev(F.col("doc_id")), "dev").otherwise("train")
        )
        return (
            self.texts.join(self.labels, "doc_id", "left").withColumn("split", split)
        )

    @property
    def labelled_tokens(self) -> DataFrame:
        """(doc_id, tokens, relevance, sentiment) of the labelled documents."""
        return self.texts.join(self.labels, "doc_id").select(
            "doc_id", normalize_tokens(F.col("text")).alias("tokens"), "relevance", "sentiment"
        )

    @cached_property
    def ranked_words(self) -> DataFrame:
        """(word, n, rank) over the whole vocabulary, written once."""
        return stored(terms.ranked_vocabulary(self.counted_tokens))

    @cached_property
    def word_vectors(self) -> DataFrame:
        """(word, n, id, vector): the vector with id r - 1 belongs to the word of rank r."""
        return stored(
            self.ranked_words.withColumn("id", F.col("rank") - 1)
            .join(self.embeddings.withColumnRenamed("vec_id", "id"), "id")
            .select("word", "n", "id", "vector", "label")
        )

    @cached_property
    def vector_lines(self) -> DataFrame:
        """(word, vector) with every vector as a line, written once per word."""
        return stored(self.word_vectors.select("word", vector_line("vector").alias("vector")))

    @cached_property
    def bucket_vectors(self) -> DataFrame:
        """(bucket, vector) of the n-grams of the words with a vector."""
        return stored(subwords.bucket_vectors(self.word_vectors, DIM))

    @property
    def words(self) -> DataFrame:
        """(word, n): the vocabulary."""
        return self.ranked_words.select("word", "n")

    @property
    def lexicon(self) -> DataFrame:
        """(word, polarity, idx): ranks 1 to LEXICON_RANKS, odd ones positive, even ones negative."""
        odd = F.col("rank") % 2 == 1
        return self.ranked_words.where(F.col("rank") <= LEXICON_RANKS).select(
            "word", F.when(odd, "positive").otherwise("negative").alias("polarity"),
            F.floor((F.col("rank") - 1) / 2).cast("int").alias("idx"),
        )

    @cached_property
    def dictionary(self) -> DataFrame:
        """(word, n): words of at least DICTIONARY_MIN_DF documents, with that number, written once."""
        return stored(
            terms.document_frequency(self.counted_tokens, term="word")
            .where(F.col("df") >= DICTIONARY_MIN_DF).select("word", F.col("df").alias("n"))
        )

    @cached_property
    def clusters(self) -> KMeansModel:
        """K-means on the embeddings."""
        return fit_clusters(self.embeddings, k=N_CLUSTERS)

    @cached_property
    def features(self) -> DataFrame:
        """The feature table of every document with its labels (null if unlabelled), written once.

        Of the tokens those of the lexicon stay: models only ask which of its entries are present.
        """
        dealt = self.dealt_tokens  # first: the other tables start from its tokens
        given = {"vectors": self.word_vectors, "lexicon": self.lexicon, "dictionary": self.dictionary, "words": self.words,
                 "clusters": self.clusters, "labels": self.labels}
        widths = tuple(sorted({p.tf_width for p in PLANS.values() if "tfidf" in p.base}))

        def made(docs: Dealt) -> DataFrame:
            return document_features(docs, "doc_id", dim=DIM, stemmer=stem_german, widths=widths, kept=self.lexicon_words, **given)

        return stored_in_turn([partial(made, docs) for docs in dealt.rounds()])

    @property
    def labelled_features(self) -> DataFrame:
        return self.features.where(F.col("relevance").isNotNull())

    @property
    def labelled_splits(self) -> tuple[DataFrame, DataFrame]:
        """The labelled feature rows of the train and the dev split."""
        dev = in_dev(F.col("doc_id"))
        return self.labelled_features.where(~dev), self.labelled_features.where(dev)

    @cached_property
    def lexicon_words(self) -> list[str]:
        """Lexicon entries in slot order; a list of LEXICON_RANKS entries."""
        numbered = number_entries(self.lexicon).orderBy("idx")
        return [row["word"] for row in numbered.select("word").collect()]

    @property
    def centers(self) -> Column:
        return center_table(self.embeddings, "label", "vector", DIM)


_OPEN: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, directory: str) -> Tables:
    """The tables of a folder; derived resources are shared by all queries of one session."""
    key = (spark.sparkContext.applicationId, directory)
    if key not in _OPEN:
        _OPEN[key] = Tables(spark, directory)
    return _OPEN[key]
