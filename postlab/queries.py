"""The query catalogue over the given tables; each query takes (spark, folder) and returns a frame."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlab.functions import labels as lab
from postlab.functions import normalize as nz
from postlab.functions import vectors as vec
from postlab.functions.stem import stem_english, stem_german
from postlab.operators import evaluation, folds, invertedfile, lexicon, neighbors, sections, stats, subwords, terms
from postlab.operators import wordvectors as wv
from postlab.operators.parts import Matches, fields, in_parts, lists, text_rank
from postlab.session import stored
from postlab.sources import readers, writers
from postlab.testtables import (
    DIM, N_CENTERS, N_SCORES, dense_scores, sentiment_text, tables, vector_line,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# ---- fixed values: query settings --------------------------------------------------------------------
SEED = 1
FOLDS = 5
SAMPLE_ROWS = 200
NEIGHBOURS = 5
MAX_DISTANCE = 1.15
TARGET_LABELS = 5
SEQUENCE_LENGTH = 15
SELECTED_FEATURES = 1000
TOP_TERMS = 20
LINE_BREAK = r"\r\n|[\n\r]"
BLOCK_TAG = "<(/?(article|h1|p|nav|ul|li|div|body))"
DUMP_START, DUMP_END = "<article", "</article"
# ---- end of fixed values -----------------------------------------------------------------------------


def query(function: Query, name: str | None = None) -> Query:
    """Register a query under its own name, or under ``name``."""
    QUERIES[name or function.__name__] = function
    return function


def r6(value: Column) -> Column:
    return F.round(value, 6) + F.lit(0.0)


# ---- sources -------------------------------------------------------------------------------------------

@query
def corpus_load(spark, sf):
    """Labelled documents written as corpus lines and read back by the corpus parser."""
    t = tables(spark, sf)
    clean = F.translate(F.col("text"), "\t\n\r", "   ")
    scores = F.transform(
        dense_scores(F.col("text")), lambda s: F.replace((s / 4).cast("string"), F.lit("."), F.lit(","))
    )
    lines = t.texts.join(t.labels, "doc_id").select(F.concat_ws(
        "\t", F.col("doc_id").cast("string"), clean,
        F.when(F.col("relevance") == 1, "true").otherwise("false"),
        sentiment_text(F.col("sentiment")), F.lit("0"), scores,
    ).alias("line"))
    rows = readers.parse_corpus(lines, "line", n_scores=N_SCORES)
    return rows.select(
        F.col("id").cast("bigint").alias("doc_id"), F.col("relevant").cast("int").alias("relevant"),
        "sentiment", F.size("tokens").cast("bigint").alias("n_tokens"),
        F.aggregate("scores", F.lit(0.0), lambda s, x: s + x).alias("score_sum"),
    )


@query
def encode_labels(spark, sf):
    t = tables(spark, sf)
    name = sentiment_text(F.col("sentiment"))
    return t.labels.select(
        "doc_id", lab.relevance_code(F.col("relevance") == 1).alias("relevance"),
        lab.sentiment_code(name).alias("sentiment"),
        lab.sentiment_code(name, base=1).cast("double").alias("sentiment_1based"),
    )


@query
def vectors_load(spark, sf):
    t = tables(spark, sf)
    lines = t.embeddings.select(F.concat_ws(
        " ", F.col("vec_id").cast("string"), F.col("vector").cast("array<string>")
    ).alias("line"))
    parsed = readers.parse_word_vectors(lines, "line", DIM)
    return parsed.select(
        F.col("word").cast("bigint").alias("vec_id"), F.size("vector").cast("bigint").alias("dim"),
        vector_line("vector").alias("vector"),
    )


@query
def review_json_parse(spark, sf):
    """Events written as product reviews in JSON and parsed with the review schema; one field is missing, one is null."""
    e, second = tables(spark, sf).table("events"), F.col("event_id").cast("int")
    review = F.struct(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("reviewID"), F.col("event_type").alias("asin"),
        F.array(second % 7, second % 11).alias("helpful"), F.col("props").alias("reviewText"),
        (second % 5 + 1).alias("overall"), F.when(second % 3 > 0, F.col("event_type")).alias("summary"),
        (F.col("event_id").cast("bigint") * 1000003).alias("unixReviewTime"),
        F.col("user_id").cast("string").alias("reviewTime"))
    parsed = e.select("event_id", F.from_json(F.to_json(review), readers.PRODUCT_REVIEW).alias("review"))
    return parsed.select("event_id", "review.*").withColumn(
        "helpful", F.array_join(F.transform("helpful", lambda h: h.cast("string")), ","))


# ---- text rules ----------------------------------------------------------------------------------------

def _token_rows(df: DataFrame, tokens: Column, separator: str = " ") -> DataFrame:
    return df.select("doc_id", tokens.alias("t")).select(
        "doc_id", F.array_join("t", separator).alias("tokens"), F.size("t").cast("bigint").alias("n")
    )


@query
def normalize_tokens(spark, sf):
    return _token_rows(tables(spark, sf).texts, nz.normalize_tokens(F.col("text")))


@query
def raw_tokens(spark, sf):
    return _token_rows(tables(spark, sf).texts, nz.raw_tokens(F.col("text")))


@query
def strip_punct_tokens(spark, sf):
    return _token_rows(
        tables(spark, sf).documents, nz.strip_punct_tokens(F.col("source"), F.col("text"))
    )


@query
def bigrams(spark, sf):
    return _token_rows(tables(spark, sf).tokens, nz.ngrams(F.col("tokens"), 2), "|")


@query
def concat_token_arrays(spark, sf):
    """Unigrams followed by bigrams."""
    tokens = F.col("tokens")
    return _token_rows(tables(spark, sf).tokens, nz.concat_tokens(tokens, nz.ngrams(tokens, 2)), "|")


@query
def lowercase_text(spark, sf):
    return tables(spark, sf).table("conversations").select(
        "conv_id", "turn", nz.lowercase(F.col("text")).alias("text")
    )


@query
def clean_sentence(spark, sf):
    return tables(spark, sf).table("conversations").select(
        "conv_id", "turn", nz.clean_sentence(F.col("text")).alias("text")
    )


@query
def clean_news_lines(spark, sf):
    lines = tables(spark, sf).texts.select(
        "doc_id", F.posexplode(F.split("text", LINE_BREAK)).alias("pos", "line")
    )
    return lines.withColumn("line", nz.clean_news_line(F.col("line")))


def _dump_lines(spark, sf) -> DataFrame:
    """Page source with one block element per line."""
    broken = F.regexp_replace("html", BLOCK_TAG, "\n<$1")
    return tables(spark, sf).table("pages").select(
        "page_id", F.posexplode(F.split(broken, LINE_BREAK)).alias("pos", "line")
    )


@query
def section_lines(spark, sf):
    """A page is one row of its table, so its lines lie together and in order."""
    return sections.scanned_section_lines(
        _dump_lines(spark, sf), ["page_id"], start=DUMP_START, end=DUMP_END
    )


@query
def section_lines_any_order(spark, sf):
    """The same by positions, for lines that lie anywhere."""
    return sections.section_lines(
        _dump_lines(spark, sf), ["page_id"], start=DUMP_START, end=DUMP_END
    )


@query
def clean_markup_lines(spark, sf):
    inside = sections.scanned_section_lines(
        _dump_lines(spark, sf), ["page_id"], start=DUMP_START, end=DUMP_END
    )
    return sections.clean_lines(inside)


# ---- terms and stems -----------------------------------------------------------------------------------

@query
def term_counts(spark, sf):
    return terms.term_counts(tables(spark, sf).tokens, ["doc_id"])


@query
def idf_terms(spark, sf):
    t = tables(spark, sf)
    weights = terms.idf(terms.document_frequency(t.tokens), terms.row_count(t.documents))
    return weights.select("term", "df", r6(F.col("idf")).alias("idf"))


@query
def tfidf_terms(spark, sf):
    t = tables(spark, sf)
    weighted = terms.tfidf(t.stored_tokens, ["doc_id"], terms.row_count(t.documents))
    return weighted.select("doc_id", "term", "tf", r6(F.col("tfidf")).alias("tfidf"))


@query
def top_terms_by_class(spark, sf):
    """Per relevance class the terms with the largest TF-IDF sum over the labelled documents."""
    t = tables(spark, sf)
    n_labelled = terms.row_count(t.documents.select("doc_id").join(t.labels, "doc_id"))
    weighted = terms.tfidf(stored(t.labelled_tokens, "labelled-tokens"), ["doc_id", "relevance"], n_labelled)
    sums = weighted.groupBy("relevance", "term").agg(r6(F.sum("tfidf")).alias("weight"))
    best = Window.partitionBy("relevance").orderBy(F.desc("weight"), F.asc("term"))
    return (
        sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP_TERMS)
        .select("relevance", "rank", "term", "weight")
    )


def _term_chi2(t) -> DataFrame:
    docs = t.labelled_tokens
    values = terms.term_counts(docs, ["doc_id", "relevance"])
    sizes = terms.class_sizes(t.labels, "relevance", [0, 1])
    return terms.chi_square(values, "term", "tf", "relevance", [0, 1], sizes)


@query
def chi2_terms(spark, sf):
    found = _term_chi2(tables(spark, sf))
    return found.select("term", r6(F.col("statistic")).alias("statistic"), "dof")


@query
def selected_dense_features(spark, sf):
    """How many, and which (1-based), dense scores are among the best features by chi-square."""
    t = tables(spark, sf)
    scores = t.documents.select("doc_id", dense_scores(F.col("text")).alias("s")).join(t.labels, "doc_id")
    cells = scores.select("relevance", F.posexplode("s").alias("dim", "value")).where(F.col("value") != 0)
    sizes = terms.class_sizes(t.labels, "relevance", [0, 1])
    dense = terms.chi_square(cells, "dim", "value", "relevance", [0, 1], sizes).select(
        F.lit(1).alias("dense"), F.lpad(F.col("dim").cast("string"), 4, "0").alias("name"), "dim", "statistic"
    )
    words = _term_chi2(t).select(
        F.lit(0).alias("dense"), F.col("term").alias("name"), F.lit(-1).alias("dim"), "statistic"
    )
    best = (
        dense.unionByName(words).withColumn("statistic", r6(F.col("statistic")))
        .orderBy(F.desc("statistic"), F.desc("dense"), F.asc("name")).limit(SELECTED_FEATURES)
    )
    picked = F.when(F.col("dense") == 1, F.col("dim") + 1)
    return best.agg(
        F.count(picked).alias("n_selected"),
        F.array_join(F.transform(F.array_sort(F.collect_list(picked)), lambda i: i.cast("string")), " ")
        .alias("selected"),
    )


@partial(query, name="stem_german")
def stem_german_tokens(spark, sf):
    t = tables(spark, sf)
    stems = terms.stem_tokens(t.stored_tokens, ["doc_id"], stem_german, t.words)
    return stems.select("doc_id", F.array_join("stems", " ").alias("stems"))


@partial(query, name="stem_english")
def stem_english_tokens(spark, sf):
    t = tables(spark, sf)
    stems = terms.stem_tokens(t.stored_tokens, ["doc_id"], stem_english, t.words)
    return stems.select("doc_id", F.array_join("stems", " ").alias("stems"))


@query
def stem_groups(spark, sf):
    return terms.stem_groups(terms.vocabulary(tables(spark, sf).tokens), stem_german)


# ---- corpus statistics, folds, samples -------------------------------------------------------------------

@query
def relative_length(spark, sf):
    rows = stats.relative_length(tables(spark, sf).tokens, ["doc_id"])
    return rows.withColumn("relative_length", r6(F.col("relative_length")))


@query
def corpus_stats(spark, sf):
    return stats.corpus_stats(tables(spark, sf).corpus).select(
        "split", "relevance", "sentiment", "n",
        r6(F.col("mean_words")).alias("mean_words"), r6(F.col("sd_words")).alias("sd_words"),
    )


@query
def word_counts_by_class_wide(spark, sf):
    t = tables(spark, sf)
    docs = t.texts.join(t.labels, "doc_id").select(
        "doc_id", "text", sentiment_text(F.col("sentiment")).alias("class")
    )
    return stats.word_counts_wide(docs, "class", lab.SENTIMENT_NAMES, "doc_id")


@query
def contiguous_folds(spark, sf):
    return folds.contiguous_folds(
        tables(spark, sf).table("labels").select("doc_id"), [F.col("doc_id")], FOLDS
    )


@query
def kfold_assign(spark, sf):
    return folds.keyed_folds(tables(spark, sf).table("labels").select("doc_id"), "doc_id", FOLDS, SEED)


@query
def hash_sample(spark, sf):
    return folds.hash_sample(tables(spark, sf).documents.select("doc_id"), "doc_id", SAMPLE_ROWS, SEED)


@query
def seeded_shuffle(spark, sf):
    return folds.seeded_shuffle(tables(spark, sf).documents.select("doc_id"), "doc_id", SEED)


@query
def union_splits(spark, sf):
    t = tables(spark, sf)
    parts = t.corpus.select(F.col("split").alias("origin"), "text").unionByName(
        t.table("benchmark").select(F.lit("benchmark").alias("origin"), "text")
    )
    return parts.groupBy("origin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars")
    )


# ---- word vectors ------------------------------------------------------------------------------------------

@query
def token_vectors(spark, sf):
    t = tables(spark, sf)
    return wv.token_vectors(t.stored_tokens, t.vector_lines, ["doc_id"], words=t.words)


@query
def token_vectors_with_default(spark, sf):
    t = tables(spark, sf)
    none = vector_line(F.array_repeat(F.lit(0.0), DIM))
    return wv.token_vectors_with_default(t.stored_tokens, t.vector_lines, ["doc_id"], DIM, words=t.words, default=none)


@query
def subword_vectors(spark, sf):
    """A vector for every word of the vocabulary: unknown ones are composed of the n-grams of the known ones."""
    t = tables(spark, sf)
    found = subwords.vocabulary_vectors(t.words, t.word_vectors, t.bucket_vectors, DIM)
    return found.select("word", "known", vector_line("vector").alias("vector"))


@query
def token_vectors_composed(spark, sf):
    """As ``token_vectors_with_default``, with composed vectors in place of zeros; the mean of each document."""
    t = tables(spark, sf)
    found = subwords.token_vectors_composed(t.stored_tokens, t.word_vectors, t.bucket_vectors, ["doc_id"], DIM, t.words)
    means = found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tokens"), *[F.avg(F.col("vector")[i]).alias(f"_{i}") for i in range(DIM)])
    return means.select("doc_id", "n_tokens", vector_line(F.array(*[F.col(f"_{i}") for i in range(DIM)])).alias("vector"))


@query
def word_vector_lookup(spark, sf):
    """Every distinct word form of the raw texts, looked up in lower case."""
    t = tables(spark, sf)
    words = t.texts.select(F.explode(F.split("text", "[^A-Za-z]+")).alias("word")).where(
        F.col("word") != "").distinct()
    return wv.word_vector(words, t.word_vectors).select(
        "word", F.size("vector").cast("bigint").alias("dim"), vector_line("vector").alias("vector")
    )


@query
def prune_empty(spark, sf):
    t = tables(spark, sf)
    return wv.known_tokens(t.stored_tokens, t.word_vectors, ["doc_id"], words=t.words)


@query
def sentence_vectors(spark, sf):
    t = tables(spark, sf)
    means = wv.mean_vectors(t.stored_tokens, t.word_vectors, ["doc_id"], DIM, words=t.words)
    return wv.long_form(means, ["doc_id"], "mean_vector").withColumn("value", r6(F.col("value")))


@query
def sequence_vectors(spark, sf):
    t = tables(spark, sf)
    padded = wv.padded_sequences(t.stored_tokens, t.word_vectors, ["doc_id"], SEQUENCE_LENGTH, DIM, words=t.words)
    return wv.long_form(padded, ["doc_id"], "sequence").withColumn("value", r6(F.col("value")))


@query
def vector_math(spark, sf):
    """Sum, difference and distance of each vector and the one with the next id."""
    e = tables(spark, sf).embeddings
    a = e.select(F.col("vec_id").alias("a"), F.col("vector").alias("va"))
    b = e.select(F.col("vec_id").alias("b"), F.col("vector").alias("vb"))
    return a.join(b, F.col("a") + 1 == F.col("b")).select(
        "a", "b", vector_line(vec.add(F.col("va"), F.col("vb"))).alias("sum"),
        vector_line(vec.subtract(F.col("va"), F.col("vb"))).alias("difference"),
        r6(vec.distance(F.col("va"), F.col("vb"))).alias("distance"),
    )


@query
def embedding_as_double(spark, sf):
    return wv.long_form(tables(spark, sf).embeddings, ["vec_id"], "vector").withColumn(
        "value", r6(F.col("value"))
    )


@query
def knn_exact(spark, sf):
    points = tables(spark, sf).embeddings.select(F.col("vec_id").alias("id"), "vector")
    return neighbors.nearest(points, points, NEIGHBOURS).select(
        F.col("id").alias("vec_id"), "neighbour", F.col("rank").cast("int").alias("rank"),
        r6(F.col("distance")).alias("distance"),
    )


@query
def knn_lsh(spark, sf):
    """The same by an inverted file; how many of its cells are looked at is measured."""
    points = tables(spark, sf).embeddings.select(F.col("vec_id").alias("id"), "vector")
    return invertedfile.nearest_approximate(points, points, NEIGHBOURS).select(
        F.col("id").alias("vec_id"), "neighbour", F.col("rank").cast("int").alias("rank"),
        r6(F.col("distance")).alias("distance"),
    )


@query
def knn_work(spark, sf):
    """Cells, probes and the share of all pairs that ``knn_lsh`` looks at."""
    points = tables(spark, sf).embeddings.select(F.col("vec_id").alias("id"), "vector")
    return invertedfile.search_work(points, points, NEIGHBOURS)


@query
def closest_within(spark, sf):
    """For each vector the closest one of the first labels within reach, if there is one."""
    points = tables(spark, sf).embeddings.withColumnRenamed("vec_id", "id")
    found = neighbors.closest_by_criterion(points, points, F.col("label") < TARGET_LABELS, MAX_DISTANCE)
    return found.select(
        F.col("id").alias("vec_id"), "neighbour", r6(F.col("distance")).alias("distance")
    )


@query
def substitute_words(spark, sf):
    """Tokens replaced by the closest word whose vector has one of the first labels, within reach."""
    t = tables(spark, sf)
    vocabulary = t.word_vectors
    found = neighbors.substitutions(vocabulary, vocabulary.where(F.col("label") < TARGET_LABELS), MAX_DISTANCE)
    replaced = lookup_substitutes(t.stored_tokens, found, t.words)
    return replaced.select(
        "doc_id", F.array_join("tokens", " ").alias("tokens"), "n_replaced"
    )


def lookup_substitutes(docs: DataFrame, found: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, tokens, n_replaced): every token with a substitute replaced by it."""
    def replaced(tokens: Matches) -> pa.Table:
        substitute = tokens.value("substitute")
        value = pc.coalesce(substitute, tokens.word)
        changed = pc.not_equal(value, tokens.word).to_numpy(zero_copy_only=False)
        n = np.where(tokens.null_key, 0, tokens.sums(changed).astype("int64")[tokens.group])
        return pa.table({**tokens.keys_of(np.arange(len(tokens.docs))), "n_replaced": n,
                         "tokens": lists(tokens, tokens.in_order(lambda: text_rank(value)), value)}).select(["doc_id", "tokens", "n_replaced"])

    schema = f"{fields(docs, ['doc_id'])}, tokens array<string>, n_replaced bigint"
    return in_parts(docs, ["doc_id"], [found.select("word", "substitute")], replaced, schema, words=words)


def _assigned(t) -> DataFrame:
    return evaluation.assign_centers(t.embeddings, "vector", t.centers)


@query
def nearest_center(spark, sf):
    return _assigned(tables(spark, sf)).select("vec_id", "center", r6(F.col("distance")).alias("distance"))


@query
def cluster_one_hot(spark, sf):
    assigned = _assigned(tables(spark, sf)).select(
        "vec_id", vec.one_hot(F.col("center"), N_CENTERS).alias("hot")
    )
    return wv.long_form(assigned, ["vec_id"], "hot").withColumnRenamed("dim", "idx")


@query
def wssse_fixed_centers(spark, sf):
    return evaluation.within_cost(_assigned(tables(spark, sf))).select(r6(F.col("wssse")).alias("wssse"))


# ---- lexicon, spelling, assembly -------------------------------------------------------------------------

@query
def lexicon_hits(spark, sf):
    t = tables(spark, sf)
    return lexicon.lexicon_hits(t.stored_tokens, t.lexicon, ["doc_id"], words=t.words).select("doc_id", "word", "polarity", "idx")


@query
def lexicon_counts(spark, sf):
    t = tables(spark, sf)
    return lexicon.lexicon_counts(t.stored_tokens, t.lexicon, ["doc_id"], words=t.words)


@query
def lexicon_vector(spark, sf):
    t = tables(spark, sf)
    vectors = lexicon.lexicon_vectors(t.stored_tokens, t.lexicon, ["doc_id"], words=t.words)
    return vectors.select("doc_id", F.explode("lexicon").alias("idx", "value"))


@query
def misspelling_ratio(spark, sf):
    t = tables(spark, sf)
    return lexicon.misspelling_ratio(t.stored_tokens, t.dictionary, ["doc_id"], words=t.words).withColumn("ratio", r6(F.col("ratio")))


@query
def assemble_features(spark, sf):
    """Mean vector, dense scores and lexicon counts end to end."""
    t = tables(spark, sf)
    means = wv.mean_vectors(t.stored_tokens, t.word_vectors, ["doc_id"], DIM, words=t.words)
    counts = lexicon.lexicon_counts(t.stored_tokens, t.lexicon, ["doc_id"], words=t.words)
    scores = t.documents.select("doc_id", dense_scores(F.col("text")).alias("scores"))
    joined = means.join(scores, "doc_id").join(counts, "doc_id").select("doc_id", F.concat(
        "mean_vector", "scores", F.array(F.col("positive").cast("double"), F.col("negative").cast("double"))
    ).alias("features"))
    return wv.long_form(joined, ["doc_id"], "features").withColumn("value", r6(F.col("value")))


@query
def feature_matrix_lines(spark, sf):
    t = tables(spark, sf)
    return t.texts.join(t.labels, "doc_id").select(
        "doc_id", writers.feature_line(dense_scores(F.col("text")), F.col("sentiment")).alias("line")
    )


# ---- votes, predictions, submission ------------------------------------------------------------------------

def _votes(docs: DataFrame) -> DataFrame:
    """Three rule-based votes per document."""
    s = dense_scores(F.col("text"))
    return docs.withColumn("_s", s).select(
        *docs.columns,
        F.array(
            F.when(F.col("_s")[0] >= 2000, 1.5).otherwise(0.4),
            F.when(F.col("_s")[8] >= 5, 1.0).otherwise(0.0),
            F.when(F.col("_s")[2] >= 5, 2.0).otherwise(1.0),
        ).alias("votes"),
    )


@query
def majority_vote(spark, sf):
    return _votes(tables(spark, sf).texts).select(
        "doc_id", vec.majority(F.col("votes")).alias("prediction")
    )


@query
def soft_vote(spark, sf):
    """Ten class distributions per document, added up."""
    def member(i: int) -> Column:
        n = F.col("n_chars")
        return F.array((n * (i + 1)) % 7, (n * (i + 2)) % 5, (n + i) % 6).cast("array<double>")

    return tables(spark, sf).documents.select(
        "doc_id", vec.soft_vote(*[member(i) for i in range(10)]).alias("prediction")
    )


@query
def join_predictions(spark, sf):
    """Predictions made elsewhere attached to the labels by key."""
    t = tables(spark, sf)
    predictions = _votes(t.texts).select(
        "doc_id", vec.majority(F.col("votes")).alias("prediction")
    )
    return t.labels.select("doc_id", "sentiment").join(predictions, "doc_id")


@query
def submission_rows(spark, sf):
    """Both submissions for the unlabelled documents."""
    t = tables(spark, sf)
    unlabelled = t.texts.join(t.labels, "doc_id", "left_anti")
    voted = _votes(unlabelled)
    by_task = {
        "sentiment": voted.withColumn("prediction", vec.majority(F.col("votes")).cast("double")),
        "relevance": voted.withColumn("prediction", F.col("votes")[1]),
    }
    first, second = [
        writers.submission(df, task, id_col="doc_id").withColumn("task", F.lit(task))
        for task, df in by_task.items()
    ]
    return first.unionByName(second)


@query
def bare_text(spark, sf):
    """Every text of all three collections as one line of tokens."""
    t = tables(spark, sf)
    line = writers.bare_line(nz.normalize_tokens(F.col("text"))).alias("line")
    docs = t.documents.select(F.lit("documents").alias("origin"), F.col("doc_id").cast("string").alias("key"), line)
    turns = readers.spread(t.table("conversations"), "conv_id", "turn").select(
        F.lit("conversations").alias("origin"), F.concat_ws("-", "conv_id", "turn").alias("key"), line
    )
    items = t.table("benchmark").select(
        F.lit("benchmark").alias("origin"), F.col("item_id").cast("string").alias("key"), line
    )
    return docs.unionByName(turns).unionByName(items)


@query
def labelled_lines(spark, sf):
    docs = tables(spark, sf).labelled_tokens
    return docs.select("doc_id", writers.labelled_line(F.col("tokens"), F.col("sentiment")).alias("line"))


# ---- evaluation --------------------------------------------------------------------------------------------

@query
def confusion_matrix(spark, sf):
    return evaluation.confusion_matrix(_assigned(tables(spark, sf)), "label", "center", N_CENTERS)


@query
def weighted_f1(spark, sf):
    return evaluation.weighted_f1(_assigned(tables(spark, sf)), "label", "center").select(
        r6(F.col("f1")).alias("f1")
    )


@query
def micro_f1(spark, sf):
    return evaluation.micro_f1(_assigned(tables(spark, sf)), "label", "center").select(
        r6(F.col("f1")).alias("f1")
    )
