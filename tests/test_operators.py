"""Operators on small hand-made frames, edge cases first."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from postlab.functions import labels as lab
from postlab.functions import vectors as vec
from postlab.operators import evaluation, folds, invertedfile, lexicon, lookup, neighbors, position, sections, stats, subwords, terms
from postlab.operators import wordvectors as wv
from postlab.sources import readers, writers

VECTORS = [("a", 5, [1.0, 0.0]), ("b", 3, [0.0, 2.0]), ("c", 1, [4.0, 4.0])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [(1, ["a", "x", "b", "a"]), (2, ["x", "y"]), (3, []), (4, ["b"])], "doc_id bigint, tokens array<string>")


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(VECTORS, "word string, n bigint, vector array<double>")


def by_key(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- lookups ----------------------------------------------------------------------------------------

def test_lookup_beyond_the_hot_words(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_WORDS", 3)
    table = spark.createDataFrame([(f"w{i}", 100 - i, i) for i in range(20)], "word string, n bigint, v int")
    facts = spark.createDataFrame(
        [(i, f"w{j}") for i in range(30) for j in (0, 0, 1, i)], "id int, word string")
    rows = lookup.lookup_join(facts, table, "word", ["v"], [F.col("id")]).collect()
    assert len(rows) == 120
    for r in rows:
        j = int(r["word"][1:])
        assert r["v"] == (j if j < 20 else None)


def test_a_hot_word_that_the_table_lacks_is_split(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_WORDS", 2)
    facts = spark.createDataFrame([(i, "<<<number>>>") for i in range(500)] + [(i, f"w{i}") for i in range(500)], "id int, word string")
    table = spark.createDataFrame([(f"w{i}", [float(i)] * 4) for i in range(0, 500, 2)], "word string, vector array<double>")
    words = facts.groupBy("word").count().withColumnRenamed("count", "n")
    joined = lookup.lookup_join(facts, table, "word", ["vector"], [F.col("id")], words)
    found = {(r["id"], r["word"]): r["vector"] for r in joined.collect()}
    assert len(found) == 1000 and found[4, "w4"] == [4.0] * 4 and found[5, "w5"] is None and found[7, "<<<number>>>"] is None
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_key" in plan
    # the facts' side of the shuffle join carries keys only
    marked = plan[plan.index("Join LeftOuter, (_key"):] if "Join LeftOuter, (_key" in plan else plan
    facts_side = marked[:marked.index("_cold_key", marked.index("_hot_key"))]
    assert facts_side.count("_hot#") <= 1


def test_token_vectors(docs, vectors):
    rows = wv.token_vectors(docs, vectors, ["doc_id"]).collect()
    assert sorted((r["doc_id"], r["pos"], r["word"]) for r in rows) == [(1, 0, "a"), (1, 2, "b"), (1, 3, "a"), (4, 0, "b")]
    rows = wv.token_vectors_with_default(docs, vectors, ["doc_id"], 2).collect()
    assert len(rows) == 7
    assert all(r["vector"] == [0.0, 0.0] for r in rows if r["word"] in "xy")


def test_word_vector_is_case_blind(spark, vectors):
    words = spark.createDataFrame([("A",), ("zz",)], "word string")
    found = by_key(wv.word_vector(words, vectors), "word")
    assert found["A"]["vector"] == [1.0, 0.0] and found["zz"]["vector"] == []


def test_mean_vectors(docs, vectors):
    found = by_key(wv.mean_vectors(docs, vectors, ["doc_id"], 2))
    assert found[1]["mean_vector"] == pytest.approx([2 / 3, 2 / 3])
    assert found[2]["mean_vector"] == found[3]["mean_vector"] == [0.0, 0.0]
    assert found[4]["mean_vector"] == [0.0, 2.0]


def test_sequences(docs, vectors):
    found = by_key(wv.vector_sequences(docs, vectors, ["doc_id"]))
    assert found[1]["vectors"] == [[1.0, 0.0], [0.0, 2.0], [1.0, 0.0]] and found[3]["vectors"] == []
    assert {r["doc_id"]: r["n_known"] for r in wv.known_tokens(docs, vectors, ["doc_id"]).collect()} == {1: 3, 4: 1}
    padded = by_key(wv.padded_sequences(docs, vectors, ["doc_id"], 2, 2))
    assert padded[1]["sequence"] == [1.0, 0.0, 0.0, 2.0]
    assert padded[4]["sequence"] == [0.0, 2.0, 0.0, 0.0]
    assert set(padded) == {1, 4}


@pytest.mark.parametrize("n,want", [(1, 4), (2, 4), (3, 4)])
def test_sequence_width(spark, n, want):
    df = spark.createDataFrame([([[0.1, 2.0]] * n,)], "v array<array<double>>")
    values = df.select(vec.sequence_vector(F.col("v"), 2, 2).alias("s")).head()["s"]
    assert len(values) == want and values[0] == np.float32(0.1).astype(float)


# ---- lexicon and spelling ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame(
        [("A", "positive", 0), ("q", "positive", 1), ("b", "negative", 0), ("b", "negative", 1)],
        "word string, polarity string, idx int")


@pytest.mark.parametrize("hot", [1000, 1])
def test_lexicon(docs, words, monkeypatch, hot):
    monkeypatch.setattr(lookup, "HOT_WORDS", hot)
    counts = by_key(lexicon.lexicon_counts(docs, words, ["doc_id"]))
    assert [(counts[i]["positive"], counts[i]["negative"]) for i in (1, 2, 3, 4)] == [(1, 2), (0, 0), (0, 0), (0, 2)]
    found = by_key(lexicon.lexicon_vectors(docs, words, ["doc_id"]))
    assert found[1]["lexicon"] == {0: 1.0, 1: 2.0, 2: 1.0, 4: 1.0, 5: 1.0}
    assert found[3]["lexicon"] == {0: 0.0, 1: 0.0}


def test_misspelling(spark):
    docs = spark.createDataFrame(
        [(1, ["a", "zz", "zz", "<<<tokenquote>>>"]), (2, [])], "doc_id bigint, tokens array<string>")
    known = spark.createDataFrame([("a", 9)], "word string, n bigint")
    found = by_key(lexicon.misspelling_ratio(docs, known, ["doc_id"]))
    assert (found[1]["n_tokens"], found[1]["n_unknown"], found[1]["ratio"]) == (4, 2, 0.5)
    assert (found[2]["n_tokens"], found[2]["ratio"]) == (0, 0.0)


# ---- positions, folds, samples --------------------------------------------------------------------------------

def test_positions_per_group(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).cast("string").alias("g")).repartition(7)
    rows = position.with_position(df, [F.desc("id")], ["g"]).collect()
    for g in "012":
        mine = sorted((r["position"], r["id"]) for r in rows if r["g"] == g)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1))
        assert [i for _, i in mine] == sorted((i for _, i in mine), reverse=True)


def test_positions_with_null_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id int, g string")
    rows = position.with_position(df, [F.col("id")], ["g"]).collect()
    assert sorted((r["id"], r["position"]) for r in rows) == [(1, 1), (2, 2), (3, 1)]


def test_contiguous_folds_with_remainder(spark):
    rows = folds.contiguous_folds(spark.range(13), [F.col("id")], 5).collect()
    assert [r["fold"] for r in sorted(rows)] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 5]


def test_hash_folds_partition_the_ids(spark):
    a = folds.keyed_folds(spark.range(500), "id", 5, 1).collect()
    b = folds.keyed_folds(spark.range(500).repartition(9), "id", 5, 1).collect()
    assert sorted(a) == sorted(b) and {r["fold"] for r in a} == {0, 1, 2, 3, 4}
    assert sorted(a) != sorted(folds.keyed_folds(spark.range(500), "id", 5, 2).collect())


def test_shuffle_is_a_permutation(spark):
    rows = folds.seeded_shuffle(spark.range(200), "id", 3).collect()
    assert sorted(r["position"] for r in rows) == list(range(1, 201))
    assert [r["id"] for r in sorted(rows, key=lambda r: r["position"])] != list(range(200))


# ---- neighbours --------------------------------------------------------------------------------------------------

def brute(q, t, k, limit=None):
    found = []
    for i, a in enumerate(q):
        d = sorted((math.dist(a, b), j) for j, b in enumerate(t))
        found += [(i, j, r + 1, round(x, 9)) for r, (x, j) in enumerate(d[:k]) if limit is None or x <= limit]
    return sorted(found)


def frame(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "id bigint, vector array<double>")


@pytest.mark.parametrize("limit", [None, 0.8])
@pytest.mark.parametrize("clustered", [True, False])
def test_nearest_equals_brute_force(spark, monkeypatch, clustered, limit):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 20)
    monkeypatch.setattr(neighbors, "CHUNK_ROWS", 8)
    monkeypatch.setattr(neighbors, "SLICE_ROWS", 3)
    rng = np.random.default_rng(1)
    t = rng.normal(size=(220, 3)) * 0.3
    q = rng.normal(size=(90, 3)) * 0.3
    if clustered:  # a third of the targets in one spot, the others far apart
        t[:70] = t[0]
        t[70:] += rng.integers(0, 4, size=(150, 1)) * 10.0
        q += rng.integers(0, 4, size=(90, 1)) * 10.0
    got = neighbors.nearest(frame(spark, q), frame(spark, t), 4, limit).collect()
    got = sorted((r["id"], r["neighbour"], r["rank"], round(r["distance"], 9)) for r in got)
    assert got == brute(q, t, 4, limit)


def test_nearest_with_few_or_no_targets(spark):
    q = frame(spark, [[0.0], [5.0]])
    assert len(neighbors.nearest(q, frame(spark, [[1.0]]), 3).collect()) == 2
    assert neighbors.nearest(q, frame(spark, [[1.0]]).where("id < 0"), 3).collect() == []


def test_subwords_and_composed_vectors(spark):
    words = spark.createDataFrame([("abc",), ("abd",), ("zz",), ("",)], "word string")
    grams = {r[0]: r[1] for r in words.select("word", subwords.subwords(F.col("word"))).collect()}
    assert grams["abc"] == ["<ab", "abc", "bc>", "<abc", "abc>", "<abc>"] and grams[""] == []
    vectors = spark.createDataFrame([("abc", [1.0, 3.0]), ("<", [9.0, 9.0])], "word string, vector array<double>")
    of_buckets = subwords.bucket_vectors(vectors, 2)
    found = {r["word"]: (r["known"], r["vector"]) for r in subwords.vocabulary_vectors(words, vectors, of_buckets, 2).collect()}
    assert found == {"abc": (True, [1.0, 3.0]), "abd": (False, [1.0, 3.0]), "zz": (False, [0.0, 0.0]), "": (False, [0.0, 0.0])}
    docs = spark.createDataFrame([(1, ["abd", "zz", "abd"]), (2, [])], "doc int, tokens array<string>")
    counted = spark.createDataFrame([("abd", 2), ("zz", 1)], "word string, n bigint")
    rows = subwords.token_vectors_composed(docs, vectors, of_buckets, ["doc"], 2, counted).orderBy("pos").collect()
    assert [r["vector"] for r in rows] == [[1.0, 3.0], [0.0, 0.0], [1.0, 3.0]]


def test_approximate_neighbours_find_most_in_few_cells(spark):
    """Vectors in groups: nine tenths of the true neighbours, less than half of all pairs."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 16))
    t = np.concatenate([c + rng.normal(size=(20, 16)) * 0.2 for c in centers])
    q = centers + rng.normal(size=(30, 16)) * 0.2
    exact = {(i, j) for i, j, _, _ in brute(q, t, 5)}
    queries, targets = frame(spark, q), frame(spark, t)
    rows = invertedfile.nearest_approximate(queries, targets, 5).collect()
    assert len(exact & {(r["id"], r["neighbour"]) for r in rows}) >= 0.9 * len(exact)
    work = invertedfile.search_work(queries, targets, 5).first()
    assert (work["queries"], work["targets"]) == (30, 600) and work["share"] < 0.5


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_approximate_neighbours_of_the_embeddings(spark, folder):
    """Every vector against the others: its own row is at distance 0 and does not count."""
    rows = entry.queries()["knn_lsh"](spark, f"/root/testdata/{folder}").collect()
    exact = entry.queries()["knn_exact"](spark, f"/root/testdata/{folder}").collect()
    want = {(r.vec_id, r.neighbour) for r in exact if r.vec_id != r.neighbour}
    assert len(rows) == len(exact) and all(r.distance == 0 for r in rows if r.rank == 1)
    assert len(want & {(r.vec_id, r.neighbour) for r in rows}) >= 0.9 * len(want)


def test_approximate_neighbours_of_copies_and_few_targets(spark, monkeypatch):
    monkeypatch.setattr(invertedfile, "SLICE_TARGETS", 7)
    monkeypatch.setattr(invertedfile, "BLOCK_TARGETS", 20)
    monkeypatch.setattr(invertedfile, "CHUNK_QUERIES", 9)
    same = frame(spark, [[1.0, 0.0]] * 60 + [[-1.0, 0.5]])
    rows = invertedfile.nearest_approximate(same, same, 3, n_cells=4).collect()
    found = {(r["id"], r["rank"]): r["neighbour"] for r in rows}
    assert len(rows) == 183 and all(found[i, r] == r - 1 for i in range(60) for r in (1, 2, 3))
    few = invertedfile.nearest_approximate(same, same.where("id >= 59"), 5).collect()
    assert len(few) == 122
    assert invertedfile.nearest_approximate(same, same.where("id < 0"), 5).collect() == []


def test_closest_by_criterion(spark):
    points = spark.createDataFrame(
        [(0, [0.0], 1), (1, [1.0], 2), (2, [3.0], 1), (3, [9.0], 1)], "id bigint, vector array<double>, label int")
    found = by_key(neighbors.closest_by_criterion(points, points, F.col("label") == 1, 2.0), "id")
    assert [found[i]["neighbour"] for i in range(4)] == [0, 0, 2, 3]
    found = by_key(neighbors.closest_by_criterion(points, points, F.col("label") == 2, 2.0), "id")
    assert [found[i]["neighbour"] for i in range(4)] == [1, 1, 1, None]  # a distance of 2.0 still counts


def test_substitution_is_strict(spark):
    words = spark.createDataFrame(
        [(0, "a", 1, [0.0]), (1, "b", 1, [1.0]), (2, "c", 1, [3.0])], "id bigint, word string, n bigint, vector array<double>")
    targets = words.where("word = 'b'")
    found = {r["word"]: r["substitute"] for r in neighbors.substitutions(words, targets, 2.0).collect()}
    assert found == {"a": "b", "b": "b"}  # c is exactly 2.0 away
    assert {r["word"] for r in neighbors.substitutions(words, targets, 1e-9).collect()} == {"b"}


# ---- sections, statistics, votes, evaluation -----------------------------------------------------------------------

@pytest.mark.parametrize("chunk", [2, 4096])
def test_sections(spark, monkeypatch, chunk):
    monkeypatch.setattr(sections, "CHUNK_LINES", chunk)
    text = ["before", " <text x>", "one", "| <text", "two", "{ </text>", "three", "</text>", "after", "<text>", "last"]
    lines = spark.createDataFrame([(d, i, x) for d in (1, 2) for i, x in enumerate(text)], "doc int, pos int, line string")
    rows = sections.section_lines(lines, ["doc"]).where("doc = 2").orderBy("pos").collect()
    assert [r["line"] for r in rows] == [" <text x>", "one", "two", "three", "<text>", "last"]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_section_state_is_carried_over_splits(spark, tmp_path, monkeypatch, limit):
    """Files cut every few bytes, against one pass over each file; sections longer than several splits."""
    monkeypatch.setattr(sections, "BROADCAST_SPLITS", limit)
    rng = random.Random(4)
    want = []
    for f in range(3):
        lines = [rng.choice(["<text", "</text", "| <text", "a", "b c", "", "d"] + ["x"] * 20) + f" {i}" for i in range(300)]
        (tmp_path / f"dump{f}.txt").write_text("\n".join(lines))
        take = False
        for x in (x for x in lines if not x.startswith("|")):
            take = x.startswith("<text") or (take and not x.startswith("</text"))
            want += [x] if take else []
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = readers.read_dump_splits(spark, str(tmp_path))
        assert rows.select("doc", "split").distinct().count() > 20
        found = sections.scanned_section_lines(rows, ["doc"], split="split", pos="row").orderBy("doc", "split", "row").collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert [r["line"] for r in found] == want


def test_scanned_sections_of_whole_documents(spark, sf):
    text = ["before", " <text x>", "one", "| <text", "two", "{ </text>", "three", "</text>", "after", "<text>", "last"]
    docs = spark.createDataFrame([(d, text) for d in (1, None, 2)], "doc int, text array<string>").coalesce(1)
    lines = docs.select("doc", F.posexplode("text").alias("pos", "line"))
    found = sections.scanned_section_lines(lines, ["doc"]).collect()
    assert [r["line"] for r in found] == [" <text x>", "one", "two", "three", "<text>", "last"] * 3
    assert sections.scanned_section_lines(lines.where("doc > 5"), ["doc"]).collect() == []
    plan = entry.queries()["clean_markup_lines"](spark, sf)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_side_by_side_counts(spark):
    docs = spark.createDataFrame(
        [(1, "p", "a b"), (2, "n", "a"), (3, "p", "a b c ")], "id int, c string, text string")
    rows = stats.word_counts_wide(docs, "c", ["p", "n"], "id").orderBy("position")
    assert [r["line"] for r in rows.select(stats.side_by_side(rows, ["p", "n"]).alias("line")).collect()] == ["2;1", "3;"]


def test_corpus_stats(spark):
    docs = spark.createDataFrame(
        [("train", 1, 2, "a b"), ("train", 1, 0, "a b c d"), ("test", None, None, "a")],
        "split string, relevance int, sentiment int, text string")
    rows = {(r["split"], r["relevance"], r["sentiment"]): r for r in stats.corpus_stats(docs).collect()}
    assert set(rows) == {
        ("train", 1, None), ("train", None, 2), ("train", None, 0), ("train", None, None), ("test", None, None)}
    assert rows["train", 1, None]["mean_words"] == 3.0
    assert rows["train", 1, None]["sd_words"] == pytest.approx(math.sqrt(2))
    assert rows["test", None, None]["sd_words"] is None


def test_chi_square_against_the_definition(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 3, 300), rng.integers(0, 3, 300)
    rows = [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, x int, y int").withColumn("f", F.lit("f"))
    sizes = terms.class_sizes(df, "y", [0, 1, 2])
    got = terms.chi_square(df.where("x <> 0"), "f", "x", "y", [0, 1, 2], sizes).head()
    table = np.array([[np.sum((x == a) & (y == b)) for b in range(3)] for a in range(3)], dtype=float)
    expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    assert got["statistic"] == pytest.approx(((table - expected) ** 2 / expected).sum())
    assert got["dof"] == 4


def test_votes(spark):
    df = spark.createDataFrame(
        [([1.5, 0.4, 2.0],), ([1.0, 0.0],), ([2.0, 1.0, 1.0, 2.0],)], "v array<double>")
    assert [r["m"] for r in df.select(vec.majority(F.col("v")).alias("m")).collect()] == [2, 0, 1]
    df = spark.createDataFrame([([0.2, 0.8], [0.8, 0.2]), ([0.1, 0.9], [0.3, 0.7])], "a array<double>, b array<double>")
    assert [r["m"] for r in df.select(vec.soft_vote(F.col("a"), F.col("b")).alias("m")).collect()] == [0, 1]


def test_confusion_and_f1(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 1.0), (1, 1.0), (1, 1.0)], "a int, p double")
    grid = {(r["actual"], r["predicted"]): r["n"] for r in evaluation.confusion_matrix(df, "a", "p", 3).collect()}
    assert len(grid) == 9 and grid[0, 0] == 1 and grid[0, 1] == 1 and grid[1, 1] == 2 and grid[2, 2] == 0
    assert evaluation.micro_f1(df, "a", "p").head()["f1"] == 0.75
    assert evaluation.weighted_f1(df, "a", "p").head()["f1"] == pytest.approx(0.5 * 2 / 3 + 0.5 * 4 / 5)


def test_labels(spark):
    df = spark.createDataFrame([("negative", 0.4), ("neutral", 0.5), ("other", 2.0)], "s string, p double")
    rows = df.select(lab.sentiment_code(F.col("s")).alias("c"), lab.sentiment_name(F.col("p")).alias("n"),
                     lab.relevance_name(F.col("p")).alias("r")).collect()
    assert [tuple(r) for r in rows] == [(0, "negative", "false"), (1, "neutral", "true"), (2, "positive", "true")]


def test_submission_has_one_row_per_id(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (1, "b", 2.0), (2, "c", 1.0)], "id int, text string, prediction double")
    rows = writers.submission(df.repartition(3), "sentiment").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "b", "unknown", "positive"), ("2", "c", "unknown", "neutral")]
    rows = writers.submission(df, "relevance").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "b", "true", "unknown"), ("2", "c", "true", "unknown")]


def test_vector_math(spark):
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0], 2)], "a array<double>, b array<double>, i int")
    r = df.select(vec.add(F.col("a"), F.col("b")).alias("s"), vec.subtract(F.col("a"), F.col("b")).alias("d"),
                  vec.distance(F.col("a"), F.col("b")).alias("x"), vec.one_hot(F.col("i"), 4).alias("h")).head()
    assert (r["s"], r["d"], r["x"], r["h"]) == ([5.0, 8.0], [-3.0, -4.0], 5.0, [0.0, 0.0, 1.0, 0.0])
