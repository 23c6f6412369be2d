"""Readers and writers on real files."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from postlab.session import stored, stored_alone
from postlab.sources import readers, writers


def lines_of(path):
    found = []
    for part in sorted(glob.glob(f"{path}/**/part-*", recursive=True)):
        found += open(part, encoding="utf-8").read().splitlines()
    return found


@pytest.fixture
def corpus(tmp_path):
    scores = "\t".join(["1,5", "2,25"])
    (tmp_path / "a.tsv").write_text(
        "id\ttext\trelevance\tsentiment\tx\ts1\ts2\n"
        f"1\tZug \"kommt nicht\ttrue\tnegative\t7\t{scores}\n"
        f"2\tAlles, gut\tfalse\tneutral\t7\t{scores}\n"
        "3\tkurz\ttrue\tpositive\t7\t1,0\n", encoding="utf-8")
    (tmp_path / "b.tsv").write_text(
        "id\ttext\trelevance\tsentiment\tx\ts1\ts2\n4\tJa\ttrue\tpositive\t7\t1,0\tn/a\n", encoding="utf-8")
    return tmp_path


def test_corpus(spark, corpus):
    rows = {r["id"]: r for r in readers.read_corpus(spark, f"{corpus}/*.tsv").collect()}
    assert set(rows) == {"1", "2", "3", "4"}
    assert rows["1"]["scores"] == [1.5, 2.25] and rows["1"]["relevant"] and rows["1"]["sentiment"] == 0
    assert rows["1"]["tokens"] == ["zug", "<<<tokenquote>>>", "kommt", "nicht"]
    assert rows["4"]["scores"] == [1.0, None] and rows["4"]["sentiment"] == 2
    full = readers.read_corpus(spark, f"{corpus}/*.tsv", n_scores=2).collect()
    assert {r["id"] for r in full} == {"1", "2", "4"}
    tolerant = readers.read_corpus(spark, f"{corpus}/*.tsv", score_offset=4, tolerant=True, raw=True)
    row = {r["id"]: r for r in tolerant.collect()}["4"]
    assert row["scores"] == [7.0, 1.0] and row["tokens"] == ["ja"]


def test_word_vectors(spark, tmp_path):
    (tmp_path / "v.vec").write_text("2 3\nhaus 1 2 3\nbahn 0.5 -1 2e-1 \nkaputt 1 2\n", encoding="utf-8")
    rows = {r["word"]: r["vector"] for r in readers.read_word_vectors(spark, str(tmp_path / "v.vec"), 3).collect()}
    assert rows == {"haus": [1.0, 2.0, 3.0], "bahn": [0.5, -1.0, 0.2]}


def test_lexicon(spark, tmp_path):
    (tmp_path / "p.txt").write_text("Gut|ADJX\t0.3\nsuper\t0.5\n", encoding="utf-8")
    (tmp_path / "n.txt").write_text("übel\t-0.3\r\nschlecht", encoding="utf-8")
    rows = readers.read_lexicon(spark, str(tmp_path / "p.txt"), str(tmp_path / "n.txt")).collect()
    assert sorted(tuple(r) for r in rows) == [
        ("Gut|ADJX", "positive", 0), ("schlecht", "negative", 1), ("super", "positive", 1), ("übel", "negative", 0)]


def test_reviews(spark, tmp_path):
    (tmp_path / "r.csv").write_text("1;x;y;Sehr gut!;Gerne (wieder)\n", encoding="utf-8")
    assert readers.read_review_tokens(spark, str(tmp_path / "r.csv")).head()["words"] == ["sehr", "gut", "gerne", "wieder"]
    (tmp_path / "r.json").write_text('{"reviewID": "r1", "helpful": [1, 2], "overall": 5, "unixReviewTime": 12}\n')
    row = readers.read_product_reviews(spark, str(tmp_path / "r.json")).head()
    assert (row["reviewID"], row["helpful"], row["overall"], row["unixReviewTime"], row["asin"]) == ("r1", [1, 2], 5, 12, None)


def test_dump_lines_of_several_splits(spark, tmp_path):
    """Files of very different size, cut into many splits that Spark packs largest first."""
    sizes = {"a.xml": 400, "b.xml": 3, "c.xml": 90}
    for name, n in sizes.items():
        (tmp_path / name).write_text("".join(f"{name} {i} {'x' * (i % 50)}\n" for i in range(n)), encoding="utf-8")
    keys = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        frame = readers.read_dump_lines(spark, str(tmp_path))
        rows = frame.collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name, n in sizes.items():
        mine = sorted((r["pos"], r["line"]) for r in rows if r["doc"].endswith(name))
        assert [p for p, _ in mine] == list(range(n)) and [x.split()[1] for _, x in mine] == [str(i) for i in range(n)]


def test_feature_matrix(spark, tmp_path):
    df = spark.createDataFrame([([1.0, 2.5], 1)], "f array<double>, y int")
    assert writers.write_feature_matrix(df, str(tmp_path / "m"), "f", "y") is df
    writers.write_feature_matrix(df, str(tmp_path / "n"), "f")
    assert lines_of(tmp_path / "m") == ["1,1.0,2.5"] and lines_of(tmp_path / "n") == ["1.0,2.5"]


def test_submission_file(spark, tmp_path):
    df = spark.createDataFrame([(1, 'sagt "hallo"', 1.0)], "id int, text string, prediction double")
    writers.write_submission(writers.submission(df, "relevance"), str(tmp_path / "s"))
    assert lines_of(tmp_path / "s") == ['1\tsagt "hallo"\ttrue\tunknown']


@pytest.mark.parametrize("text,want", [
    ("  lead blank ", "  lead blank "), ("", ""), ("tab\there", "tab here"), ("line\r\nbreak", "line  break"), ('"quoted" \\', '"quoted" \\'), (None, "")])
def test_odd_texts_in_files(spark, tmp_path, text, want):
    df = spark.createDataFrame([(7, text, 1.0, 0)], "id int, text string, prediction double, fold int")
    writers.write_submission(writers.submission(df, "sentiment"), str(tmp_path / "s"))
    assert lines_of(tmp_path / "s") == [f"7\t{want}\tunknown\tneutral"]
    writers.write_fold_files(df, str(tmp_path / "f"), ["id", "text"], 1)
    assert lines_of(tmp_path / "f/side=test/cv=0") == [f"7\t{want}"]


def test_text_lines(spark, tmp_path):
    df = spark.createDataFrame([(["ab", "cd"], 2)], "t array<string>, y int")
    writers.write_lines(df.select(writers.labelled_line(F.col("t"), F.col("y")).alias("line")), str(tmp_path / "l"))
    writers.write_lines(df.select(writers.bare_line(F.col("t")).alias("line")), str(tmp_path / "b"))
    assert lines_of(tmp_path / "l") == ["ab cd __label__2.0"] and lines_of(tmp_path / "b") == ["ab cd"]


def test_fold_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id int, fold int")
    writers.write_fold_files(df, str(tmp_path / "f"), ["id"], 2)
    assert lines_of(tmp_path / "f/side=test/cv=0") == ["1"]
    assert sorted(lines_of(tmp_path / "f/side=train/cv=0")) == ["2", "3"]
    assert sorted(lines_of(tmp_path / "f/side=train/cv=1")) == ["1", "3"]


def test_wide_counts_file(spark, tmp_path):
    wide = spark.createDataFrame([(2, 3, None), (1, 2, 1)], "position int, p int, n int")
    writers.write_wide_counts(wide, str(tmp_path / "w"), ["p", "n"])
    assert lines_of(tmp_path / "w") == ["2;1", "3;"]

def test_tables_on_the_way_are_removed(spark):
    paths = []

    def make():
        passing = stored(spark.range(10))
        paths.extend(passing.inputFiles())
        return passing.where("id > 4")

    result = stored_alone(make)
    assert result.count() == 5
    assert paths and not any(os.path.exists(p.removeprefix("file://")) for p in paths)
    assert stored(spark.range(3)).count() == 3
