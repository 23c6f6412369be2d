"""Targets, permutations and words taken against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postlab.llm import mixing
from tests.llm import plain_mix
from tests.llm.fixture import documents, empty


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 5, 100, 1000, 100000]) for s in ["a", "B", "ü", "", "z", None, "\U0001F600", "\uffee"][:rng.randrange(1, 9)]}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    names, want = plain_mix.targets(sizes, (1, 2, 3), 3)
    got = mixing.targets(table, (1, 2, 3), 3).orderBy("src").collect()
    assert [r.source for r in got] == names
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.target <= 3 * sizes[r.source]
    assert sum(r.target for r in got) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("size", [1, 2, 3, 10, 257])
def test_permutation(spark, size):
    table = spark.range(size).select(
        mixing.permuted(F.col("id"), F.lit(size), mixing.round_keys(F.lit(size), F.lit(77))).alias("to"), "id")
    found = {r["id"]: r.to for r in table.collect()}
    assert sorted(found.values()) == list(range(size))
    assert found == {i: plain_mix.permuted(i, size, 77) for i in range(size)}


@pytest.mark.parametrize("settings", [{}, {"block": 7, "shard_slots": 5, "seed": 4}, {"weights": (5, 1), "most": 2}])
def test_words_taken(spark, monkeypatch, settings):
    monkeypatch.setattr(mixing, "FAN", 3)  # running sums in several levels
    monkeypatch.setattr(mixing, "GROUP_ROWS", 2)
    monkeypatch.setattr(mixing, "PART_SLOTS", 10)
    docs = documents(spark, odd_ids=True)
    sizes = mixing.word_sizes(docs)
    rows = [(r.row, r["id"], r.source, None) for r in sizes.collect()]
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    counted = {r.row: r["size"] for r in sizes.collect()}
    rows = [(row, i, s, texts[i] if i is not None else " ".join("w" * counted[row])) for row, i, s, _ in rows]
    got = mixing.Mix(sizes, **settings).per_row().collect()
    size, sums, target, pieces = plain_mix.mix(rows, **settings)
    taken = Counter()
    for row, _, _, n in pieces:
        taken[row] += n
    most = settings.get("most", 3)
    assert len(got) == len(rows)
    for r in got:
        assert (r["size"], r.source_size, r.taken) == (size[r.row], sums[r.source], taken[r.row])
        assert r.target == pytest.approx(target[r.source]) and r.taken <= most * r["size"]
    for source, want in target.items():
        block = settings.get("block", 64)
        assert abs(sum(r.taken for r in got if r.source == source) - want) <= block * (1 + most)


def test_reruns_agree(spark):
    a = mixing.Mix(mixing.word_sizes(documents(spark, parts=2))).per_row().drop("row")
    b = mixing.Mix(mixing.word_sizes(documents(spark, parts=7))).per_row().drop("row")
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_texts_of_the_mix(spark):
    docs = documents(spark)
    mix = mixing.mixed_texts(docs, block=16)
    assert mix.columns == docs.columns
    rows = [(r.doc_id, r.doc_id, r.source, r.text) for r in docs.collect()]
    assert sorted((r.doc_id, r.text) for r in mix.collect()) == sorted(plain_mix.used_texts(rows, block=16))


def test_empty_table_no_words_and_many_sources(spark, monkeypatch):
    assert mixing.Mix(mixing.word_sizes(empty(spark))).per_row().collect() == []
    assert mixing.mixed_texts(empty(spark)).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted(tuple(r)[:6] for r in mixing.Mix(mixing.word_sizes(blank)).per_row().collect()) == [
        (1, "a", 0, 0, 0.0, 0), (2, None, 0, 0, 0.0, 0)]
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1)
    with pytest.raises(ValueError):
        mixing.Mix(mixing.word_sizes(blank))
