"""The digest tree against a dictionary of texts."""

import hashlib
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from postlab.llm.exact_dedup import drop_copies, first_runs, meet, merge_runs
from tests.llm.fixture import documents, empty


def expected(rows, keep):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    best = {}
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best[text] = (max if keep == "largest" else min)(known) if known else None
    return sorted((
        (doc_id, best[text or ""], len(groups[text or ""]), hashlib.sha256((text or "").encode()).hexdigest())
        for doc_id, text in rows), key=repr), len(groups)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("sizes", [{}, {"run_rows": 3}])
def test_groups(spark, keep, sizes):
    docs = documents(spark, repeated=True, odd_ids=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, groups = expected(rows, keep)
    got = merge_runs(docs, keep=keep, **sizes).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == groups == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_rows_that_stay_keep_their_columns(spark):
    docs = documents(spark, repeated=True, odd_ids=True)
    left = drop_copies(docs, keep="largest")
    assert left.columns == docs.columns
    rows = left.collect()
    assert len(rows) == len({r.text or "" for r in docs.collect()}) == len({r.text or "" for r in rows})
    best = {r.text_sha256: r.keep_id for r in merge_runs(docs, keep="largest").collect()}
    assert all(best[hashlib.sha256((r.text or "").encode()).hexdigest()] == r.doc_id for r in rows)


def test_empty_table_and_bad_setting(spark):
    assert merge_runs(empty(spark)).collect() == []
    assert drop_copies(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        merge_runs(empty(spark), keep="first")


def test_runs_are_sorted_after_every_round(spark):
    rows = spark.range(3000).select(
        (F.col("id") % 300).alias("run"), F.unhex(F.sha2((F.col("id") % 700).cast("string"), 256)).alias("digest"),
        F.lit(1).alias("n_bytes"), (F.col("id") % 700).alias("second"), F.lit(False).alias("missing"), "id",
        F.col("id").alias("row")).cache()
    level, left = first_runs(rows, "smallest"), 300
    for place in range(3):
        level, left = meet(level, place, "smallest"), -(-left // 16)
        runs = defaultdict(list)
        for r in level.orderBy("run", "piece").collect():
            assert all(bytes(e.digest).hex().upper().startswith(r.piece) for e in r.entries)
            runs[r.run] += [(bytes(e.digest), e.id, e.n) for e in r.entries]
        assert len(runs) == left
        for run in runs.values():
            digests = [d for d, _, _ in run]
            assert digests == sorted(set(digests))
        assert sum(n for run in runs.values() for _, _, n in run) == 3000
    (only,) = runs.values()
    assert sorted(i for _, i, _ in only) == list(range(700))
