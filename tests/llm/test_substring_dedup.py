"""Removed words against a dictionary of all windows."""

import pytest

from postlab.llm import substring_dedup as sd
from tests.llm.fixture import documents, empty


def brute(rows, window):
    seen, found = set(), {}
    for key, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for at in range(len(words) - window + 1):
            part = tuple(words[at:at + window])
            if part in seen:
                gone[at:at + window] = [True] * window
            seen.add(part)
        found[key] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return found


@pytest.mark.parametrize("window,flush,block", [(20, None, None), (20, 50, 40), (8, None, None)])
def test_words_that_are_removed(spark, monkeypatch, window, flush, block):
    if flush:
        monkeypatch.setattr(sd, "FLUSH", flush)
        monkeypatch.setattr(sd, "BLOCK", block)
    docs = documents(spark, seed=window)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = brute(rows, window)
    got = sd.remove_repeats(docs, window=window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == want and len(got) == len(want)
    assert sum(r.n_removed for r in got) > 100


def test_factors_point_to_equal_words(spark):
    docs = documents(spark)
    texts = {r.doc_id: (r.text or "").encode().split() for r in docs.collect()}
    count = 0
    for r in sd.remove_repeats(docs).collect():
        covered = set()
        for f in r.factors:
            assert f.length >= 20 and (f.source, f.source_start) < (r.doc_id, f.start)
            assert texts[r.doc_id][f.start:f.start + f.length] == texts[f.source][f.source_start:f.source_start + f.length]
            covered |= set(range(f.start, f.start + f.length))
            count += 1
        assert len(covered) == r.n_removed
    assert count > 5


def test_shared_and_missing_identifiers(spark):
    docs = documents(spark, repeated=True, odd_ids=True)
    got = sd.remove_repeats(docs).collect()
    assert len(got) == docs.count()
    # rows of one identifier follow each other, so of repeated rows one keeps what is new
    kept, rows = {}, docs.collect()
    for r in got:
        kept.setdefault(r.doc_id, []).append(r.n_words - r.n_removed)
    order = sorted(((r.doc_id is None, r.doc_id or 0), r.text) for r in rows if r.text)
    total = brute([((i, *key), text) for i, (key, text) in enumerate(order)], 20)
    assert sum(sum(v) for v in kept.values()) == sum(n - gone for n, gone, _ in total.values())


def test_empty_table_and_short_window(spark):
    assert sd.remove_repeats(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        sd.remove_repeats(empty(spark), window=3)
