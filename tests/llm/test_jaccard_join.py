"""Components against all pairs of shingle sets."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest

from postlab.llm import jaccard_join as jj
from postlab.llm.components import components
from tests.llm.fixture import documents, empty


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(sets, percent):
    label = {i: i for i in sets}

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    keys = sorted(sets)
    for x, i in enumerate(keys):
        for j in keys[x + 1:]:
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("n,percent,size", [(4, 85, None), (5, 80, None), (2, 60, 400), (4, 85, 150)])
def test_components(spark, n, percent, size):
    docs = documents(spark, seed=n)
    want = brute({r.doc_id: shingles(r.text, n) for r in docs.collect()}, percent)
    sizes = {"region_size": size} if size else {}
    got = jj.similar_documents(docs, n=n, percent=percent, **sizes).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(want)
    assert len({c for _, c in want.values()}) < len(want) - 10


def test_blocks_of_a_region_that_pivots_do_not_cut(spark, monkeypatch):
    monkeypatch.setattr(jj, "MAX_DEPTH", 0)
    monkeypatch.setattr(jj, "FLUSH", 100)
    docs = documents(spark, seed=9)
    want = brute({r.doc_id: shingles(r.text, 4) for r in docs.collect()}, 70)
    got = jj.similar_documents(docs, n=4, percent=70, region_size=300).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_chain_of_a_hot_group(spark, monkeypatch):
    """Near copies of near copies: the ends of the chain are far apart, yet one component."""
    monkeypatch.setattr(jj, "CHUNK", 20)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        rows.append((i, " ".join(words)))
        words[rng.randrange(60)] = f"x{i}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute({i: shingles(t, 4) for i, t in rows}, 80)
    for sizes in ({}, {"region_size": 2000}):
        got = jj.similar_documents(docs, n=4, percent=80, **sizes).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for percent in (50, 80, 85, 95):
        similarity = Fraction(percent, 100)
        signatures = jj.Signatures(similarity)
        for _ in range(300):
            common = rng.integers(0, 2**63, rng.integers(1, 120), dtype=np.uint64)
            most = int(len(common) / similarity) - len(common)
            extra = rng.integers(0, 2**63, most, dtype=np.uint64)
            cut = rng.integers(0, most + 1)
            a, b = np.unique(np.append(common, extra[:cut])), np.unique(np.append(common, extra[cut:]))
            if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                assert np.intersect1d(signatures(a), signatures(b)).size


def test_region_join_is_exact():
    rng = np.random.default_rng(6)
    for percent in (60, 85):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60)).astype(np.uint64)) for _ in range(150)]
        sets += [np.unique(np.append(s[1:], [np.uint64(99)])) for s in sets[:60]]
        want = brute({i: frozenset(s.tolist()) for i, s in enumerate(sets)}, percent)
        assert jj.join_region(sets, Fraction(percent, 100)) == [want[i][1] for i in range(len(sets))]


def test_one_row_of_each_component_stays(spark):
    docs = documents(spark, repeated=True, odd_ids=True)
    left = jj.drop_similar(docs, n=4, percent=85)
    assert left.columns == docs.columns
    rows, kept = docs.collect(), left.collect()
    order = {i: r for i, r in enumerate(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")))}
    want = brute({i: shingles(r.text, 4) for i, r in order.items()}, 85)
    assert len(kept) == len({c for _, c in want.values()})
    assert jj.drop_similar(empty(spark)).collect() == []


def test_empty_table_and_identifiers(spark):
    assert jj.similar_documents(empty(spark)).collect() == []
    docs = documents(spark, odd_ids=True, repeated=True)
    got = jj.similar_documents(docs).collect()
    assert len(got) == docs.count()
    no_id = {r.n_shingles: r.component_id for r in got if r.doc_id is None}
    assert no_id[0] is None and no_id[1] is None  # no words, and a text that only this row has


def test_components_of_links(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7)]
    label = {i: i for pair in links for i in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    linked = {i for a, b in links if a != b for i in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == {i: label[i] for i in linked} and len(got) == len(linked)
