"""The manifest against a plain tree in memory, and proofs for some leaves only."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from postlab.llm import merkle
from tests.llm.fixture import documents, empty

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """Levels of a tree, and for each leaf the siblings (before, after) level by level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([digest(*low[i:i + 3]) for i in range(0, len(low), 3)])
    paths = []
    for at in range(len(nodes)):
        path = []
        for low in levels[:-1]:
            first = at - at % 3
            path.append(("".join(low[first:at]), "".join(low[at + 1:first + 3])))
            at //= 3
        paths.append(path)
    return levels[-1][0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append(r)
    ordered = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in ordered:
        leaves = sorted(((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text), r) for r in groups[source]),
                        key=lambda x: x[:3])
        trees.append((leaves, *climb([x[2] for x in leaves])))
    root, tops = climb([t[1] for t in trees])
    found = []
    for (leaves, subroot, paths), top in zip(trees, tops):
        for (_, _, leaf, r), path in zip(leaves, paths):
            path = path + top
            even = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            node = leaf_of(r, r.text.replace("\n", "") if even and r.text is not None else r.text)
            for before, after in path:
                node = digest(before, node, after)
            found.append((r.doc_id, leaf, subroot, root, digest(*[b + a for b, a in path]), node, node == root))
    return found


def proofs(docs):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    changed = merkle.hashed(*[merkle.field(text if c == "text" else F.col(c)) for c in COLUMNS])
    manifest = merkle.build(docs, COLUMNS, carry={"tampered": changed})
    path = F.col("path")
    return manifest, merkle.prove(manifest, manifest.leaves, ["leaf_id", F.col("digest").alias("leaf"), "tampered"]).select(
        "leaf_id", "leaf", "subroot", "root", merkle.proof_hash(path), merkle.folded(path, F.col("tampered")),
        merkle.folded(path, F.col("tampered")) == F.col("root"))


@pytest.mark.parametrize("width", [merkle.LEVELS, 1])
def test_against_a_plain_tree(spark, monkeypatch, width):
    if width != merkle.LEVELS:  # records of one level: many steps of descent
        monkeypatch.setattr(merkle, "LEVELS", width)
        monkeypatch.setattr(merkle, "WIDTH", 3 ** width)
        monkeypatch.setattr(merkle, "_POWERS", [3 ** j for j in range(width + 1)])
    docs = documents(spark, repeated=True, odd_ids=True)
    rows = docs.collect()
    manifest, found = proofs(docs)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain(rows)))
    assert len(manifest.records) > 1 or width == merkle.LEVELS


def test_single_rows_and_empty_table(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([(7, "a\nb", None, None, 3)], [(i, f"{i}", "en", f"s{i}", 1) for i in range(4)],
                 [(1, "same", None, "s", 4)] * 5):
        docs = spark.createDataFrame(rows, schema)
        assert sorted(map(repr, map(tuple, proofs(docs)[1].collect()))) == sorted(map(repr, plain(docs.collect())))
    assert proofs(empty(spark))[1].collect() == []


def test_requests_for_some_leaves(spark):
    docs = documents(spark)
    manifest, found = proofs(docs)
    every = {r[0]: r[4] for r in found.collect()}
    some = manifest.leaves.where(F.col("leaf_id") % 9 == 0)
    got = merkle.prove(manifest, some, ["leaf_id"]).select("leaf_id", merkle.proof_hash(F.col("path")).alias("proof")).collect()
    assert {r.leaf_id: r.proof for r in got} == {k: v for k, v in every.items() if k % 9 == 0} and got
    beyond = manifest.leaves.withColumn("rank", F.col("rank") + 10**6)
    assert merkle.prove(manifest, beyond, ["leaf_id"]).collect() == []
