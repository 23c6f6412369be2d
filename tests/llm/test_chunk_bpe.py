"""Chunk reuse against the tokenizers library on whole texts."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postlab.llm import chunk_bpe
from tests.llm.fixture import documents, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "'", "'s", "'ll", "l", "é", "漢", "1", "<|endoftext|>", "<|endo", "ftext|>", "hello", " ",
         "!", "|", "ա", "\x85", "　"]


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as file:
        return chunk_bpe.Coder(file.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def packed(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=120).map("".join), st.lists(st.floats(0, 1), max_size=6), st.data())
def test_joins_are_repaired(own, library, text, cuts, data):
    chunk_bpe.HEAD, chunk_bpe.PIECE = 4, 40
    try:
        cuts = sorted({0, len(text), *(int(c * len(text)) for c in cuts)})
        shared = [(a, b, *own.chunk(text[a:b])) for a, b in zip(cuts, cuts[1:]) if data.draw(st.booleans())]
        assert own.join(text, shared) == packed(library, text)
    finally:
        chunk_bpe.HEAD, chunk_bpe.PIECE = 48, 1 << 14


def test_plain_characters_are_the_same_for_both_encoders(own, library):
    assert own.fast is not None
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or not chunk_bpe.PLAIN.fullmatch(chr(c)):
            continue
        text = f"a{chr(c)}1{chr(c)} {chr(c)}a {chr(c)}{chr(c)}\n{chr(c)}!'{chr(c)}s"
        assert library.encode(text, add_special_tokens=False).ids == own.fast.encode_ordinary(text), hex(c)


@pytest.mark.parametrize("unit, times", [
    (" ", 1_000_000), ("\n", 1_000_000), ("x", 1_000_000), ("漢", 400_000), ("word ", 100_000), ("!", 600_000), ("a\n \n", 90_000)])
def test_very_long_texts(own, library, unit, times):
    text = "start " + unit * times + "a end"
    assert own.join(text, []) == packed(library, text)


def test_cuts_follow_the_content():
    rng = random.Random(3)
    common = "".join(rng.choices("abcdefgh éß漢 ", k=30_000))
    texts = [common, "x" * 777 + common, None, "", "é" * 20_000, common[500:]]
    data, cuts = chunk_bpe.cut_points(pa.array(["skip", *texts], pa.string()).slice(1))
    sizes = [[b - a for a, b in zip(c, c[1:])] for c in cuts]
    assert [sum(s) for s in sizes] == [len((t or "").encode()) for t in texts]
    assert all(s <= chunk_bpe.MOST for row in sizes for s in row)
    assert all(s >= chunk_bpe.LEAST for row in sizes[:2] for s in row[:-1])
    chunks = [{data[a:b] for a, b in zip(c, c[1:])} for c in cuts]
    for other in (1, 5):
        assert len(chunks[0] & chunks[other]) >= len(chunks[0]) - 3
    for row in chunks:
        for chunk in row:
            chunk.decode()  # no character is cut


def test_tables(spark, library):
    docs = documents(spark, repeated=True, odd_ids=True)
    rng = random.Random(5)
    passage = " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(2000))
    extra = [(10_000 + i, passage[:rng.randrange(300)] + "'s <|endoftext|> " + passage, "en", "a", 1) for i in range(20)]
    more = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more, allowMissingColumns=True)
    coded = chunk_bpe.encode(docs, PATH)
    assert coded.columns == ["doc_id", "n_tokens", "ids"]
    rows = coded.collect()
    want = sorted(((r.doc_id, packed(library, r.text or "")) for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, bytes(r.ids)) for r in rows), key=repr) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in rows)
    decoded = chunk_bpe.decode(coded, PATH).collect()
    assert sorted(((r.doc_id, r.decoded) for r in decoded), key=repr) == sorted(
        ((r.doc_id, r.text or "") for r in docs.collect()), key=repr)


def test_shared_chunks_are_encoded_once_and_used(spark, monkeypatch):
    rng = random.Random(6)
    passage = " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(3000))
    docs = spark.createDataFrame([(i, f"{i} " + passage) for i in range(8)], "doc_id long, text string")
    rows = chunk_bpe.numbered(docs.withColumnRenamed("doc_id", "id"), "id", "text")
    places = chunk_bpe._chunk_digests(rows.select(chunk_bpe.ROW, "text"))
    found = [r.digests for r in places.collect()]
    shared = set.intersection(*map(set, found))
    assert len(shared) > 5 and all(len(set(f) - shared) <= 2 for f in found)
    bloom = chunk_bpe.bloom_filter(spark.createDataFrame([(d,) for d in shared], "digest binary"), len(shared))
    assert bloom.hits([bytes(d) for d in shared]).all()
    with open(PATH, "rb") as file:
        model = spark.sparkContext.broadcast(file.read())
    table = chunk_bpe._shared_chunks(rows, model, spark.sparkContext.broadcast(bloom)).collect()
    keys = [bytes(r.digest) for r in table]
    assert len(keys) == len(set(keys)) and {bytes(d) for d in shared} <= set(keys)


def test_filter_without_room_gives_the_same(spark, library, monkeypatch):
    monkeypatch.setattr(chunk_bpe, "BLOOM_BITS", 1024)
    docs = documents(spark, repeated=True)
    rows = chunk_bpe.encode(docs, PATH).collect()
    assert sorted((r.doc_id, bytes(r.ids)) for r in rows) == sorted(
        (r.doc_id, packed(library, r.text or "")) for r in docs.collect())


def test_odd_ids_and_empty_table(spark, library, monkeypatch):
    table = spark.createDataFrame([(1, None), (2, np.array([30585], "<u4").tobytes())], "doc_id long, ids binary")
    assert {r.doc_id: r.decoded for r in chunk_bpe.decode(table, PATH).collect()} == {
        1: "", 2: library.decode([30585], skip_special_tokens=False)}
    assert chunk_bpe.encode(empty(spark), PATH).collect() == []
    monkeypatch.setattr(chunk_bpe, "MAX_MODEL_BYTES", 10)
    with pytest.raises(ValueError):
        chunk_bpe.encode(empty(spark), PATH)


def test_query_digests(spark, sf, library):
    from postlab.llm.queries import op12_chunk_bpe

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op12_chunk_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = packed(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
