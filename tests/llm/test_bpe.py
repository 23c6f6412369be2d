"""Encoding against the library on whole texts, decoding as an exact round trip."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postlab.llm import bpe
from tests.llm.fixture import documents, empty

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as file:
        return bpe.encoder(file.read(), PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(
    ["a", "Ab", "'s", "'", "ll", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "漢", "字", "。", "!", "?!", "\u00a0", "\u3000", "́", "и", "½", "\x00",
     "ա", "<|endoftext|>"])).map("".join), st.integers(1, 5))
def test_parts_do_not_change_the_ids(coder, text, size):
    assert "".join(bpe.parts(text, size)) == text
    whole = coder.encode_ordinary(text)
    assert [i for p in bpe.parts(text, size) for i in coder.encode_ordinary(p)] == whole


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "'s", "'", " ", "  ", "\n", "1", "é", "漢", "!", "x" * 30, " " * 30]), max_size=40).map("".join),
       st.integers(1, 20))
def test_long_pieces_are_cut_at_matches(coder, text, longest):
    assert [i for ids in bpe.piece_ids(coder, text, longest) for i in ids] == coder.encode_ordinary(text)


@pytest.mark.parametrize("times", [1_000_000, 3_000_000])
@pytest.mark.parametrize("unit", [" ", "\n", "x", "漢", "!", "7"])
def test_very_long_runs(coder, unit, times):
    found = bpe.encode_text(coder, unit * times + "a end.")
    assert bpe.decode_ids(coder, found) == (unit * times + "a end.").encode()
    short = bpe.encode_text(coder, unit * 200_000 + "a end.")
    if unit.isspace():  # the last blank before a letter is a match of its own
        assert found[-16:] == short[-16:]
    few = coder.encode_ordinary(unit * 4096)
    assert found[:4 * len(few) // 2] == b"".join(i.to_bytes(4, "little") for i in few)[:4 * len(few) // 2]


def test_tables(spark, coder):
    docs = documents(spark, repeated=True, odd_ids=True)
    coded = bpe.encode(docs, RANKS, PATTERN, part_chars=50, verify=True)
    assert coded.columns == ["doc_id", "n_tokens", "ids", "round_trip"]
    rows = bpe.decode(coded, RANKS, PATTERN, keep_ids=True).collect()
    assert all(r.round_trip for r in rows)

    def packed(text):
        return b"".join(i.to_bytes(4, "little") for i in coder.encode_ordinary(text))

    want = sorted(((r.doc_id, packed(r.text or ""), (r.text or "").encode()) for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in rows), key=repr) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in rows)
    assert bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).columns == ["doc_id", "n_tokens", "decoded"]


def test_ids_may_cut_a_character(spark, coder):
    ids = [i for i in coder.encode_ordinary("漢字") if True][:1]
    packed = b"".join(i.to_bytes(4, "little") for i in ids)
    table = spark.createDataFrame([(1, packed), (2, None)], "doc_id long, ids binary")
    found = {r.doc_id: bytes(r.decoded) for r in bpe.decode(table, RANKS, PATTERN).collect()}
    assert found == {1: "漢字".encode()[:len(found[1])], 2: b""} and found[1]


def test_empty_table_and_large_rank_file(spark, monkeypatch):
    assert bpe.encode(empty(spark), RANKS, PATTERN).collect() == []
    monkeypatch.setattr(bpe, "MAX_RANK_BYTES", 10)
    with pytest.raises(ValueError):
        bpe.encode(empty(spark), RANKS, PATTERN)


def test_query_digests(spark, sf, coder):
    from postlab.llm.queries import op2_bpe

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = coder.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(),
            hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
