"""The pipeline against plain Python, stage by stage, on the rows of the stage before."""

import public_tokenizers
import pytest

import corpus_pipeline as cp
from postlab.llm import bpe, langid
from postlab.session import stored
from tests.llm import plain_mix
from tests.llm.fixture import documents, empty
from tests.llm.test_jaccard_join import brute, shingles

SMALL = "doc_id long, text string, lang string, source string, n_chars long"


def plain(docs):
    """(doc_id, text) of every row that the pipeline ends with; the fitted language model is the only thing taken over."""
    model = langid.fit(docs)
    rows = [r for r in docs.select("doc_id", "text", "source", "lang").collect()]
    letters = {r.doc_id for r in docs.where(langid.has_letter(docs["text"])).collect()}
    judged = langid._judge(model, [r.text if r.doc_id in letters else None for r in rows])[2]
    rows = [r for r, rejected in zip(rows, judged) if not rejected]
    last = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        last[r.text or ""] = r
    rows = list(last.values())
    groups = brute({r.doc_id: shingles(r.text, cp.SHINGLE) for r in rows}, cp.PERCENT)
    rows = [(r.doc_id, r.doc_id, r.source, r.text) for r in rows if groups[r.doc_id][1] == r.doc_id]
    return plain_mix.used_texts(rows)


@pytest.mark.parametrize("given", ["fixture", "table"])
def test_run(spark, sf, tmp_path, given):
    docs = documents(spark, seed=3) if given == "fixture" else spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = cp.run(spark, str(tmp_path)).collect()
    with open(public_tokenizers.path(cp.RANKS), "rb") as file:
        coder = bpe.encoder(file.read(), public_tokenizers.PATTERN)
    want = sorted((doc_id, bpe.encode_text(coder, text)) for doc_id, text in plain(docs))
    assert sorted((r.doc_id, bytes(r.ids)) for r in rows) == want
    assert all(r.round_trip and r.n_tokens * 4 == len(r.ids) for r in rows)


def test_stages_keep_the_columns(spark, sf):
    docs = documents(spark, repeated=True, odd_ids=True)
    for name, stage in cp.STAGES[:-1]:
        out = stored(stage(spark, docs, sf))
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        assert 0 < out.count(), name
        docs = out
    assert cp.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_empty_documents(spark, sf):
    docs = empty(spark)
    for _, stage in cp.STAGES:
        docs = stored(stage(spark, docs, sf))
        assert docs.count() == 0
