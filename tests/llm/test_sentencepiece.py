import hashlib
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarryline.llm import sentencepiece_codec as codec
from quarryline.llm.queries import op1_sentencepiece, tokenizer_path

MODEL = tokenizer_path()
PARTS = ["a", "b", " ", "  ", "\n", "\r", "\t", "é", "▁", "<0x0A>", "<s>", "</s>", "日本", "😀", "\0", "the", "ing", " ", "�"]


@pytest.fixture(scope="module")
def encoder():
    return codec.PieceEncoder(codec.read_model(MODEL))


def test_ids_equal_the_library(encoder):
    draw = random.Random(1)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(3000)]
    for text, packed in zip(texts, encoder.encode_batch(texts, {}), strict=True):
        assert np.frombuffer(packed, dtype="<u4").tolist() == encoder.library.encode(text), text


def test_whole_text_agenda_equals_pieces(encoder):
    text = "The quick  brown fox.\nJumps over été 日本 again and again " * 20
    assert encoder.agenda(encoder.normalise(text)) == encoder.library.encode(text)


texts_of = st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=6), st.text("aehinost ▁\n", max_size=90)), max_size=8).map("".join)


@settings(max_examples=400, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts_of)
def test_cutting_never_changes_the_ids(encoder, text):
    text = text.encode("utf-8", "replace").decode()
    pieces = encoder.pieces(text)
    assert "".join(pieces) == encoder.normalise(text)
    cut = [i for p in pieces for i in encoder.agenda(p)]
    assert cut == encoder.agenda(encoder.normalise(text)) == encoder.library.encode(text)


@settings(max_examples=400, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.one_of(st.text("aehinost▁", max_size=codec.SHORT), st.text(max_size=codec.SHORT)))
def test_both_agendas_agree(encoder, text):
    """Pieces of few symbols take a plain list, longer ones a heap."""
    text = text.encode("utf-8", "replace").decode()
    short = encoder.short_agenda(text)
    before, codec.SHORT = codec.SHORT, -1
    try:
        assert encoder.agenda(text) == short
    finally:
        codec.SHORT = before


def test_query_equals_the_library(spark, sf_dir, encoder):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = op1_sentencepiece(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        ids = encoder.library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(encoder.library.decode(ids).encode()).hexdigest()


def test_small_cache_starts_afresh(encoder, monkeypatch):
    monkeypatch.setattr(codec, "CACHE_ENTRIES", 3)
    texts = ["one two three four five six", "six five four seven"]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.encode_batch(texts, {})] == encoder.library.encode(texts)


def test_difference_raises(encoder):
    with pytest.raises(ValueError, match="differ"):
        encoder.check(["▁word"], [[5]])


def test_rows(spark, encoder):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello world", "x"), (None, "a\nb", None), (4, "w " * 60_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = codec.encode(docs, MODEL)
    got = sorted(((r.doc_id, np.frombuffer(r.ids, dtype="<u4").tolist(), r.decoded) for r in encoded.collect()), key=str)
    want = []
    for doc, text, _ in rows:
        ids = encoder.library.encode(text or "", add_bos=True, add_eos=True)
        want.append((doc, ids, encoder.library.decode(ids)))
    assert got == sorted(want, key=str)
    back = {(r.doc_id, r.text) for r in codec.decode(encoded, MODEL).collect()}
    assert (1, "Hello world") in back
    digest = codec.digests(encoded).filter("doc_id = 2").first()
    assert digest.n_tokens == 2
    assert codec.digests(codec.encode(docs.limit(0), MODEL)).count() == 0
