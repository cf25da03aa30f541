import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarryline.llm import packing
from quarryline.llm.packing import Example, Limits, Packer
from quarryline.llm.queries import op13_packing, tokenizer_path

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    found.encode_special_tokens = True
    return found


def check(rows, ids_of, limits, key):
    """Every id in one piece, sequences without gaps and within all limits, and
    nothing padded: full, or a power of two."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(key(r), []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids_of)
    for k, pieces in by_doc.items():
        at, ids = 0, b""
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and len(r["ids"]) == 4 * r["length"]
            assert r["doc_tokens"] == len(ids_of[k])
            at += r["length"]
            ids += bytes(r["ids"])
        assert np.frombuffer(ids, dtype="<u4").tolist() == ids_of[k]
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(r["loss_tokens"] for r in pieces) <= limits.loss
        assert at == limits.tokens or at & (at - 1) == 0
    return by_sequence


def test_whole_texts_in_full_sequences(spark, library):
    draw = random.Random(5)
    words = ["Über", "don't", "they're", "naïve", "x1y22", "日本語", "🙂", "...", "hello", "<|endoftext|>", "éte", "a b", "tab\tnew\nline"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.choice([1, 5, 40, 300, 900]))) for _ in range(150)]
    texts += ["", None, "   ", "\n\t", "word " * 20_000, "x" * 50_000, " ́mark", "same", "same"]
    frame = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)], SCHEMA + ", ids string, start int").repartition(3)
    rows = packing.pack(frame, tokenizer_path("word_bpe_49k.json")).collect()
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    sequences = check(rows, want, Limits(), lambda r: r["doc_id"])
    total = sum(map(len, want.values()))
    assert len(sequences) <= total // 2048 + 3 * 12  # beside full ones, a few of each task


def test_query_over_a_whole_table(spark, sf_dir, library):
    got = op13_packing(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id for r in got} == set(docs)
    import zlib

    for r in got:
        ids = np.array([*library.encode(docs[r.doc_id], add_special_tokens=False).ids, 1], dtype="<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_limits_of_instruction_data(spark, library):
    """Prompts bear no loss; loss and segments are limited with the tokens."""
    limits = Limits(tokens=256, segments=4, loss=100)
    draw = random.Random(8)
    rows = [(i, " ".join("word" for _ in range(draw.choice([1, 9, 60, 130, 700]))), draw.choice([0, 5, 50, 2000, None, -3])) for i in range(200)]
    frame = spark.createDataFrame(rows, SCHEMA + ", prompt long").repartition(2)
    got = packing.pack(frame, tokenizer_path("word_bpe_49k.json"), limits=limits, prompt_tokens=F.col("prompt")).collect()
    want = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t, _ in rows}
    check(got, want, limits, lambda r: r["doc_id"])
    prompts = {i: max(p or 0, 0) for i, _, p in rows}
    for r in got:
        assert r.loss_tokens == sum(at >= prompts[r.doc_id] for at in range(r.start, r.start + r.length))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(0, 90)), max_size=60), st.integers(1, 40), st.integers(1, 6), st.integers(1, 40))
def test_any_sizes_and_limits(sizes, tokens, segments, loss):
    limits = Limits(tokens, segments, loss)
    packer = Packer(limits)
    sequences = []
    for i, (n, prompt) in enumerate(sizes):
        sequences += packer.add(Example(i, np.arange(n, dtype="<u4").tobytes(), n, min(prompt, n)))
    sequences += packer.rest()
    rows, at_most = [], 0
    for s, pieces in enumerate(sequences):
        at = 0
        for p in pieces:
            n = p.end - p.start
            rows.append({"doc": p.example.row, "start": p.start, "length": n, "ids": p.example.ids[4 * p.start : 4 * p.end], "loss_tokens": p.loss(n), "doc_tokens": p.example.tokens, "sequence_id": s, "offset": at})
            at += n
        at_most = max(at_most, at)
    check(rows, {i: list(range(n)) for i, (n, _) in enumerate(sizes)}, limits, lambda r: r["doc"])


def test_heuristic_takes_the_largest_dot_product():
    """A short piece that fills the scarce loss goes first, then the longest
    that fits, and what is left takes a part of the longest of the rest."""
    packer = Packer(Limits(tokens=100, segments=10, loss=10))
    for row, (n, prompt) in enumerate([(30, 30), (60, 60), (12, 2), (40, 40)]):
        assert list(packer.add(Example(row, bytes(4 * n), n, prompt))) == []
    assert [(p.example.row, p.end - p.start) for p in packer.sequence()] == [(2, 12), (1, 60), (3, 28)]


def test_words_that_the_library_reads_otherwise(library):
    """Letters whose lower case is no letter, marks, signs and long words, all
    in one part."""
    with open(tokenizer_path("word_bpe_49k.json")) as f:
        encoder = packing.WordEncoder(f.read(), True)
    assert encoder.lower and encoder.cut_signs and encoder.ends.any()
    for text in ["İstanbul abc ǅ ﬃ Ⅷ ª", "a.b,c ab., ab.. x.'s it's 'S don'T! ab!? É. é, ß; ab\u0301. ab .", "ſ ΑΣ ς ÅNGSTRÖM K 1a a1 \u0301a ab\u00a0cd \x1cab\x1d", "w" * 5000 + " Word WORD word. WORD, word:"]:
        assert encoder.encode([text, text.upper(), ""]) == encoder.plain([text, text.upper(), ""])


def test_empty_table_and_wrong_tokenizer(spark):
    path = tokenizer_path("word_bpe_49k.json")
    assert packing.pack(spark.createDataFrame([], SCHEMA), path).collect() == []
    with pytest.raises(ValueError):
        Limits(tokens=0)
    frame = spark.createDataFrame([(1, "two words")], SCHEMA)
    byte_level = tokenizer_path("byte_bpe_50k.json")  # its pieces hold the space before a word
    with pytest.raises(Exception, match="split_words=False"):
        packing.pack(frame, byte_level).collect()
    rows = packing.pack(frame, byte_level, split_words=False).collect()
    assert sum(r.length for r in rows) == len(Tokenizer.from_file(byte_level).encode("two words").ids) + 1
