import random

import pytest

from quarryline.llm import substring_dedup


def brute(rows, window):
    first, docs = {}, sorted(((substring_dedup.NULL_ID if d is None else d, (t or "").encode().split()) for d, t in rows), key=lambda x: x[0])
    for d, w in docs:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, w in docs:
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] != (d, i) for j in range(i, i + window)}
        out.append((None if d == substring_dedup.NULL_ID else d, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=str)


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = ["a", "b", "c", "dd", "é", "x"]
    base = [draw.choice(vocabulary) for _ in range(60)]
    rows = [(3, None), (1000, ""), (None, "\t \n"), (1001, " ".join(base)), (1001, " ".join(base)), (1002, "w " * 5000)]
    for d in range(40):
        k = draw.randint(0, 50)
        words = [draw.choice(vocabulary) for _ in range(draw.randint(0, 9))] + base[k : k + draw.randint(1, 40)] + [draw.choice(vocabulary)] * draw.randint(0, 30)
        rows.append((d * 7 % 41 + 10, "\n".join(words) if draw.random() < 0.2 else " ".join(words)))
    return rows


@pytest.mark.parametrize(("chunk", "window"), [(3 << 20, 20), (200, 20), (1, 7), (50, 2)])
def test_against_brute_force(spark, chunk, window):
    rows = corpus(window)
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, kind int").repartition(5)
    got = substring_dedup.remove_repeats(docs, window=window, chunk_bytes=chunk).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows, window)
    for r in got:
        assert sum(r.removed[1::2]) - sum(r.removed[::2]) == r.n_removed


def test_empty(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bad_window(spark):
    with pytest.raises(ValueError, match="two words"):
        substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), window=1)


def thue_morse(n, flip):
    return "".join("ab"[(bin(i).count("1") + flip) & 1] for i in range(n))


def test_texts_on_which_polynomial_hashes_collide(spark):
    """A Thue-Morse word and its complement agree in every polynomial modulo
    2**64, whatever its base."""
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(i, f"{thue_morse(1024, i % 2)} {tail}" + f" end{i}" * (i > 1)) for i in range(6)]
    layout = substring_dedup.Layout([t.encode() for _, t in rows[:2]])
    h = layout.hashes(layout.windows(20), 20, 1)
    assert h[0] == h[1]  # else this tests nothing
    for chunk in (1, 1 << 20):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = substring_dedup.remove_repeats(docs, chunk_bytes=chunk).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows, 20)
        assert {r.doc_id: r.n_removed for r in got}[1] == 0


def test_classes_hold_where_every_hash_is_equal():
    class Liar(substring_dedup.Layout):
        def hashes(self, at, size, seed):
            return super().hashes(at, size, seed) & 1

    draw = random.Random(2)
    texts = [" ".join(draw.choice("abc") for _ in range(30)).encode() for _ in range(20)]
    layout = Liar(texts)
    at = layout.windows(4)
    words = [layout.text(i, i + 3) for i in at]
    first = {}
    for i, w in enumerate(words):
        first.setdefault(w, i)
    assert substring_dedup.equal_before(layout, at, 4).tolist() == [first[w] for w in words]


@pytest.mark.parametrize("remembered", [1, 100_000])
def test_a_passage_in_every_document(spark, monkeypatch, remembered):
    """One hot passage at different places, a long text, and ids in no order."""
    monkeypatch.setattr(substring_dedup, "REMEMBERED", remembered)
    draw = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(draw.randrange(1 << 40) - (1 << 39), " ".join(f"u{d}_{i}" for i in range(draw.randint(0, 30))) + " " + passage + f" z{d}") for d in range(300)]
    rows += [(7, " ".join(str(i % 997) for i in range(20_000))), (8, "long" * 100_000), (-(1 << 63), passage), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup.remove_repeats(docs, chunk_bytes=2000).collect()
    named = [((substring_dedup.NULL_ID if r.doc_id is None else r.doc_id), r.n_words, r.n_removed, r.kept) for r in got]
    want = [((substring_dedup.NULL_ID if d is None else d), *rest) for d, *rest in brute(rows, 20)]
    assert sorted(named) == sorted(want)
    assert sum(r.doc_id is None for r in got) == 1
