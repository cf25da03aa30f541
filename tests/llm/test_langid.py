from collections import Counter

import numpy as np
import pytest

from quarryline.llm import langid
from quarryline.llm.queries import op5_language_id

TEXTS = {"en": "the cat and the dog were in the house with the other cats", "de": "der Hund und die Katze waren in dem Haus mit den anderen Katzen", "fr": "le chat et le chien étaient dans la maison avec les autres chats"}


def grams(text):
    words, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    out = Counter()
    for w in words:
        padded = "\0" + w + "\0"
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if g.strip("\0"):
                    out[g] += 1
    return out


def decode(code):
    code = int(code)
    if code < 0:
        code += 1 << 63
        return "".join(chr(code >> s & 0x1FFFFF) for s in (42, 21, 0))
    if code >> 62:
        code -= 1 << 62
        return chr(code >> 21) + chr(code & 0x1FFFFF)
    return chr(code)


@pytest.mark.parametrize("text", ["", "  12 ", "a", "Ab,cd  e", "été\nÜber 日本 x1y", "the the the"])
def test_codes_are_the_ngrams_of_words(text):
    codes, n = np.unique(langid.gram_codes(text), return_counts=True)
    assert {decode(c): k for c, k in zip(codes, n, strict=True)} == dict(grams(text))


def brute_profiles(rows, length):
    total = {}
    for t, lang in rows:
        if t is not None and lang is not None:
            total.setdefault(lang, Counter()).update(langid.gram_codes(t).tolist())
    return {x: [g for g, _ in sorted(c.items(), key=lambda p: (-p[1], p[0]))[:length]] for x, c in total.items() if c}


def test_profiles_and_predictions_against_brute_force(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(TEXTS.items())] + [(10, None, "en"), (11, "den Hund", None), (12, "!!!", "zz"), (13, "", "en"), (14, "the " * 30_000, "en")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string").repartition(3)
    profiles = langid.train(docs, length=50)
    want = brute_profiles([r[1:] for r in rows], 50)
    assert {k: v.tolist() for k, v in profiles.items()} == want
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, profiles, length=50).collect()}
    for i, t, _ in rows:
        counts = Counter(langid.gram_codes(t or "").tolist())
        own = [g for g, _ in sorted(counts.items(), key=lambda p: (-p[1], p[0]))[:50]]
        if not own:
            assert got[i] == ("und", 0.0)
            continue
        distance = {x: sum(abs(p.index(g) - k) if g in p else 50 for k, g in enumerate(own)) for x, p in want.items()}
        best = min(sorted(distance), key=distance.get)
        assert got[i] == (best, pytest.approx(1 - distance[best] / (50 * len(own))))


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    profiles = langid.train(docs)
    assert profiles == {}
    assert langid.identify(docs, profiles).first().lang_pred == "und"
    assert langid.identify(docs.limit(0), profiles).count() == 0


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = op5_language_id(spark, sf_dir).filter("held_out")
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98


def test_equal_distances_go_to_the_first_language(spark):
    rows = [(i, "one two three", lang) for i, lang in enumerate(["zz", "aa", "mm", "aa"])] + [(9, "one", None), (10, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, langid.train(docs)).collect()}
    assert {v[0] for k, v in got.items() if k < 10} == {"aa"} and got[10] == ("und", 0.0)
