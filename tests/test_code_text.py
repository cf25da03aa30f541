"""Text functions against their definitions, each other and SQLite."""

import random
import re
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.functions import code_text as T

WORDS = ["tide", "Buoy", "QUAY", "x", "7", "hull2"]
JOINTS = ["", "_", "-", ".", "/", "__", "$"]


def values(spark, items, f):
    rows = spark.createDataFrame(list(enumerate(items)), "i int, x string").withColumn("y", f(F.col("x")))
    return [r.y for r in rows.orderBy("i").collect()]


def spelled(words, how):
    """One name in a convention."""
    return {
        "camel": words[0] + "".join(w.title() for w in words[1:]), "pascal": "".join(w.title() for w in words), "snake": "_".join(words), "kebab": "-".join(words),
        "loud": "_".join(words).upper(), "dotted": ".".join(words), "path": "/".join(words),
    }[how]


CONVENTIONS = ("camel", "pascal", "snake", "kebab", "loud", "dotted", "path")
plain_words = st.lists(st.text("bcdfgh", min_size=2, max_size=6), min_size=2, max_size=5)


@settings(max_examples=100, deadline=None)
@given(plain_words)
def test_conventions_share_their_words_and_their_joined_form(words):
    for how in CONVENTIONS:
        tokens = set(T.tokenize_text(spelled(words, how)))
        assert {*words, "".join(words), spelled(words, how).lower()} <= tokens, how
        assert T.normalize_text(spelled(words, how)) == "".join(words)


@settings(max_examples=100, deadline=None)
@given(st.text("XYZ", min_size=2, max_size=5), st.text("bcd", min_size=2, max_size=5))
def test_capitals_before_a_word_stay_together(capitals, word):
    assert {capitals.lower(), word} <= set(T.tokenize_text(capitals + word.title()))


def test_nothing_is_stemmed_and_short_tokens_stay():
    assert T.tokenize_text("Hulls<Q>") == ["hulls", "q"]
    assert T.tokenize_text("") == T.tokenize_text(" ()=+ ") == []


def test_arrow_and_native_forms_agree(spark):
    draw = random.Random(0)
    texts = ["", "naïve café", "__init__"] + [" ".join("".join(draw.choice(WORDS) + draw.choice(JOINTS) for _ in range(draw.randint(1, 5))) for _ in range(6)) for _ in range(60)]
    texts += ["".join(draw.choice("aBc1_.-/$ (é") for _ in range(20)) for _ in range(200)]
    assert values(spark, texts, T.tokenize) == values(spark, texts, T.tokenize_native) == [T.tokenize_text(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abAB19_.-/ $é(", max_size=30))
def test_tokens_are_distinct_and_settled(text):
    tokens = T.tokenize_text(text)
    assert len(tokens) == len(set(tokens))
    for t in tokens:
        assert t == t.lower()
        assert t in T.tokenize_text(t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(['"', "'", "*", "^", ":", "(", ")", "-", "+", "{", "}", ",", "AND", "OR", "NOT", "NEAR", "keel", "Mast_2", "\\", ";", "\0x", " "]), max_size=9).map(lambda xs: " ".join(xs)))
def test_no_query_is_a_syntax_error(query):
    """Operator characters and words of full-text queries in any order."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(body)")
    expression = T.match_expression(query)
    if expression:
        con.execute("SELECT count(*) FROM t WHERE t MATCH ?", [expression]).fetchone()


def test_stop_words_go_unless_nothing_is_left():
    assert T.query_terms("where is the anchor chain") == ["anchor", "chain"]
    assert T.query_terms("is it") == ["is", "it"]
    assert all(w in T.QUERY_STOPWORDS for w in ("where", "the", "is"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB1_.", min_size=1, max_size=8), max_size=6))
def test_identifiers_by_their_rule(words):
    want = [w.lower() for w in words if 4 <= len(w) <= 80 and (re.search("[a-z][A-Z]", w) or "_" in w or "." in w or re.fullmatch("[A-Z0-9_]+", w))]
    assert IDENTIFIERS(" (".join(words)) == list(dict.fromkeys(want))


def IDENTIFIERS(text):  # noqa: N802
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(text,)], "x string").select(T.identifiers(F.col("x")).alias("y")).first().y


@pytest.fixture(autouse=True)
def _session(spark):
    return spark


def test_identifiers_have_4_to_80_characters(spark):
    assert values(spark, ["a_b a_bc " + "k_" * 40 + " " + "k_" * 40 + "k"], T.identifiers) == [["a_bc", "k_" * 40]]


def test_full_text_words_equal_sqlite(spark):
    texts = ["Été ÉTÉ über_x-y 12a", "Ünï ñandú straße", "a.b,c"]
    con = sqlite3.connect(":memory:")
    for t, words in zip(texts, values(spark, texts, T.fts_words), strict=True):
        assert words == T.fts_words_of(t)
        con.execute("DROP TABLE IF EXISTS t")
        con.execute("CREATE VIRTUAL TABLE t USING fts5(body, tokenize='unicode61')")
        con.execute("CREATE VIRTUAL TABLE IF NOT EXISTS v USING fts5vocab(t, 'instance')")
        con.execute("INSERT INTO t VALUES (?)", [t])
        assert [r[0] for r in con.execute("SELECT term FROM v ORDER BY offset")] == words
        con.execute("DROP TABLE v")


def test_globs_equal_sqlite(spark):
    con = sqlite3.connect(":memory:")
    paths = ["keel/a.ts", "KEEL/a.ts", "keel/b/c.py", "ke[x]l/a", "kexl/a", "keel", "a^b", "ke\nl/x"]
    for scope in ("keel/", "KEEL/", "ke?l", "*/b", "ke[x]l", "ke[a-z]l", "ke[^r]", "a^", ""):
        got = values(spark, paths, lambda c, s=scope: T.in_scope(c, s))
        assert got == [bool(con.execute("SELECT ? GLOB ?", [p, scope + "*"]).fetchone()[0]) for p in paths], scope


def test_like_equals_sqlite(spark):
    con = sqlite3.connect(":memory:")
    names = ["tie_rope", "tieXrope", "TIEROPE", "a\\b", "a%b", "axb"]
    for pattern in ("%tie_rope%", "%a\\b%", "%a%b%", "%TIER%"):
        got = values(spark, names, lambda c, p=pattern: T.like(c, p))
        assert got == [bool(con.execute("SELECT ? LIKE ?", [n, pattern]).fetchone()[0]) for n in names], pattern


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab ", max_size=3), min_size=1, max_size=8), st.integers(-3, 12), st.integers(-3, 12))
def test_line_slices(lines, a, b):
    from pyspark.sql import SparkSession

    rows = SparkSession.getActiveSession().createDataFrame([("\n".join(lines),)], "x string")
    got = rows.select(T.line_slice(F.col("x"), F.lit(a), F.lit(b)).alias("y")).first().y
    assert got == "\n".join(lines[max(a, 1) - 1 : max(b, 0)])


def test_headers_and_languages(spark):
    assert values(spark, [None], lambda c: T.line_slice(c, F.lit(2), F.lit(3))) == [""]
    assert values(spark, ["deck/mast/sail.ts", "sail.ts"], lambda c: T.header(c, F.lit("typescript"))) == ["file: deck/mast/sail.ts\nmodule: mast\nlang: typescript", "file: sail.ts\nlang: typescript"]
    paths = [f"deck.old/x{e.upper() if i % 2 else e}" for i, e in enumerate(T.EXTENSIONS)] + ["Makefile", "a.txt", ".rs", "a.ts.bak"]
    want = [*T.EXTENSIONS.values(), None, None, "rust", None]
    assert values(spark, paths, T.detect_lang) == want == [T.lang_of(p) for p in paths]


def test_arrow_forms_equal_the_expressions(spark, sf_dir):
    from quarryline.operators import indexing

    every = "".join(chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000)
    assert "".join(T.fast_words(every)) == "".join(T.fts_words_of(every)) and len(T.fast_words(every)) == len(T.fts_words_of(every))
    texts = ["", "Déjà vu_Été fooBar foo.bar/BAZ_9 x-y--z $a HTTPServer ΑΣ Straße \ue000k ½ x²", "aB " * 3, "MAX_LOAD max_load 1.2.3.4 ----"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").union(spark.createDataFrame([(t,) for t in texts], "text string"))
    rows = docs.select(F.sha2("text", 256).alias("content_hash"), F.lit("file: a/bC.ts").alias("header"), F.col("text").alias("body"))
    got = indexing.fts_table(rows).select("content_hash", "body", "header", "tokens", "length")
    want = rows.select("content_hash", T.fts_words(F.col("body")).alias("body"), T.fts_words(F.col("header")).alias("header"), T.fts_words(T.token_column(F.concat_ws("\n", "header", "body"))).alias("tokens"))
    want = want.withColumn("length", F.size("body") + F.size("header") + F.size("tokens"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    pair = rows.select(F.array_sort(T.identifiers_local(F.col("body"))).alias("a"), F.array_sort(T.identifiers(F.col("body"))).alias("b"))
    assert pair.filter("a <> b").count() == 0
