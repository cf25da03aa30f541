import math
import random
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.functions import code_text as T
from quarryline.operators import indexing, retrieval
from quarryline.plans import codebase

#: Ten files of the made code base and a page of notes.
PARTS = [(k, 5 + k) for k in range(10)]
NOTES = ("notes/log.txt", "the crew swung the crane while the tide fell\n" * 3)


@pytest.fixture(scope="module")
def files(spark):
    made = codebase.code_files(spark.createDataFrame(PARTS, "p_partkey long, p_size int"))
    return made.unionByName(spark.createDataFrame([NOTES], "path string, source string")).cache()


@pytest.fixture(scope="module")
def index(spark, files):
    return {k: v.cache() for k, v in indexing.searchable(indexing.build(files)).items()}


@pytest.fixture(scope="module")
def texts(files):
    return files.withColumnRenamed("source", "text")


def found(index, query, **options):
    return [(r.path, r.symbol, list(r.matched)) for r in retrieval.search(index, query, **options).orderBy("rank").collect()]


def test_bm25_equals_sqlite(spark):
    draw = random.Random(1)
    words = ["keel", "aft_mast", "tieRopeTo", "low", "tide", "at", "LOW_TIDE_AT", "élan", "x"]
    rows = [(str(i), " ".join(draw.choice(words) for _ in range(draw.randint(3, 30))), f"file: f{i}\nlang: {draw.choice(words)}") for i in range(25)]
    chunks = spark.createDataFrame(rows, "content_hash string, body string, header string")
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(body, header, tokens, tokenize='unicode61')")
    for i, body, head in rows:
        con.execute("INSERT INTO t(rowid, body, header, tokens) VALUES (?, ?, ?, ?)", (int(i) + 1, body, head, " ".join(T.tokenize_text(f"{head}\n{body}"))))
    fts, index = indexing.fts_table(chunks).cache(), indexing.inverted(chunks)
    index = {k: v.cache() for k, v in index.items()}
    for query in ("keel", "low_tide_at", "tieRopeTo tide", "élan", "aft_mast at", "nothing here"):
        got = {int(r.content_hash) + 1: r.score for r in retrieval.bm25_postings(index["postings"], index["stats"], query).collect()}
        assert {k: pytest.approx(v) for k, v in got.items()} == {int(r.content_hash) + 1: r.score for r in retrieval.bm25(fts, query).collect()}
        want = {r[0]: -r[1] for r in con.execute("SELECT rowid, bm25(t, 1.0, 2.0, 1.5) FROM t WHERE t MATCH ?", [T.match_expression(query)])}
        assert set(got) == set(want), query
        for k, v in want.items():
            assert math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-12), query


def test_arms_and_conventions(index):
    for query in ("haul_6_0", "HAUL-6-0", "Haul60"):
        top = found(index, query)[0]
        assert top[:2] == ("d6/part_6.py", "haul_6_0") and "symbol" in top[2], query
    assert any("trigram" in m for _, _, m in found(index, "ount_hul"))
    assert all("trigram" not in m for _, _, m in found(index, "crane load words"))
    assert found(index, "") == [] and found(index, "((((") == []


def test_scope_and_limit(index):
    assert {p for p, _, _ in found(index, "crane", scope="notes/")} == {"notes/log.txt"}
    assert {p for p, _, _ in found(index, "crane", scope="d?/part_*.go")} == {"d2/part_2.go", "d0/part_7.go"}
    assert found(index, "crane", scope="NOTES/") == []
    assert len(found(index, "crane tide", limit=2)) == 2


def test_scores_are_reciprocal_ranks(index):
    rows = retrieval.search(index, "LANTERN_8").collect()
    top = max(rows, key=lambda r: r.score)
    assert set(top.matched) == {"bm25", "trigram", "symbol"} and top.path == "d1/part_8.rs"
    assert top.score == pytest.approx((1.0 + 0.7 + 1.3) / 61, abs=1e-8)


def test_live_text_and_missing_files(index, texts):
    rows = retrieval.search(index, "swing_round", texts=texts).collect()
    assert any("return swing_round(wind, slack)" in r.text for r in rows)
    gone = retrieval.search(index, "swing_round", texts=texts.limit(0)).collect()
    assert {r.text for r in gone} == {""}


def test_lookup(index):
    names = lambda *a, **k: [r.name for r in retrieval.lookup_symbol(index["symbols"], *a, **k).collect()]
    assert names("fog4") == ["fog4"] and names("FOG") == ["fog9", "fog4"]
    assert names("haul60") == [] and names("haul60", any_convention=True) == ["haul_6_0"]
    assert names("Dock", kind="class") == ["Dock0", "Dock5"] and names("Dock", kind="method") == []


def test_verify(spark, texts):
    spans = spark.createDataFrame([("a", 1, 1, "old"), ("b", 1, 1, "old"), ("c", 1, 1, "old"), ("d", 1, 1, "old")], "path string, start_line int, end_line int, text string")
    disk = spark.createDataFrame([("a", "same\nx"), ("b", "new\nx"), ("d", None)], "path string, text string")
    indexed = spark.createDataFrame([("a", "same\nx"), ("b", "was"), ("c", "was"), ("d", "was")], "path string, t string").select("path", T.short_hash(F.col("t")).alias("indexed_hash"))
    kept, jobs = retrieval.verify(spans, disk, indexed)
    assert {(r.path, r.trust, r.text) for r in kept.collect()} == {("a", "verified", "old"), ("b", "stale-refreshed", "new"), ("d", "unverified", "old")}
    assert {(r.path, r.kind, r.priority) for r in jobs.collect()} == {("b", "parse", 0), ("c", "delete", 0)}


def greedy(items, budget):
    tokens, kept, paths = 0, [], []
    for rank, path, cost in sorted(items):
        if tokens + cost > budget or (path in paths and len(paths) < 3):
            continue
        tokens += cost
        kept.append(rank)
        if path not in paths:
            paths.append(path)
    return kept, tokens


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.integers(33, 400)), min_size=1, max_size=12), st.integers(50, 900))
def test_pack_is_the_greedy_pass(spark, items, budget):
    rows = [(i + 1, p, c) for i, (p, c) in enumerate(items)]
    df = spark.createDataFrame(rows, "rank int, path string, cost int")
    r = retrieval.pack(df, budget, cost=F.col("cost")).first()
    kept, tokens = greedy(rows, budget)
    assert ([s["rank"] for s in r.spans], r.tokens, r.truncated) == (kept, tokens, len(kept) < len(rows))
    assert r.tokens <= budget


def test_fusion_does_not_depend_on_the_order_of_arms(spark):
    schema = "path string, start_line int, end_line int, symbol string, content_hash string, arm string, arm_at int, rank int"
    a = spark.createDataFrame([("x", 1, 2, None, "h", "bm25", 0, 1), ("y", 1, 2, None, "h", "bm25", 0, 2)], schema)
    b = spark.createDataFrame([("y", 1, 2, "s", None, "symbol", 2, 1), ("y", 1, 2, "t", None, "symbol", 2, 2)], schema)
    one, two = (sorted(map(str, retrieval.fuse(*arms).collect())) for arms in ((a, b), (b, a)))
    assert one == two
    top = retrieval.fuse(a, b).orderBy("rank").first()
    assert (top.path, top.symbol, top.matched) == ("y", "s", ["bm25", "symbol", "symbol"])
    assert math.isclose(top.score, 1 / 62 + 1.3 / 61 + 1.3 / 62, abs_tol=1e-8)


def test_outline_and_expand(index, texts):
    rows = retrieval.outline(index["symbols"], "d0/").orderBy("path").collect()
    assert [(r.path, [s.name for s in r.symbols][:2]) for r in rows] == [("d0/part_0.ts", ["DRAFT_0", "BEAM_0"]), ("d0/part_7.go", ["Crane7", "Lift"])]
    assert retrieval.outline(index["symbols"], "d0/part").count() == 0
    span = index["file_chunks"].filter("path = 'd4/part_4.js'").select(T.span_id(F.col("content_hash"), F.col("path"), F.col("start_line"), F.col("end_line")).alias("id"), "start_line").orderBy(F.desc("start_line")).first()
    r = retrieval.expand(index["file_chunks"], texts, span.id, 1, 99).first()
    assert (r.path, r.start_line) == ("d4/part_4.js", span.start_line - 1) and r.text.startswith("\nconst hitch4_0")
    assert retrieval.expand(index["file_chunks"], texts, "sp_none").first() is None


def test_plan_pushes_filters_down(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = docs.filter(F.col("source") == "src1").select("doc_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src1)]" in plan and "text" not in plan.rsplit("ReadSchema", 1)[1]


def levels_of(items, budget, reserve=0.2):
    """The choice of levels, span by span."""
    tokens, files, out = 0, set(), []
    order = sorted(items, key=lambda x: (x[0], x[1]))
    for i, (expanded, rank, path, full, skeleton, reference) in enumerate(order):
        room = (budget if expanded else int(budget * (1 - reserve))) - tokens
        later = sum(x[5] for x in order[i + 1 :] if x[0] == expanded)
        whole = not (path in files and len(files) < 3)
        costs = [("full", full)] * whole + [("skeleton", skeleton)] * whole
        level, cost = next(((n, c) for n, c in costs if c <= room - later), ("reference", reference) if reference <= room else (None, 0))
        if level:
            tokens += cost
            files.add(path)
            out.append((rank, path, level, cost))
    return out, tokens


def test_levels_of_detail_against_a_plain_fold(spark):
    draw = random.Random(4)
    rows = [(g, draw.random() < 0.4, r, draw.choice("abcde"), (f := draw.randint(20, 120)), f // 3 + 5, draw.randint(4, 10)) for g in range(30) for r in range(1, draw.randint(2, 12))]
    frame = spark.createDataFrame(rows, "g int, expanded boolean, rank int, path string, full int, skeleton int, reference int").repartition(3)
    for budget in (60, 200, 2000):
        got = {r.g: ([tuple(s) for s in r.spans], r.tokens, r.truncated) for r in retrieval.pack_levels(frame, budget, by=["g"]).collect()}
        for g in {r[0] for r in rows}:
            own = [r[1:] for r in rows if r[0] == g]
            kept, tokens = levels_of(own, budget)
            assert got[g] == (kept, tokens, len(kept) < len(own))
            assert tokens <= budget and sum(c for *_, c in [k for k in kept if not next(o[0] for o in own if o[1] == k[0])]) <= budget * 0.8
