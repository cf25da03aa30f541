import pytest
from pyspark.sql import functions as F

from quarryline.operators import graph, indexing, prose, retrieval, status, vectors
from quarryline.plans import queries

FILES = [
    ("quay/crane.ts", "// Lifts.\nexport class Crane {\n    lift(a: number) { return swingArm(a) + swingArm(a) + max(a); }\n}\nexport const REACH = 9;\nexport function spare() { return makeCrane(); }\n"),
    ("quay/shift.ts", 'import { Crane } from "./crane";\nimport { y } from "../tools/rope.ts";\nimport { z } from "./lost";\nexport function start() { makeCrane(); }\n'),
    ("tools/rope.ts", 'import "../quay/";\nexport const y = 1;\n'),
    ("quay/index.ts", ""),
    ("alone.py", "x = 1\n"),
]


def frame(spark, files):
    return spark.createDataFrame(files, "path string, source string")


@pytest.fixture(scope="module")
def index(spark):
    return {k: v.cache() for k, v in indexing.searchable(indexing.build(frame(spark, FILES))).items()}


def totals(index):
    return tuple(index["stats"].agg({"n": "sum", "total": "sum"}).first())


def test_rows(index):
    assert {r.name_norm for r in index["symbols"].collect()} == {"crane", "lift", "reach", "spare", "start", "y"}
    calls = [(r.src, r.dst) for r in index["edges"].filter("kind = 'calls' and path = 'quay/crane.ts'").collect()]
    assert sorted(calls) == [("lift", "swingArm"), ("spare", "makeCrane")]  # one edge for two calls; max is too common
    assert {r.precision for r in index["edges"].collect()} == {"heuristic"}
    head = index["chunks"].filter("kind = 'class'").first().header
    assert head == "file: quay/crane.ts\nmodule: quay\nsignature: class Crane\ndoc: // Lifts.\nlang: typescript"


def test_edges_come_from_one_parse(spark):
    twice = ("tools/twice.ts", 'import "./rope";\nimport "./rope";\nexport function f() { g.map(hold()); hold(); }\nhold();\n')
    edges = indexing.build(frame(spark, [*FILES, twice]))["edges"]
    assert edges._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert edges.columns == ["path", "src", "dst", "kind", "line", "precision"]
    got = sorted((r.src, r.dst, r.kind, r.line) for r in edges.filter("path = 'tools/twice.ts'").collect())
    assert got == [("", "./rope", "imports", 1), ("", "./rope", "imports", 2), ("", "hold", "calls", 4), ("f", "hold", "calls", 3)]


def test_import_edges_send_no_files_to_the_driver(spark):
    paths = ["a/x.ts", "a/b/index.ts", "a/b.js", "a/x.d.ts", "a/x", "x.ts", "a/b/index.js", "a/noext", "index.ts"]
    wanted = [("a/q.ts", d) for d in ("./x", "./b", "./b/", "./x.d", "./noext", "../x", "./lost", ".", "..", "./b/index", "./x.ts")]
    edges = spark.createDataFrame([(p, "imports", d) for p, d in wanted] + [("a/x.ts", "imports", "./x"), ("a/q.ts", "calls", "./x")], "path string, kind string, dst string")
    found = graph.import_edges(edges, spark.createDataFrame([(p,) for p in paths], "path string"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.target for r in found.filter("source = 'a/q.ts'").collect()) == sorted(["a/x.ts", "a/x", "a/b.js", "a/b/index.ts", "a/b/index.js", "a/b/index.ts", "a/b/index.js", "a/b.js", "a/x.d.ts", "a/noext", "x.ts", "a/b/index.ts", "a/b/index.js", "a/x.ts"])
    assert [r.target for r in found.filter("source = 'a/x.ts'").collect()] == ["a/x"]


def test_source_files_are_spread_over_tasks(spark, tmp_path):
    spark.range(5000).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    files = queries.source_files(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() >= 4
    assert files.count() == 5000


def test_index_is_made_without_moving_words(spark, tmp_path):
    docs = spark.range(300).selectExpr("id as doc_id", "concat('word', id, ' fooBar') as text", "'en' as lang", "'src1' as source", "12L as n_chars")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.spread_chunks(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() >= 4
    made = indexing.inverted(rows)
    plan = made["postings"].sortWithinPartitions("bucket", "term")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1  # that of the documents alone
    assert made["stats"].first().asDict() == {"n": 300, "total": rows.transform(indexing.fts_table).agg(F.sum("length")).first()[0]}


def test_update_replaces_paths_and_keeps_chunks(spark, index):
    held = lambda x: {k: v.cache() for k, v in x.items()}
    same = held(indexing.update(index, frame(spark, FILES[:1])))
    for name in index:
        assert name == "stats" or same[name].count() == index[name].count()
    assert totals(same) == totals(index)
    new = held(indexing.update(index, frame(spark, [("quay/crane.ts", "export function other() {}\n")])))
    assert [r.name for r in new["symbols"].filter("path = 'quay/crane.ts'").collect()] == ["other"]
    dead = indexing.garbage(new).count()
    assert dead > 0
    clean = held(indexing.collect_garbage(new))
    assert indexing.garbage(clean).count() == 0
    anew = indexing.searchable({k: v for k, v in clean.items() if k in ("chunks", "file_chunks", "symbols", "edges")})
    assert totals(clean) == totals(anew)  # kept up or made anew, the search tables are the same
    for name in ("postings", "idents"):
        assert sorted(map(str, clean[name].collect())) == sorted(map(str, anew[name].select(clean[name].columns).collect()))
    gone = indexing.without_paths(index, frame(spark, FILES[:1]))
    assert gone["symbols"].filter("path = 'quay/crane.ts'").count() == 0 and gone["chunks"].count() == index["chunks"].count()


def test_equal_content_is_stored_once(spark):
    text = frame(spark, [("a/x.txt", "same\n"), ("b/y.txt", "same\n")])
    out = indexing.build(text)
    assert out["chunks"].count() == 2  # the header names the path
    rows = out["chunks"].unionByName(out["chunks"])
    assert indexing.distinct_chunks(rows).count() == 2


def test_windows_by_both_plans(spark):
    docs = spark.createDataFrame([("a", "\n".join(map(str, range(250)))), ("b", ""), ("c", "\n" * 130 + "x"), ("d", None)], "path string, text string")
    want = sorted(map(tuple, indexing.line_windows(docs).collect()))
    assert sorted(map(tuple, indexing.line_windows_local(docs).collect())) == want
    assert [w[:4] for w in want] == [("a", 0, 1, 120), ("a", 1, 121, 240), ("a", 2, 241, 250), ("c", 1, 121, 131)]


def test_save_and_load(spark, index, tmp_path):
    indexing.save(index, str(tmp_path))
    again = indexing.load(spark, str(tmp_path))
    for name in index:
        assert sorted(map(str, again[name].select(index[name].columns).collect())) == sorted(map(str, index[name].collect())), name
    hits = [retrieval.search(x, "swingArm").orderBy("rank").collect() for x in (index, again)]
    assert hits[0] == hits[1] and hits[0]
    plan = again["postings"].filter(indexing.in_buckets("term", ["crane", "arm"]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("#", "") or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(term" in plan
    with pytest.raises(Exception, match="."):
        indexing.save(index | {"edges": index["edges"].withColumn("bad", F.raise_error(F.lit("broken")))}, str(tmp_path))
    assert indexing.load(spark, str(tmp_path))["edges"].count() == index["edges"].count()  # a write that fails changes nothing
    spark.createDataFrame([("schema_version", "1")], "key string, value string").write.mode("overwrite").parquet(f"{tmp_path}/current")
    with pytest.raises(ValueError, match="schema version 1"):
        indexing.load(spark, str(tmp_path))


def test_import_graph(spark, index):
    files = frame(spark, FILES)
    pairs = graph.import_edges(index["edges"], files)
    assert {tuple(r) for r in pairs.collect()} == {("quay/shift.ts", "quay/crane.ts"), ("quay/shift.ts", "tools/rope.ts"), ("tools/rope.ts", "quay/index.ts")}
    nodes = spark.createDataFrame([(p, 1) for p, _ in FILES], "id string, weight int")
    g = graph.link_graph(pairs, nodes)
    assert [r.id for r in g["isolated"].collect()] == ["alone.py"] and g["nodes"].count() == 4
    by_module = graph.link_graph(pairs, nodes, depth=1)
    assert {(r.source, r.target) for r in by_module["edges"].collect()} == {("quay", "tools"), ("tools", "quay")}
    assert graph.link_graph(pairs, nodes, max_nodes=1)["nodes"].count() == 1
    assert {r.caller for r in graph.callers(index["edges"], "makeCrane").collect()} == {"spare", "start"}
    assert [r.callee for r in graph.callees(index["edges"], "lift").collect()] == ["swingArm"]
    detail = graph.file_detail(index, files, "quay/crane.ts").first()
    assert detail.imported_by == ["quay/shift.ts"] and detail.imports == [] and len(detail.symbols) == 4
    assert graph.file_detail(index, files, "none").first() is None
    ranks = {r.id: r.rank for r in graph.pagerank(g["edges"], nodes, rounds=12).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["quay/crane.ts"] > ranks["quay/shift.ts"]


def test_status_of_nothing(spark):
    files = spark.createDataFrame([], "indexed_hash string, parse_state string, lang string")
    one = spark.createDataFrame([], "state string")
    r = status.status(files, one, one, one).first()
    assert (r.files, r.coverage, r.fresh) == (0, 0.0, True)


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [-1.0, 0.0]), (4, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for int8 in (False, True):
        assert [r.vec_id for r in vectors.top_k(df, [1.0, 0.0], 3, int8=int8).collect()] == [0, 1, 2]


def test_prose(spark):
    docs = spark.createDataFrame([("a", "intro\n# One\ntext\n## Two\nmore\n\n")], "path string, text string")
    assert [(r.ord, r.heading) for r in prose.heading_chunks(docs).orderBy("ord").collect()] == [(0, None), (1, "One"), (2, "Two")]
    text = "see #12 and ENG-45: TODO https://x.org/a #12"
    refs = {(r.kind, r.ref, r.n) for r in prose.references(spark.createDataFrame([(1, text)], "id int, text string"), "id").collect()}
    assert refs == {("issue", "#12", 2), ("ticket", "ENG-45", 1), ("todo", "TODO", 1), ("link", "https://x.org/a", 1)}
    secret = spark.createDataFrame([("key AKIA" + "A" * 16 + ' password = "hunter2hunter2" end',)], "t string").select(prose.redacted(F.col("t")).alias("t")).first().t
    assert secret == "key [redacted:aws-key] [redacted:assigned] end"


@pytest.mark.parametrize("parts", [1, 7, 20])
def test_near_ties_go_by_id_however_rows_lie(spark, parts):
    """Scores that agree to six digits are ties, in one batch or in many."""
    rows = [(i, [1.0 + i * 1e-9, 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts, "vec_id")
    assert [r.vec_id for r in vectors.top_k(df, [1.0, 0.0], 3).collect()] == [0, 1, 2]
    each = vectors.top_k_each(df, df.filter("vec_id = 5"), 3).orderBy("rank").collect()
    assert [(r.query_id, r.id) for r in each] == [(5, 0), (5, 1), (5, 2)]


def test_chunks_are_named_where_files_are_parsed(spark):
    source = "// Winds.\nexport class Winch {\n  pull(n: number) {\n    return haul(n);\n  }\n}\n\n\n\nexport const A = 1; export const BB = 2;\n"
    index = indexing.build(spark.createDataFrame([("d/a.ts", source)], "path string, source string"))
    plan = index["file_chunks"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan  # symbols meet chunks without a shuffle
    got = {r.kind: (r.header, r.body) for r in index["chunks"].collect()}
    assert got["class"][0].split("\n")[1:4] == ["module: d", "signature: class Winch", "doc: // Winds."] and got["class"][1].startswith("export class Winch")
    assert "signature: const BB = 2" in got["constant"][0]  # of several, the last by line and name
