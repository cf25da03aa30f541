import pytest
from pyspark.sql import functions as F

from quarryline.operators import context, indexing, retrieval

FILES = [
    ("net/dial.ts", 'import { pick } from "../lib/pick";\n\n// Dials.\nexport function dialOut(n: number) {\n  return pickLine(n);\n}\nexport function hangUp() {\n  cutLine();\n}\n'),
    ("lib/pick.ts", "export function pickLine(n: number) {\n  return n;\n}\nfunction cutLine() {\n  return 0;\n}\n"),
    ("app/main.py", "def run(x):\n    dialOut(x)\n    return hangUp()\n"),
    ("notes.txt", "nothing\n"),
]


@pytest.fixture(scope="module")
def index(spark):
    return {k: v.cache() for k, v in indexing.build(spark.createDataFrame(FILES, "path string, source string")).items()}


@pytest.mark.parametrize(("query", "intent", "names", "paths", "literals"), [
    ("where is the crane", "locate", [], [], []), ("how does liftLoad work in `net/dial.ts`", "explain", ["liftLoad", "net/dial.ts"], ["net/dial.ts"], ["net/dial.ts"]),
    ("what breaks if I change tie_rope", "impact", ["tie_rope"], [], []), ("why ERR_NO_TIDE", "history", [], [], ["ERR_NO_TIDE"]), ("", None, [], [], []),
    ('find "no berth left" lib/*/x', "locate", ["no berth left"], ["lib/*/x"], ["no berth left"]),
])
def test_queries_are_understood(query, intent, names, paths, literals):
    got = context.understand(query)
    assert (got.intent, got.identifiers, got.paths, got.literals) == (intent, names, paths, literals)
    assert set(got.weights) == set(retrieval.ARM_WEIGHTS) and all(w > 0 for w in got.weights.values())


def test_weights_shift_the_fusion(spark, index):
    plain = retrieval.search(index, "dialOut").collect()
    shifted = retrieval.search(index, "dialOut", weights=context.understand("who calls dialOut").weights).collect()
    assert {r.path for r in plain} == {r.path for r in shifted}
    assert max(r.score for r in shifted) > max(r.score for r in plain)


def test_precise_edges_supersede_those_of_their_file(spark, index):
    precise = spark.createDataFrame([("app/main.py", "run", "dialOut", "calls", 2, "precise")], index["edges"].select("path", "src", "dst", "kind", "line", "precision").schema)
    got = context.supersede(index["edges"].select("path", "src", "dst", "kind", "line", "precision"), precise)
    assert [tuple(r) for r in got.filter("path = 'app/main.py'").collect()] == [("app/main.py", "run", "dialOut", "calls", 2, "precise")]
    assert got.filter("path <> 'app/main.py'").count() == index["edges"].filter("path <> 'app/main.py'").count()
    assert [(r.name, r.precision) for r in context.references(got, "dialOut").collect()] == [("run", "precise")]
    assert {r.name for r in context.references(got, "hangUp", "callees").collect()} == {"cutLine"}
    with pytest.raises(ValueError, match="relation"):
        context.references(got, "x", "friends")


def test_related_code(spark, index):
    anchors = spark.createDataFrame([("net/dial.ts", 4, 6, 1)], "path string, start_line int, end_line int, rank int")
    got = context.related(index, anchors).orderBy("rank").collect()
    assert [(r.path, r.symbol, r.relation) for r in got] == [("lib/pick.ts", "pickLine", "callee"), ("app/main.py", "run", "caller"), ("net/dial.ts", "hangUp", "sibling")]
    few = context.related(index, anchors.unionByName(spark.createDataFrame([("net/dial.ts", 7, 9, 2)], anchors.schema)), per_anchor=1)
    assert few.filter("relation = 'sibling'").count() == 0  # both stand in anchors
    texts = spark.createDataFrame(FILES, "path string, text string")
    one, two = context.pack_related(retrieval.with_text(anchors, texts), retrieval.with_text(few, texts), 150)
    assert one.first().tokens + two.first().tokens <= 150 and two.first().tokens <= 60


def test_skeletons(index):
    got = {r.path: r.text for r in context.skeletons(index).collect()}
    assert got["net/dial.ts"] == "import ../lib/pick\n// Dials.\nfunction dialOut(n: number) { … 2 lines }\nfunction hangUp() { … 2 lines }"
    assert set(got) == {"net/dial.ts", "lib/pick.ts", "app/main.py"}


def test_history(spark):
    commits = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "sha string, ts long")
    files = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "x", 2), ("b", "y", 1), ("b", "z", 1), ("c", "z", 1), ("c", "y", 1)], "sha string, path string, churn int")
    got = context.history(commits, files, "x")
    assert [r.sha for r in got["commits"].collect()] == ["a", "b"]
    assert [(r.path, r.commits) for r in got["with"].collect()] == [("y", 2), ("z", 1)]


def test_visible_spans(spark):
    spans = spark.createDataFrame([("a/b/c",), ("a/bc",), ("a/b",), ("d",)], "path string")
    rules = spark.createDataFrame([("a/b", "ann"), ("a/b", "bob"), ("d", "bob")], "prefix string, reader string")
    seen = lambda who: {r.path for r in context.visible(spans, rules, who).collect()}
    assert seen("ann") == {"a/b/c", "a/b", "a/bc"} and seen("bob") == {"a/b/c", "a/b", "a/bc", "d"} and seen("eve") == {"a/bc"}


def test_priors(spark):
    rows = spark.createDataFrame([(1.0, 0, 0.5, "src/a.ts"), (1.0, 0, 0.5, "tests/a.ts"), (1.0, -(10**12), 0.0, "src/b.ts")], "score double, modified long, central double, path string")
    ranked = lambda q: [r[0] for r in rows.select(context.freshened(F.col("score"), modified=F.col("modified"), now=1000, centrality=F.col("central"), path=F.col("path"), query=q)).collect()]
    a, b, c = ranked("dial")
    assert a > c > b and ranked("dial test")[1] == a
