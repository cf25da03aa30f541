import pytest
from pyspark.sql import functions as F

from quarryline.operators import ignore


def reasons(spark, paths, files=None):
    rows = spark.createDataFrame(list(enumerate(paths)), "i int, path string").withColumn("r", ignore.skip_reason(F.col("path"), files))
    return [r.r for r in rows.orderBy("i").collect()]


def test_path_rules(spark):
    paths = ["", "src/a.ts", "a/node_modules/b.js", "target", "x.swp", ".#a", "#a#", "4913", "a~", "A.MIN.JS", "logo.PNG", "yarn.lock", "docs/a.md", "dist.ts"]
    denied, temp, ending = "denied-directory", "temp-file", "denied-extension"
    assert reasons(spark, paths) == [denied, None, denied, denied, temp, temp, temp, temp, temp, ending, ending, ending, None, None]


def test_nested_ignore_files_deepest_opinion_wins(spark):
    files = {".gitignore": "*.log\nbuild2/\n/top.txt\n# note\n\n", "app/.gitignore": "!keep.log\ngen/**\n", "app/" + ignore.PROJECT_IGNORE: "secret?.md\n"}
    paths = ["a.log", "app/keep.log", "app/other.log", "build2/x.ts", "src/build2/x.ts", "build2", "top.txt", "app/top.txt", "app/gen/a/b.ts", "app/secret1.md", "app/secret.md", "../a.log"]
    git = "gitignored"
    assert reasons(spark, paths, files) == [git, None, git, git, git, None, git, None, git, "projectignored", None, None]


@pytest.mark.parametrize(("pattern", "path", "want"), [
    ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("**/b", "x/b", True), ("a/*", "a/x/y", True), ("a/*.ts", "a/x/y.ts", None), ("[ab].ts", "b.ts", True), ("[!ab].ts", "b.ts", None),
    ("\\#x", "#x", True), ("x\\ ", "x ", True), ("foo", "a/foo/b", True), ("!foo", "foo", False), ("foo/", "foo", None),
])
def test_patterns(pattern, path, want):
    assert ignore.IgnoreFile([pattern]).opinion(path) is want


def test_content_rules(spark):
    texts = ["fine\n" * 10, "x" * (1024 * 1024 + 1), "a\0b", "// @generated\n", "# do not edit\n", "code generated by x\n", "y" * 501, "y" * 500, "a" * 9000 + "\0\n" * 100]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("r", ignore.content_reason(F.col("t")))
    assert [r.r for r in rows.orderBy("i").collect()] == [None, "too-large", "binary", "generated", "generated", None, "minified", None, None]


def test_directories():
    assert ignore.should_skip_directory("node_modules") and not ignore.should_skip_directory("src")


def test_built_in_form_agrees(spark):
    import random

    draw = random.Random(0)
    name = lambda: draw.choice(["a", "b", "ab", "x.log", "gen", ""])
    for _ in range(6):
        rule = lambda: draw.choice(["", "!", "", ""]) + draw.choice(["", "/", "**/", "a/"]) + draw.choice(["a", "*", "a*", "?", "gen", "*.log", "a/**", "**/b", "a.b", "(a", "+"]) + draw.choice(["", "/"])
        files = {d + n: "\n".join(rule() for _ in range(3)) for d in ("", "a/", "a/b/", "gen/") for n in (".gitignore", ignore.PROJECT_IGNORE) if draw.random() < 0.7}
        paths = list({"/".join(filter(None, (name() for _ in range(draw.randint(1, 4))))) or "a" for _ in range(80)} | {"../a", "a.b", "(a", "+"})
        rules = ignore.IgnoreRules(files)
        rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", rules.reason_of(F.col("path")).alias("r"))
        assert {r.path: r.r for r in rows.collect()} == {p: rules.reason(p) for p in paths}, files
    assert "Python" in spark.range(1).select(ignore.ignored_reason({".gitignore": "[ab].ts"})(F.lit("a.ts")))._jdf.queryExecution().toString()
