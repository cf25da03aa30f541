import io
import json
import threading
import urllib.request

import pytest

from quarryline.operators.ignore import PROJECT_IGNORE
from quarryline.plans import server
from quarryline.plans.workspace import Workspace
from quarryline.sources import files as source_files
from quarryline.sources import git
from quarryline.streaming import feed


@pytest.fixture
def root(tmp_path):
    at = tmp_path / "tree"
    for name, text in {
        "deck/winch.ts": "/** Turns. */\nexport function turnWinch(rope: number) {\n    return pullRope(rope);\n}\n", "deck/use.ts": 'import { turnWinch } from "./winch";\nexport function sail() { turnWinch(1); }\n',
        "notes.txt": "how to turn the winch\n", "node_modules/x.js": "x\n", "big.txt": "z" * 1100 + "\n", "skip.log": "x\n", "deck/__init__.py": "", ".gitignore": "*.log\n", "bad.dat": "a\0b",
        "deep.py": "(" * 3000,
    }.items():
        p = at / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return at


def test_tools(spark, root, tmp_path):
    w = Workspace(spark, str(root), store=str(tmp_path / "store"), clock=lambda: 1000).start()
    skipped = {r.path: r.skip_reason for r in w.files.filter("skip_reason is not null").collect()}
    assert skipped == {"big.txt": "minified", "bad.dat": "binary", "deep.py": "minified"}
    assert [f["path"] for f in w.list_files("deck/")] == ["deck/__init__.py", "deck/use.ts", "deck/winch.ts"] and "deck/use.ts" in w.files_to_index()
    found = json.loads(w.find("turnWinch"))
    assert found["spans"][0]["path"] == "deck/winch.ts" and found["spans"][0]["trust"] == "verified"
    assert "pullRope" in found["spans"][0]["text"] and found["index"]["fresh"]
    for span in found["spans"]:
        assert json.loads(w.expand(span["id"]))["span"]["path"] == span["path"]
    assert "error" in json.loads(w.expand("sp_unknown"))
    assert json.loads(w.symbol("turnWinch"))["symbols"][0]["path"] == "deck/winch.ts" and "hint" in json.loads(w.symbol("none"))
    assert [f["path"] for f in json.loads(w.outline("deck"))["files"]] == ["deck/use.ts", "deck/winch.ts"]
    assert json.loads(w.status())["files"] == 8
    assert w.graph()["edges"] == [{"source": "deck/use.ts", "target": "deck/winch.ts", "weight": 1, "kind": "imports"}]
    assert w.graph(scope="nowhere")["nodes"] == []
    assert [c["caller"] for c in w.symbol_graph("turnWinch")["callers"]] == ["sail"]
    assert w.file("deck/winch.ts")["imported_by"] == ["deck/use.ts"] and w.file("none") is None
    assert w.internals()["totals"][0]["files"] == 8
    assert w.overview()["hotspots"]

    # A stale file is shown as it is now, and is due; so is one that is gone.
    (root / "deck/winch.ts").write_text("// moved\nexport function turnCapstan() {}\n")
    stale = json.loads(w.find("turnWinch", scope="deck/winch"))
    assert {s["trust"] for s in stale["spans"]} == {"stale-refreshed"}
    assert not stale["index"]["fresh"] and stale["index"]["queue_depth"] == 1
    (root / "deck/use.ts").unlink()
    assert json.loads(w.find("sail", scope="deck/use"))["index"]["queue_depth"] == 2
    assert {(r.path, r.kind, r.priority) for r in w.jobs.collect()} == {("deck/winch.ts", "parse", 0), ("deck/use.ts", "delete", 0)}
    w.stop()

    # Stored and opened again, the queue is still there, and is drained.
    w = Workspace(spark, str(root), store=str(tmp_path / "store"), clock=lambda: 2000).start()
    assert not json.loads(w.status())["fresh"] and w.drain() == 2
    assert json.loads(w.status())["fresh"] and w.jobs.count() == 0
    assert json.loads(w.symbol("turnCapstan"))["symbols"] and not json.loads(w.symbol("sail"))["symbols"]
    assert json.loads(w.find("turnCapstan"))["spans"][0]["trust"] == "verified"


def test_a_failing_file_fails_alone(spark, root, monkeypatch):
    w = Workspace(spark, str(root), clock=lambda: 1000)
    w.cold_index()
    (root / "good.ts").write_text("export function fresh() {}\n")
    refresh = Workspace.refresh

    def broken(self, paths):
        if "notes.txt" in paths:
            raise OSError("bad disk")
        return refresh(self, paths)

    monkeypatch.setattr(Workspace, "refresh", broken)
    assert w.enqueue([("good.ts", "parse", 5), ("notes.txt", "parse", 5), ("good.ts", "parse", 1)]) == 3
    assert sorted(r.path for r in w.jobs.collect()) == ["good.ts", "notes.txt"]
    assert w.drain() == 1
    left = w.jobs.collect()
    assert [(r.path, r.state, r.last_error) for r in left] == [("notes.txt", "dead", "bad disk")] or left[0].state == "pending"
    assert json.loads(w.symbol("fresh"))["symbols"]
    for _ in range(6):
        w.drain()
    assert [(r.path, r.state, r.attempts) for r in w.jobs.collect()] == [("notes.txt", "dead", 5)]


def test_new_files_reach_the_index_by_the_stream(spark, root, tmp_path):
    w = Workspace(spark, str(root), clock=lambda: 1000)
    w.cold_index()
    feed.follow(w, str(tmp_path / "checkpoint"), drain=False)
    assert "deck/use.ts" in {r.path for r in w.jobs.collect()}  # the first time all files are new
    w.drain()
    (root / "deck" / "later.ts").write_text("export function hoistFlag() {}\n")
    feed.follow(w, str(tmp_path / "checkpoint"))
    assert w.jobs.count() == 0 and json.loads(w.symbol("hoistFlag"))["symbols"][0]["path"] == "deck/later.ts"


def test_edits_and_deletes_reach_the_queue_by_hash_trees(spark, root):
    w = Workspace(spark, str(root), clock=lambda: 1000)
    w.cold_index()
    assert w.catch_up() == 3 and {r.path for r in w.jobs.collect()} == {"big.txt", "bad.dat", "deep.py"}  # skipped ones have no known state
    w.drain()
    assert w.catch_up() == 0
    (root / "deck/winch.ts").write_text("export function turnCapstan() {}\n")
    (root / "deck/use.ts").unlink()
    (root / "hold/new").mkdir(parents=True)
    (root / "hold/new/cargo.ts").write_text("export function stow() {}\n")
    (root / "skip2.log").write_text("ignored\n")
    assert w.catch_up() == 3
    assert {(r.path, r.kind) for r in w.jobs.collect()} == {("deck/winch.ts", "parse"), ("deck/use.ts", "delete"), ("hold/new/cargo.ts", "parse")}
    assert w.drain() == 3 and w.catch_up() == 0
    names = {r.name for r in w.index["symbols"].collect()}
    assert {"turnCapstan", "stow"} <= names and not {"turnWinch", "sail"} & names


def test_server_routes_and_command_line(spark, root, tmp_path):
    out = io.StringIO()
    run = lambda *args: server.main(["--root", str(root), *args], spark=spark, out=out, home=str(tmp_path / "home"))
    assert run("init") == run("search", "turnWinch", "-n", "3") == run("symbol", "sail") == run("list") == run("doctor") == run("version") == 0
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    assert lines[0]["files"] == 8 and lines[1][0]["path"] == "deck/winch.ts" and lines[2][0]["name"] == "sail" and lines[3][0]["workspace"] == str(root) and lines[4]["indexed"]
    w = Workspace(spark, str(root), store=lines[3][0]["index"]).start()

    ask = lambda method, **params: {"jsonrpc": "2.0", "id": 1, "method": method, "params": params}
    assert [t["name"] for t in server.answer(w, ask("tools/list"))["result"]["tools"]] == ["find", "symbol", "outline", "expand", "status"]
    assert "capabilities" in server.answer(w, ask("initialize"))["result"] and server.answer(w, {"method": "notified"}) is None
    assert server.answer(w, ask("nothing"))["error"]["code"] == -32601
    for arguments, failed in (({"name": "sail"}, False), ({}, True), ({"name": 3}, True), ({"name": "a", "other": 1}, True)):
        assert server.answer(w, ask("tools/call", name="symbol", arguments=arguments))["result"]["isError"] is failed
    assert server.answer(w, ask("tools/call", name="none"))["result"]["isError"]
    sink = io.StringIO()
    server.serve_lines(w, [json.dumps(ask("ping")) + "\n", "\n", "no json\n"], sink)
    assert [("result" in x, "error" in x) for x in map(json.loads, sink.getvalue().splitlines())] == [(True, False), (False, True)]

    assert server.respond(w, "/api/search?q=turnWinch")[1]["spans"][0]["path"] == "deck/winch.ts"
    assert server.respond(w, "/api/search?q=%20")[1] == {"spans": []}
    assert server.respond(w, "/api/file?path=none") == (200, {"error": "not indexed"})
    assert server.respond(w, "/api/symbol?name=sail")[1]["matches"][0]["name"] == "sail"
    assert server.respond(w, "/api/graph?granularity=file")[1]["edges"] and server.respond(w, "/api/graph")[0] == 200
    assert server.respond(w, "/api/graph?max=many")[0] == 500 and server.respond(w, "/none")[0] == 404
    assert server.respond(w, "/api/files?prefix=deck/w")[1]["files"][0]["lang"] == "typescript"
    with server.inspector(w, port=0) as http:
        threading.Thread(target=http.serve_forever, daemon=True).start()
        with urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}/api/internals") as r:
            assert json.load(r)["totals"][0]["files"] == 8
        http.shutdown()
    assert run("forget") == 0 and json.loads(out.getvalue().splitlines()[-1])["freed"] > 0


def test_walk_and_nested_repositories(spark, root):
    rules = source_files.ignore_files(str(root))
    assert set(rules) == {".gitignore"}
    got = [r.path for r in source_files.walk(spark, str(root), ignore_files=rules).orderBy("path").collect()]
    assert got == [".gitignore", "bad.dat", "big.txt", "deck/__init__.py", "deck/use.ts", "deck/winch.ts", "deep.py", "notes.txt"]
    by_store = source_files.walk(spark, f"file://{root}", ignore_files=rules)
    assert sorted(r.path for r in by_store.collect()) == got
    assert sorted(p for p, *_ in source_files._stored_tree(spark, str(root))) == sorted([*got, "skip.log"])
    texts = {r.path: r.source for r in source_files.read_texts(spark, str(root), paths=["notes.txt", "none.txt", "node_modules/x.js"]).collect()}
    assert texts == {"notes.txt": "how to turn the winch\n"}
    assert source_files.walk(spark, str(root), limit=2).count() == 2
    (root / PROJECT_IGNORE).write_text("deck/\n")
    again = source_files.walk(spark, str(root), ignore_files=source_files.ignore_files(str(root)))
    assert "deck/use.ts" not in [r.path for r in again.collect()]
    for name in ("one", "two", ".hidden"):
        (root / name / ".git").mkdir(parents=True)
    assert source_files.nested_repos(str(root)) == ["one", "two"]
    (root / ".git").mkdir()
    assert source_files.nested_repos(str(root)) == []


def test_registry(tmp_path):
    now = [1]
    r = source_files.Registry(str(tmp_path / "r.json"), clock=lambda: now[0])
    (tmp_path / "index").mkdir()
    (tmp_path / "index" / "a.bin").write_bytes(b"12345")
    r.remember("/w", str(tmp_path / "index"))
    now[0] = 2
    r.remember("/v", "none")
    assert [e["workspace"] for e in r.list()] == ["/v", "/w"]
    assert r.forget("/w") == 5 and not (tmp_path / "index").exists()
    assert r.forget("/w") == 0 and len(r.list()) == 1


def test_git_tables(spark):
    lines = spark.createDataFrame([("M\ta.ts",), ("D\tb.ts",), ("R100\told.ts\tnew.ts",), (" M c.py",), ("?? d.py",), ("R  e.py -> f.py",), ("",)], "value string")
    got = {(r.path, r.kind) for r in git.changes(lines).collect()}
    assert got == {("a.ts", "parse"), ("b.ts", "delete"), ("old.ts", "delete"), ("new.ts", "parse"), ("c.py", "parse"), ("d.py", "parse"), ("e.py", "delete"), ("f.py", "parse")}
    log = spark.createDataFrame([("abc\x1fAnn\x1f10\x1fFix (#12)\x1fbody",)], "value string")
    c = git.commits(log).first()
    assert (c.sha, c.ts, c.pr_ref, c.body) == ("abc", 10_000, "12", "body")
    stat = spark.createDataFrame([("abc", "3\t4\ta.ts"), ("abc", "-\t-\tx.png")], "sha string, value string")
    assert {(r.path, r.churn) for r in git.file_commits(stat).collect()} == {("a.ts", 7), ("x.png", 0)}
