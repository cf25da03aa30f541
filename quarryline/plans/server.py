"""The tools over a wire: JSON-RPC on lines, HTTP on the loopback, a command line."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from quarryline.operators.retrieval import lookup_symbol
from quarryline.plans.workspace import Workspace
from quarryline.sources.files import Registry

VERSION = "2"
# The port of the inspector, and how many hits its search gives.
PORT, HITS = 4319, 30

_STRING, _NUMBER = {"type": "string"}, {"type": "integer"}
#: Tools by name: what they do, their parameters, those that must be given.
TOOLS = {
    "find": ("Spans of code for words or an exact name, packed to a token budget.", {"query": _STRING, "scope": _STRING, "max_tokens": _NUMBER}, ["query"]),
    "symbol": ("Definitions of a symbol, exact names first.", {"name": _STRING, "kind": _STRING}, ["name"]),
    "outline": ("Symbols of a file or of the files below a folder.", {"path": _STRING}, ["path"]),
    "expand": ("More lines around a span.", {"span_id": _STRING, "before": _NUMBER, "after": _NUMBER}, ["span_id"]),
    "status": ("What is indexed and what waits.", {}, []),
}
_KINDS = {"string": str, "integer": int}


def call(workspace: Workspace, name: str, arguments: dict) -> str:
    """A tool's answer as JSON; wrong calls raise ``ValueError``."""
    if name not in TOOLS:
        raise ValueError(f"unknown tool {name}")
    _, parameters, required = TOOLS[name]
    missing = [k for k in required if k not in arguments]
    wrong = [k for k, v in arguments.items() if k not in parameters or not isinstance(v, _KINDS[parameters[k]["type"]]) or isinstance(v, bool)]
    if missing or wrong:
        raise ValueError(f"{name}: " + "; ".join([*(f"{k} is missing" for k in missing), *(f"{k} does not fit" for k in wrong)]))
    return getattr(workspace, name)(**arguments)


def answer(workspace: Workspace, request: dict) -> dict | None:
    """One JSON-RPC request; notifications have no answer."""
    if "id" not in request:
        return None
    out = {"jsonrpc": "2.0", "id": request["id"]}
    method, params = request.get("method"), request.get("params") or {}
    if method == "initialize":
        return out | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "quarryline", "version": VERSION}}}
    if method == "ping":
        return out | {"result": {}}
    if method == "tools/list":
        return out | {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}}
    if method != "tools/call":
        return out | {"error": {"code": -32601, "message": f"unknown method {method}"}}
    try:
        text, failed = call(workspace, params.get("name", ""), params.get("arguments") or {}), False
    except Exception as e:  # noqa: BLE001 - a tool that fails answers so
        text, failed = json.dumps({"error": str(e)}), True
    return out | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}


def serve_lines(workspace: Workspace, source, sink) -> None:
    """Requests line by line until the source ends."""
    for line in source:
        if not line.strip():
            continue
        try:
            reply = answer(workspace, json.loads(line))
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        if reply is not None:
            sink.write(json.dumps(reply) + "\n")
            sink.flush()


def _symbol(w: Workspace, q: dict) -> dict:
    name = q.get("name", "")
    return w.symbol_graph(name) | {"matches": [r.asDict() for r in lookup_symbol(w.index["symbols"], name, limit=HITS).collect()]}


#: Routes of the inspector: each takes the workspace and the query's parameters.
ROUTES: dict[str, Callable[[Workspace, dict], object]] = {
    "/api/overview": lambda w, q: w.overview(),
    "/api/graph": lambda w, q: w.graph(depth=None if q.get("granularity") == "file" else int(q.get("depth", 2)), max_nodes=int(q.get("max", 250)), scope=q.get("scope")),
    "/api/internals": lambda w, q: w.internals(),
    "/api/search": lambda w, q: {"spans": w.search(q["q"], limit=HITS) if q.get("q", "").strip() else []},
    "/api/file": lambda w, q: w.file(q.get("path", "")) or {"error": "not indexed"},
    "/api/symbol": _symbol,
    "/api/files": lambda w, q: {"files": w.list_files(q.get("prefix", ""))},
}


def respond(workspace: Workspace, url: str) -> tuple[int, dict]:
    """Status and body of a GET."""
    at = urlsplit(url)
    route = ROUTES.get(at.path)
    if route is None:
        return 404, {"error": "not found"}
    try:
        return 200, route(workspace, {k: v[-1] for k, v in parse_qs(at.query, keep_blank_values=True).items()})
    except Exception as e:  # noqa: BLE001 - a route that fails answers so
        return 500, {"error": str(e)}


def inspector(workspace: Workspace, port: int = PORT, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """An HTTP server, not yet running; on the loopback, as the index holds the
    source."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            code, body = respond(workspace, self.path)
            data = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main(argv: list[str] | None = None, spark=None, out=sys.stdout, home: str | None = None) -> int:
    parser = argparse.ArgumentParser("quarryline")
    parser.add_argument("--root", default=".")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("init", "mcp", "serve", "status", "list", "forget", "doctor", "version"):
        commands.add_parser(name)
    for name in ("search", "symbol"):
        sub = commands.add_parser(name)
        sub.add_argument("words", nargs="+")
        sub.add_argument("-n", "--limit", type=int, default=10)
    args = parser.parse_args(argv)
    say = lambda x: print(x if isinstance(x, str) else json.dumps(x, default=str), file=out)
    root, base = str(Path(args.root).resolve()), Path(home or Path.home() / ".quarryline")
    registry, store = Registry(str(base / "workspaces.json")), str(base / "index" / Path(root).as_posix().strip("/").replace("/", "-"))
    if args.command == "version":
        say(VERSION)
        return 0
    if args.command == "list":
        say(registry.list())
        return 0
    if args.command == "forget":
        say({"freed": registry.forget(root)})
        return 0
    if spark is None:
        from quarryline.session import local_session

        spark = local_session(8)
    if args.command == "doctor":
        say({"spark": spark.version, "root": root, "indexed": Path(store, "current").exists()})
        return 0
    workspace = Workspace(spark, root, store=store)
    if args.command == "init":
        workspace.cold_index()
        workspace.save()
    else:
        workspace.start()
    registry.remember(root, store)
    if args.command == "search":
        say(workspace.search(" ".join(args.words), limit=args.limit))
    elif args.command == "symbol":
        say([r.asDict() for r in lookup_symbol(workspace.index["symbols"], " ".join(args.words), limit=args.limit).collect()])
    elif args.command in ("init", "status"):
        say(workspace.status())
    elif args.command == "mcp":
        serve_lines(workspace, sys.stdin, out)
    elif args.command == "serve":
        with inspector(workspace) as server:
            server.serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
