"""Symbols, imports, calls and chunks of source files.

Python goes through ``ast``.  TypeScript, JavaScript, Go and Rust go through a
pushdown scanner (``lexer``), which blanks what is no code and pairs the
brackets; definitions are then patterns on the masked text.  A file that
does not parse still gives what was found, with ``has_errors`` set.  A file
that breaks the parser itself (nesting beyond any stack) is cut into windows of
lines and marked the same way, so no file can fail another.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections import deque
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.code_text import lang_of
from quarryline.operators.lexer import scan

# Limits of chunks and signatures.
MAX_CHUNK_LINES, SMALL_LINES, MERGE_GAP, MAX_MERGED_LINES, SIGNATURE_CHARS = 120, 3, 2, 40, 400
# Kinds that always stand alone.
CONTAINERS = frozenset({"class", "struct", "interface", "impl", "module", "enum"})

PARTS = {
    "symbols": "struct<name string, kind string, signature string, doc string, parent string, start_line int, end_line int, exported boolean>",
    "imports": "struct<specifier string, line int>",
    "calls": "struct<name string, line int, caller string>",
    "chunks": "struct<start_line int, end_line int, symbol string, kind string, signature string, doc string, parent string, body string>",
}


@dataclass
class Symbol:
    name: str
    kind: str
    signature: str
    doc: str | None
    parent: str | None
    start_line: int
    end_line: int
    exported: bool

    def row(self) -> tuple:
        return (self.name, self.kind, self.signature, self.doc, self.parent, self.start_line, self.end_line, self.exported)


@dataclass
class Parsed:
    lang: str
    has_errors: bool = False
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[tuple[str, int]] = field(default_factory=list)
    calls: list[tuple[str, int, str | None]] = field(default_factory=list)
    chunks: list[tuple[int, int, str | None]] = field(default_factory=list)


def _signature(text: str) -> str:
    return " ".join(text[:SIGNATURE_CHARS].split())


# Python


class _Python(ast.NodeVisitor):
    def __init__(self, source: str, out: Parsed):
        self.out, self.lines, self.classes, self.functions = out, source.split("\n"), [], []
        self.source = source

    def _define(self, node, kind: str) -> None:
        body = node.body[0]
        head = self.lines[node.lineno - 1][node.col_offset :]
        if node.end_lineno > node.lineno:
            head = "\n".join([head, *self.lines[node.lineno : max(node.lineno, body.lineno - 1)]])
        # The declaration ends at the colon before its body.
        end = _python_colon(head)
        doc = self._comments(min([node.lineno, *(d.lineno for d in node.decorator_list)]))
        if doc is None and isinstance(body, ast.Expr) and isinstance(body.value, ast.Constant) and isinstance(body.value.value, str):
            doc = ast.get_source_segment(self.source, body.value)
        parent = self.classes[-1] if self.classes else None
        self.out.symbols.append(Symbol(node.name, kind, _signature(head[:end]), doc, parent, node.lineno, node.end_lineno, not node.name.startswith("_")))

    def _comments(self, line: int) -> str | None:
        found = []
        at = line - 2
        while at >= 0 and self.lines[at].lstrip().startswith("#"):
            found.insert(0, self.lines[at].strip())
            at -= 1
        return "\n".join(found) or None

    def visit_FunctionDef(self, node) -> None:
        self._define(node, "function")
        for d in node.decorator_list:  # they stand outside the function
            self.visit(d)
        self.functions.append(node.name)
        for name, value in ast.iter_fields(node):
            if name != "decorator_list":
                for part in value if isinstance(value, list) else [value]:
                    if isinstance(part, ast.AST):
                        self.visit(part)
        self.functions.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node) -> None:
        self._define(node, "class")
        self.classes.append(node.name)
        self.generic_visit(node)
        self.classes.pop()

    def visit_Import(self, node) -> None:
        self.out.imports += [(a.name, node.lineno) for a in node.names if a.asname is None]

    def visit_ImportFrom(self, node) -> None:
        if node.module and not node.level:
            self.out.imports.append((node.module, node.lineno))

    def visit_Call(self, node) -> None:
        f = node.func
        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
        if name:
            line = f.end_lineno or node.lineno
            self.out.calls.append((name, line, self.functions[-1] if self.functions else None))
        self.generic_visit(node)


def _python_colon(head: str) -> int:
    depth = 0
    for i, c in enumerate(head):
        depth += (c in "([{") - (c in ")]}")
        if c == ":" and depth == 0:
            return i + 1
    return len(head)


def _parse_python(source: str, out: Parsed) -> None:
    lines = source.split("\n")
    for cut in (len(lines), *range(len(lines) - 1, 0, -max(1, len(lines) // 20))):
        try:
            tree = ast.parse("\n".join(lines[:cut]))
        except (SyntaxError, ValueError):
            out.has_errors = True  # keep what stands before the damage
            continue
        _Python("\n".join(lines[:cut]), out).visit(tree)
        return


# Languages with braces


class _Masked:
    """A scanned source, its lines and the comments above a place."""

    def __init__(self, source: str, lang: str):
        found = scan(source, lang)
        self.source, self.code, self.comments = source, found.code, found.comments
        self.close, self.errors = found.close, found.errors
        self.line_starts = [0, *(m.end() for m in re.finditer("\n", source))]

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.line_starts, at)

    def doc(self, start: int) -> str | None:
        """The comments that end right above: at most one line end between."""
        found, boundary, at = [], start, bisect.bisect_left(self.comments, (start, 0)) - 1
        while at >= 0:
            a, b = self.comments[at]
            above = self.visible(boundary, self.source)
            if above != b or self.source.count("\n", b, boundary) > 1:
                break
            found.append(self.source[a:b])
            boundary, at = a, at - 1
        return "\n".join(reversed(found)) or None

    def visible(self, at: int, text: str | None = None) -> int:
        """Where the last character before ``at`` that is no white space ends."""
        text = self.code if text is None else text
        while at > 0 and text[at - 1].isspace():
            at -= 1
        return at

    def body(self, start: int, stop: str = ";") -> tuple[int, int]:
        """Where a declaration's body opens (its end, if it has none) and where
        the declaration ends.  Parentheses and brackets are stepped over."""
        at = start
        while at < len(self.code):
            c = self.code[at]
            if c == "{":
                return at, self.close.get(at, len(self.code) - 1)
            if c in "([":
                at = self.close.get(at, len(self.code) - 1)
            elif c in stop:
                return at, at
            at += 1
        return len(self.code), len(self.code) - 1


_NAME = r"[A-Za-z_$][\w$]*"
# Words that look like calls before a parenthesis and are none.
_KEYWORDS = frozenset((
    "pub", "if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "new", "super", "import", "constructor", "func", "go",
    "defer", "select", "range", "fn", "match", "loop", "unsafe", "move", "in", "as", "where", "impl", "struct", "enum", "trait", "let", "const", "var",
    "else", "do", "throw", "async", "delete", "void", "yield", "of", "case", "sizeof", "make",
))
_TS_DEFS = re.compile(
    # No place is tried but those with the first word of a definition.
    rf"(?=\b(?:export|declare|async|function|abstract|class|interface|type|const|enum|let))"
    rf"(?P<export>\bexport\s+(?:default\s+)?)?(?P<node>\b(?:declare\s+)?(?:"
    rf"(?:async\s+)?function\s*\*?\s*(?P<function>{_NAME})\s*(?=[<(])"
    rf"|(?:abstract\s+)?class\s+(?P<class>{_NAME})"
    rf"|interface\s+(?P<interface>{_NAME})"
    rf"|type\s+(?P<type>{_NAME})\s*(?:<[^=;]*?>)?\s*="
    rf"|(?:const\s+)?enum\s+(?P<enum>{_NAME})"
    rf"|(?:const|let)\s+(?P<constant>{_NAME})\s*(?::[^=;]*?)?=(?!=)))"
)
_TS_METHOD = re.compile(rf"(?<![\w$.])(?P<node>(?:(?:public|private|protected|static|abstract|override|readonly|async|get|set)\s+)*\*?\s*#?(?P<name>{_NAME})\s*(?:<[^()]*?>)?(?=\())")
_ARROW = re.compile(rf"\s*(?:async\s*)?(?:function\b|(?:<[^()]*?>)?\(|{_NAME}\s*=>)")
_TS_IMPORT = re.compile(r"\bimport\b[^;\"'`]*?([\"'])")
_GO_DEFS = re.compile(
    rf"^(?P<node>func\s+(?P<function>{_NAME})\s*(?=[\[(])|func\s*\([^)]*\)\s*(?P<method>{_NAME})\s*(?=\()|type\s+(?P<type>{_NAME})\b|const\s+(?P<constant>{_NAME})\b|(?P<group>type|const|import)\s*\()", re.M
)
_RUST_DEFS = re.compile(
    rf"(?=pub|default|async|unsafe|const|extern|fn|struct|enum|trait|mod|static)"
    rf"(?P<node>(?:\bpub(?:\([^)]*\))?\s+)?(?:(?:default|async|unsafe|const|extern(?:\s*\"[^\"]*\")?)\s+)*\b(?:fn\s+(?P<function>{_NAME})|struct\s+(?P<struct>{_NAME})|enum\s+(?P<enum>{_NAME})"
    rf"|trait\s+(?P<interface>{_NAME})|mod\s+(?P<module>{_NAME})|const\s+(?P<constant>{_NAME})\s*:|static\s+(?:mut\s+)?(?P<static>{_NAME})\s*:))"
)
_WORD = re.compile(r"[\w$#]+")
_MACRO = re.compile(r"\w!\s*[(\[{]")
_GO_INTERFACE = re.compile(r"\binterface\s*\{")
_CALL = re.compile(rf"(?<![\w$])(?P<name>{_NAME})\s*(?:::<[^()]*?>|<[\w$,\s\[\]|.]*>)?\(")


@dataclass
class _Span:
    start: int
    end: int
    name: str
    container: bool
    function: bool


def _parse_braces(source: str, lang: str, out: Parsed, with_calls: bool = True) -> None:
    m = _Masked(source, lang)
    out.has_errors = m.errors
    spans: list[_Span] = []
    names: set[int] = set()

    def add(kind: str, name: str, name_at: int, start: int, body: int, end: int, anchor: int, exported: bool, container=False, function=False) -> None:
        names.add(name_at)
        spans.append(_Span(start, end, name, container, function))
        cut = min(body, end + 1)
        text = source[start:cut]
        out.symbols.append(Symbol(name, kind, _signature(text), m.doc(anchor), None, m.line(start), m.line(end), exported))

    if lang in ("typescript", "tsx", "javascript"):
        classes = []
        for d in _TS_DEFS.finditer(m.code):
            kind = d.lastgroup if d.lastgroup not in ("node", "export") else next(k for k in ("function", "class", "interface", "type", "enum", "constant") if d[k])
            if lang == "javascript" and kind in ("interface", "type", "enum"):
                continue
            name, start, anchor = d[kind], d.start("node"), d.start("export") if d["export"] else d.start("node")
            function = kind == "function"
            if kind in ("constant", "type"):
                body, end = len(source), _statement_end(m, d.end())
                if kind == "constant" and _ARROW.match(m.code, d.end()) and _is_function(m, d.end(), end):
                    kind = "function"
            else:
                body, end = m.body(d.end())
            add(kind, name, d.start("constant" if d["constant"] else kind), start, body, end, anchor, bool(d["export"]), kind == "class", function)
            if kind == "class":
                classes.append((body, end))
        for body, end in classes:
            at = body + 1
            while at < end:
                c = m.code[at]
                if c in "{([":
                    at = m.close.get(at, end) + 1
                    continue
                d = _TS_METHOD.match(m.code, at) if c.isalpha() or c in "_$#*" else None
                if d and d["name"] not in ("if", "for", "while", "switch"):
                    opens, stop = m.body(d.end(), ";}")
                    if opens < end and m.code[opens] in "{;":
                        add("method", d["name"], d.start("name"), d.start("node"), opens, stop, d.start("node"), False, False, m.code[opens] == "{")
                        at = stop + 1
                        continue
                if c.isalnum() or c in "_$#":
                    at = _WORD.match(m.code, at).end()
                else:
                    at += 1
        for d in _TS_IMPORT.finditer(m.code):
            a = d.start(1)
            b = source.find(source[a], a + 1)
            out.imports.append((source[a + 1 : b], m.line(a)))
    elif lang == "go":
        for d in _GO_DEFS.finditer(m.code):
            if d["group"]:
                opens = d.end() - 1
                close = m.close.get(opens, len(source))
                for spec in re.compile(rf"^[ \t]*(?P<name>{_NAME})", re.M).finditer(m.code, opens + 1, close) if d["group"] != "import" else ():
                    if spec.start("name") in names or any(s.start < spec.start("name") < s.end for s in spans):
                        continue
                    stop = m.code.find("\n", spec.end())
                    brace = m.code.find("{", spec.end(), stop if stop > 0 else len(source))
                    end = m.close.get(brace, close) if brace > 0 else (stop if stop > 0 else close)
                    kind = "type" if d["group"] == "type" else "constant"
                    add(kind, spec["name"], spec.start("name"), d.start("node"), len(source), max(end, close) if kind == "type" else end, spec.start("name"), spec["name"][0].isupper(), kind == "type")
                    if kind == "constant":
                        out.symbols[-1].start_line = m.line(spec.start("name"))
                continue
            kind = next(k for k in ("function", "method", "type", "constant") if d[k])
            if kind in ("function", "method"):
                body, end = m.body(d.end(), "\n")
            else:
                stop = m.code.find("\n", d.end())
                stop = stop if stop > 0 else len(source)
                brace = m.code.find("{", d.end(), stop)
                body, end = len(source), m.close.get(brace, stop) if brace > 0 else stop - 1
            add(kind, d[kind], d.start(kind), d.start("node"), body, end, d.start("node"), "A" <= d[kind][0] <= "Z", kind == "type", kind in ("function", "method"))
        for block in re.finditer(r"^import\s*(?:[\w.]+\s+)?(\(|\")", m.code, re.M):
            a = block.start(1)
            b = m.close.get(a, len(source)) if source[a] == "(" else m.code.find("\n", a) % (len(source) + 1)
            out.imports += [(q[1], m.line(a + q.start())) for q in re.finditer(r'"([^"\n]*)"', source[a : b + 1])]
    else:
        for d in _RUST_DEFS.finditer(m.code):
            kind = next(k for k in ("function", "struct", "enum", "interface", "module", "constant", "static") if d[k])
            if kind in ("constant", "static"):
                body, end = len(source), m.body(d.end(), ";")[1]
                end = max(end, m.code.find(";", d.end()))
            else:
                body, end = m.body(d.end(), ";")
            name, name_at = d[kind], d.start(kind)
            kind = "constant" if kind == "static" else kind
            add(kind, name, name_at, d.start("node"), body, end, d.start("node"), d["node"].startswith("pub "), kind == "module", kind == "function")
        for d in re.finditer(rf"\buse\s+((?:{_NAME}::)*{_NAME})\s*;", m.code):
            out.imports.append((d[1], m.line(d.start(1))))

    for i, inner in zip(*_innermost([(s.start, s.end) for s in spans], [s if s.container else None for s in spans]), strict=True):
        out.symbols[i].parent = inner and inner.name
    if not with_calls:
        return
    calls, quiet = [], 0
    # What stands inside macros and declared types looks like calls and is none.
    opened = {"rust": _MACRO, "go": _GO_INTERFACE}.get(lang)
    silent = [(d.end() - 1, m.close.get(d.end() - 1, 0)) for d in opened.finditer(m.code)] if opened else []
    if lang != "go":
        declared = ("struct", "enum") if lang == "rust" else ("interface", "type")
        silent += [(span.start, span.end) for span, symbol in zip(spans, out.symbols, strict=True) if symbol.kind in declared]
    silent = deque(sorted(silent))
    for c in _CALL.finditer(m.code):
        at = c.start("name")
        end = m.visible(at)
        while silent and silent[0][0] < at:
            quiet = max(quiet, silent.popleft()[1])
        if at < quiet or (lang == "rust" and (m.code[max(0, end - 2) : end] == "::" or "<" in m.code[c.end("name") : c.end()])):
            continue
        if c["name"] in _KEYWORDS or at in names or _DEFINES.search(m.code, max(0, end - 12), end) or m.code[c.end("name") : c.end("name") + 1] == "!":
            continue
        calls.append((at, c["name"]))
    functions = [s for s in spans if s.function]
    marks = [None] * len(calls)
    places = [(at, at) for at, _ in calls] + [(f.start, f.end) for f in functions]
    for i, inner in zip(*_innermost(places, marks + functions), strict=True):
        if i < len(calls):
            at, name = calls[i]
            out.calls.append((name, m.line(at), inner and inner.name))


_DEFINES = re.compile(r"\b(?:new|function|fn|func)\Z")


def _innermost(places: list[tuple[int, int]], owners: list) -> tuple[list[int], list]:
    """For each place (start, end), in order of start: its number and the
    innermost owner around it that is not its own.  One pass with a stack."""
    order = sorted(range(len(places)), key=lambda i: (places[i][0], -places[i][1], owners[i] is None))
    stack: list[tuple[int, object]] = []
    found = []
    for i in order:
        start, end = places[i]
        while stack and stack[-1][0] < start:
            stack.pop()
        found.append(next((o for stop, o in reversed(stack) if stop >= end), None))
        if owners[i] is not None:
            stack.append((end, owners[i]))
    return order, found


_GOES_ON = re.compile(r"\s*[.?:&|+*/]")


def _statement_end(m: _Masked, at: int) -> int:
    """End of ``const x = ...``: its semicolon, or a line end where no operator waits."""
    while at < len(m.code):
        c = m.code[at]
        if c in "{([" or at in m.close:
            at = m.close.get(at, len(m.code) - 1)
        elif c == ";":
            return at
        elif c in ")}]":
            return at - 1
        elif c == "\n" and m.code[max(0, m.visible(at) - 1)] not in "=+-*/%&|?:,<>(" and not _GOES_ON.match(m.code, at):
            return at - 1
        at += 1
    return len(m.code) - 1


def _is_function(m: _Masked, at: int, end: int) -> bool:
    text = m.code[at:end]
    if re.match(r"\s*(?:async\s+)?function\b", text):
        return True
    opens = m.code.find("(", at, end)
    if opens >= 0 and re.fullmatch(r"\s*(?:async\s*)?(?:<[^()]*?>)?", m.code[at:opens]):
        return bool(re.match(r"\)\s*(?::[^=;{]*(?:\{[^}]*\})?[^=;{]*)?=>", m.code[m.close.get(opens, end) : end + 2]))
    return bool(re.match(rf"\s*(?:async\s+)?{_NAME}\s*=>", text))


# Chunks


def _deduplicate(symbols: list[Symbol]) -> list[Symbol]:
    best: dict[tuple, Symbol] = {}
    for s in symbols:
        old = best.get((s.name, s.start_line))
        if old is None or (old.kind == "constant" and s.kind != "constant"):
            best[s.name, s.start_line] = s
    return sorted(best.values(), key=lambda s: s.start_line)


def _windows(first: int, last: int, symbol: str | None = None) -> Iterator[tuple[int, int, str | None]]:
    for a in range(first, last + 1, MAX_CHUNK_LINES):
        yield a, min(a + MAX_CHUNK_LINES - 1, last), symbol


def chunk_lines(symbols: list[Symbol], source: str) -> list[tuple[int, int, str | None]]:
    """Chunks that cover every line with content: one for each outermost
    symbol, small neighbours merged, long ones split, gaps filled."""
    lines = source.split("\n")
    if not symbols:
        return [(1, len(lines), None)]
    inside, reach = set(), 0
    for a, b in sorted({(s.start_line, s.end_line) for s in symbols}, key=lambda x: (x[0], -x[1])):
        if b <= reach:
            inside.add((a, b))
        reach = max(reach, b)
    outer = [s for s in symbols if (s.start_line, s.end_line) not in inside]
    groups: list[list] = []  # first line, last line, names, small
    for s in outer:
        size = s.end_line - s.start_line + 1
        small = size <= SMALL_LINES and s.kind not in CONTAINERS
        last = groups[-1] if groups else None
        if last and last[3] and small and s.start_line - last[1] <= MERGE_GAP + 1 and s.end_line - last[0] < MAX_MERGED_LINES:
            last[1] = s.end_line
            last[2].append(s.name)
        else:
            groups.append([s.start_line, s.end_line, [s.name], small])
    chunks = [c for first, end, names, _ in groups for c in _windows(first, end, ", ".join(names))]

    def blank(a: int, b: int) -> bool:
        return not any(x.strip() for x in lines[a - 1 : b])

    out, at = [], 1
    for chunk in [*sorted(chunks, key=lambda c: c[0]), (len(lines) + 1, 0, None)]:
        out += [c for c in _windows(at, chunk[0] - 1) if not blank(c[0], c[1])]
        if chunk[1]:
            out.append(chunk)
        at = max(at, chunk[1] + 1)
    return out


def parse_source(source: str, path: str, parts: Collection[str] = PARTS) -> Parsed | None:
    """Everything found in one file; null for languages without a parser.  With
    ``parts`` calls and chunks may be left out, and the rest is the same."""
    lang = lang_of(path)
    if lang is None:
        return None
    out = Parsed(lang)
    try:
        if lang == "python":
            _parse_python(source, out)
        else:
            _parse_braces(source, lang, out, "calls" in parts)
        out.symbols = _deduplicate(out.symbols)
        if "chunks" in parts:
            out.chunks = chunk_lines(out.symbols, source)
    except (RecursionError, MemoryError, IndexError, ValueError):
        out = Parsed(lang, has_errors=True, chunks=list(_windows(1, source.count("\n") + 1)))
    return out


def _chunk_rows(p: Parsed, source: str) -> list[tuple]:
    """Chunks with their text, and with the last symbol that starts on their
    first line, which names them."""
    at: dict[int, Symbol] = {}
    for s in p.symbols:
        old = at.get(s.start_line)
        if old is None or (old.end_line, old.name) < (s.end_line, s.name):
            at[s.start_line] = s
    lines, rows = source.split("\n"), []
    for a, b, symbol in p.chunks:
        s = at.get(a)
        rows.append((a, b, symbol, *((s.kind, s.signature, s.doc, s.parent) if s else (None,) * 4), "\n".join(lines[a - 1 : b])))
    return rows


def parse_files(files: DataFrame, *, path_col: str = "path", source_col: str = "source", parts: Collection[str] = PARTS) -> DataFrame:
    """``path``, ``source`` and the parse of every file that has a parser.  Of
    the parse only ``parts`` are given, and ``source`` only with chunks."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    parts, with_source = [p for p in PARTS if p in parts], "chunks" in parts
    schema = ", ".join(["path string", *["source string"] * with_source, "lang string, has_errors boolean", *(f"{p} array<{PARTS[p]}>" for p in parts)])
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def column(name: str, lists: list[list[tuple]]) -> pa.Array:
            """Lists of rows by field, so that no row becomes an object."""
            kind = arrow.field(name).type
            ends, rows = [0], []
            for own in lists:
                rows += own
                ends.append(len(rows))
            fields = list(kind.value_type)
            values = zip(*rows, strict=True) if rows else [[]] * len(fields)
            held = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(values, fields, strict=True)], fields=fields)
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held, type=kind)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                paths, sources = (batch.column(i).slice(at, 256).to_pylist() for i in (0, 1))
                found = [(path, source, p) for path, source in zip(paths, sources, strict=True) if (p := parse_source(source or "", path, parts)) is not None]
                if not found:
                    continue
                paths, sources, parsed = zip(*found, strict=True)
                rows = {
                    "symbols": lambda p, _: [s.row() for s in p.symbols], "imports": lambda p, _: p.imports, "calls": lambda p, _: p.calls,
                    "chunks": lambda p, source: _chunk_rows(p, source or ""),
                }
                arrays = [pa.array(paths), *[pa.array(sources, pa.string())] * with_source, pa.array([p.lang for p in parsed]), pa.array([p.has_errors for p in parsed])]
                yield pa.RecordBatch.from_arrays([*arrays, *(column(name, list(map(rows[name], parsed, sources))) for name in parts)], schema=arrow)

    rows = files.select(F.col(path_col).alias("path"), F.col(source_col).cast("string").alias("source")).filter("path is not null")
    return rows.mapInArrow(run, schema)
