"""SQL for what the code queries must find in the made code base.

The tables below say by hand, from the rules of the extraction, what each shape
holds: lines count from its first line, and text marks are filled in by row.
"""

from __future__ import annotations

from quarryline.operators.indexing import COMMON_CALLEES
from quarryline.plans.codebase import BLOCKS, DIRS, SHAPES

# part of the file, name, kind, parent, first and last line, exported, signature, doc
SYMBOLS = {
    ".ts": (
        ("head", "DRAFT_{K}", "constant", None, 3, 3, False, "const DRAFT_{K} = {S};", None),
        ("head", "BEAM_{K}", "constant", None, 4, 4, False, "const BEAM_{K} = {S} * 2;", None),
        ("head", "Dock{K}", "class", None, 7, 13, True, "abstract class Dock{K} extends Quay", "// Holds ships of size {S}."),
        ("head", "assign", "method", "Dock{K}", 10, 12, False, "assign(ship: Ship): boolean", None),
        ("block", "moor{K}_{I}", "function", None, 1, 6, True, "function moor{K}_{I}( line: Rope, ): number", None),
    ),
    ".py": (
        ("head", "_Buoy{K}", "class", None, 5, 10, False, "class _Buoy{K}(Float):", '"""Floats at {S}."""'),
        ("head", "drift", "function", "_Buoy{K}", 9, 10, True, "def drift(wind, *, slack={S}):", None),
        ("block", "haul_{K}_{I}", "function", None, 1, 4, True, "async def haul_{K}_{I}(crew):", None),
    ),
    ".go": (
        ("head", "Crane{K}", "type", None, 6, 8, True, "type Crane{K} struct { reach int }", "// Crane lifts {S} tons."),
        ("head", "Lift", "method", None, 10, 12, True, "func (c *Crane{K}) Lift(load int) (int, error)", None),
        ("block", "winch{K}_{I}", "function", None, 1, 5, False, "func winch{K}_{I}(rope []string)", None),
    ),
    ".rs": (
        ("head", "Marina{K}", "struct", None, 5, 7, True, "pub struct Marina{K}", "/// Keeps {S} boats.\n/// Not more."),
        ("head", "rent", "function", None, 10, 13, False, "pub(crate) fn rent(&self, boat: &'static str) -> u32", None),
        ("head", "LANTERN_{K}", "constant", None, 16, 16, False, "static LANTERN_{K}: &str = \"it's {S}\";", None),
        ("block", "launch_{K}_{I}", "function", None, 1, 4, True, "pub fn launch_{K}_{I}(n: u32) -> u32", None),
    ),
    ".js": (
        ("head", "ring{K}", "function", None, 4, 6, True, "function ring{K}(bell)", "/* Rings {S} bells. */"),
        ("head", "fog{K}", "function", None, 8, 10, True, "const fog{K} = (horn) => { soundHorn(horn); };", None),
        ("block", "knot{K}_{I}", "function", None, 1, 4, False, "function knot{K}_{I}(speed)", None),
        ("block", "hitch{K}_{I}", "constant", None, 6, 6, False, "const hitch{K}_{I} = /[\"'`{(]\\/[/}]/g;", None),
        ("block", "splice{K}_{I}", "constant", None, 7, 7, False, "let splice{K}_{I} = `${[1].map((r) => `${coilUp{I}(r)} }`).length / 2} {`;", None),
        ("block", "Flag{K}_{I}", "function", None, 8, 10, True, "const Flag{K}_{I} = ({ tint }) => ( <b title=\"{(\" onClick={() => hoist{I}(tint)}>don't call( {`${waveAt{I}(tint)}`} <br/></b> );", None),
    ),
}
# part of the file, caller ('' at the top), callee, kind, line
EDGES = {
    ".ts": (("head", "", "../d{D}/part_{N}", "imports", 1), ("head", "assign", "pickBerth", "calls", 11), ("block", "moor{K}_{I}", "checkTide", "calls", 4), ("block", "moor{K}_{I}", "map", "calls", 5)),
    ".py": (("head", "", "harbour.part_{N}", "imports", 2), ("head", "", "anchored", "calls", 8), ("head", "drift", "swing_round", "calls", 10), ("block", "haul_{K}_{I}", "print", "calls", 4), ("block", "haul_{K}_{I}", "count_rope", "calls", 4)),
    ".go": (("head", "", "shore/d{D}", "imports", 3), ("head", "Lift", "swingArm", "calls", 11), ("block", "winch{K}_{I}", "pullIn", "calls", 3), ("block", "winch{K}_{I}", "len", "calls", 3)),
    ".rs": (("head", "", "shore::d{D}::tide", "imports", 1), ("head", "rent", "take_slip", "calls", 12), ("block", "launch_{K}_{I}", "tow_out", "calls", 2)),
    ".js": (("head", "", "../d{D}/part_{N}.js", "imports", 1), ("head", "ring{K}", "strike", "calls", 5), ("head", "", "soundHorn", "calls", 9), ("block", "knot{K}_{I}", "readLog", "calls", 2), ("block", "", "coilUp{I}", "calls", 7), ("block", "", "hoist{I}", "calls", 9), ("block", "", "waveAt{I}", "calls", 9)),
}
# part of the file, first and last line of a chunk, name of the symbol whose signature heads it
CHUNKS = {
    ".ts": (("head", 1, 2, None), ("head", 3, 4, "DRAFT_{K}"), ("head", 5, 6, None), ("head", 7, 13, "Dock{K}"), ("block", 1, 6, "moor{K}_{I}")),
    ".py": (("head", 1, 4, None), ("head", 5, 10, "_Buoy{K}"), ("block", 1, 4, "haul_{K}_{I}")),
    ".go": (("head", 1, 5, None), ("head", 6, 12, "Crane{K}"), ("head", 13, 15, None), ("block", 1, 5, "winch{K}_{I}")),
    ".rs": (("head", 1, 4, None), ("head", 5, 7, "Marina{K}"), ("head", 8, 9, None), ("head", 10, 13, "rent"), ("head", 14, 15, None), ("head", 16, 16, "LANTERN_{K}"), ("block", 1, 4, "launch_{K}_{I}")),
    ".js": (("head", 1, 3, None), ("head", 4, 10, "ring{K}"), ("block", 1, 4, "knot{K}_{I}"), ("block", 6, 10, "hitch{K}_{I}")),
}


def _text(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, (bool, int)):
        return str(x)
    return "'" + x.replace("'", "''") + "'"


def _values(table: dict) -> str:
    return ", ".join("(" + ", ".join(map(_text, (ending, *row))) + ")" for ending, rows in table.items() for row in rows)


def _filled(x: str) -> str:
    for mark, value in (("{K}", "k"), ("{N}", "n"), ("{D}", f"n % {DIRS}"), ("{S}", "size"), ("{I}", "i")):
        x = f"replace({x}, '{mark}', ({value})::VARCHAR)"
    return x


_N = len(SHAPES)
_PICK = lambda f: "[" + ", ".join(_text(getattr(s, f)) for s in SHAPES) + f"][(k % {_N} + 1)::INTEGER]"
#: ``files``: one row a file; ``pieces``: its head (i = 0) and blocks with the lines before them.
FILES = f"""
keys AS (
    SELECT p_partkey AS k, p_partkey + {_N} AS n, p_size AS size, p_size % {BLOCKS} AS blocks FROM part
), files AS (
    SELECT k, n, size, blocks, {_PICK("ending")} AS ending, {_PICK("lang")} AS lang, 'd' || k % {DIRS} AS module,
           'd' || k % {DIRS} || '/part_' || k || {_PICK("ending")} AS path, {_PICK("head")} AS head, {_PICK("block")} AS block
    FROM keys
), pieces AS (
    SELECT *, 0 AS i, 'head' AS piece, 0 AS before FROM files
    UNION ALL
    SELECT *, 'block', len(string_split(head, E'\\n')) - 1 + i * (len(string_split(block, E'\\n')) - 1) FROM (SELECT *, unnest(range(blocks)) AS i FROM files)
)"""

SYMBOL_ROWS = f"""{FILES}, symbol_shapes(ending, piece, name, kind, parent, a, b, exported, signature, doc) AS (
    VALUES {_values(SYMBOLS)}
), symbols AS (
    SELECT path, {_filled("name")} AS name, kind, {_filled("parent")} AS parent, (before + a)::INTEGER AS start_line, (before + b)::INTEGER AS end_line, exported,
           {_filled("signature")} AS signature, {_filled("doc")} AS doc
    FROM pieces JOIN symbol_shapes USING (ending, piece)
)"""

EDGE_ROWS = f"""{FILES}, edge_shapes(ending, piece, src, dst, kind, a) AS (
    VALUES {_values(EDGES)}
), edges AS (
    SELECT path, {_filled("src")} AS src, {_filled("dst")} AS dst, kind, (before + a)::INTEGER AS line, 'heuristic' AS precision
    FROM pieces JOIN edge_shapes USING (ending, piece)
    WHERE kind = 'imports' OR dst NOT IN ({", ".join(map(_text, COMMON_CALLEES))})
)"""

CODE_CHUNKS = f"""{SYMBOL_ROWS}, chunk_shapes(ending, piece, a, b, symbol) AS (
    VALUES {_values(CHUNKS)}
), placed AS (
    SELECT path, module, lang, (before + a)::INTEGER AS start_line, (before + b)::INTEGER AS end_line, {_filled("symbol")} AS symbol,
           array_to_string(string_split({_filled("CASE WHEN piece = 'head' THEN head ELSE block END")}, E'\\n')[a:b], E'\\n') AS body
    FROM pieces JOIN chunk_shapes USING (ending, piece)
), headed AS (
    SELECT p.*, array_to_string([x FOR x IN ['file: ' || p.path, 'module: ' || module, 'enclosing: ' || s.parent, 'signature: ' || s.signature, 'doc: ' || substr(regexp_replace(s.doc, '\\s+', ' ', 'g'), 1, 300), 'lang: ' || lang] IF x IS NOT NULL], E'\\n') AS header
    FROM placed p LEFT JOIN symbols s ON s.path = p.path AND s.name = p.symbol
), chunks AS (
    SELECT *, substr(sha256(header || E'\\n---\\n' || body), 1, 32) AS content_hash FROM headed
)"""

SQL = {
    "parse_symbols": f"WITH {SYMBOL_ROWS} SELECT * FROM symbols",
    "code_index_edges": f"WITH {EDGE_ROWS} SELECT * FROM edges",
    "code_import_graph": f"""
WITH {FILES} SELECT a.path AS source, b.path AS target FROM files a JOIN files b ON b.k = a.n WHERE a.ending IN ('.ts', '.js')""",
}
