"""The parser against programs put together from single declarations.

Each declaration states its symbols, imports and calls with lines from its own
first line.  Random sequences of declarations then must give what was put in,
at the place it was put, whatever stands beside it.
"""

import random

import pytest

from quarryline.operators import parse
from quarryline.operators.parse import parse_files, parse_source

# Text; symbols (kind, name, parent, first, last, exported); imports (name, line); calls (callee, line, caller).
PARTS = {
    "m.ts": [
        ('import * as soil{n} from "soil/{n}";', [], [("soil/{n}", 1)], []),
        ("import './effects{n}'", [], [("./effects{n}", 1)], []),
        ("declare function probe{n}(depth: number): boolean;", [("function", "probe{n}", None, 1, 1, False)], [], []),
        ("export default async function* harvest{n}(crate) {\n  yield weigh{n}(crate);\n}", [("function", "harvest{n}", None, 1, 3, True)], [], [("weigh{n}", 2, "harvest{n}")]),
        ("class Orchard{n} extends Plot {\n  static rows = 3;\n\n  protected prune{n}(tree: Tree): void {\n    this.shears.snip{n}(tree, graft{n}());\n  }\n}",
         [("class", "Orchard{n}", None, 1, 7, False), ("method", "prune{n}", "Orchard{n}", 4, 6, False)], [], [("snip{n}", 5, "prune{n}"), ("graft{n}", 5, "prune{n}")]),
        ("export enum Season{n} {\n  Spring,\n  Fall,\n}", [("enum", "Season{n}", None, 1, 4, True)], [], []),
        ("type Basket{n}<T> = {\n  fruit: T[];\n};", [("type", "Basket{n}", None, 1, 3, False)], [], []),
        ("export interface Sower{n} {\n  sow(seed: Seed): void;\n}", [("interface", "Sower{n}", None, 1, 3, True)], [], []),
        ("let ripeness{n} = measure{n}(\n  0.5,\n);", [("constant", "ripeness{n}", None, 1, 3, False)], [], [("measure{n}", 1, None)]),
        ("const sorter{n} = async <T>(xs: T[]) => {\n  await shelve{n}<T>(xs);\n};", [("function", "sorter{n}", None, 1, 3, False)], [], [("shelve{n}", 2, None)]),
        ("export const peel{n} = function (x) {\n  return x;\n};", [("function", "peel{n}", None, 1, 3, True)], [], []),
        ("const quote{n} = /[\"'`{/]\\/(?:\\()/gi;", [("constant", "quote{n}", None, 1, 1, False)], [], []),
        ("let half{n} = total{n} / 2 / fold{n}(/}/.exec(s)) /* } */ / 3;", [("constant", "half{n}", None, 1, 1, False)], [], [("fold{n}", 1, None), ("exec", 1, None)]),
        ("function crop{n}(s) {\n  if (s) /[)}]/.test(s);\n  return /`{/.test(`${s ? `${thresh{n}(s)} }` : '`'} {`);\n}",
         [("function", "crop{n}", None, 1, 4, False)], [], [("test", 2, "crop{n}"), ("test", 3, "crop{n}"), ("thresh{n}", 3, "crop{n}")]),
        ("export const label{n} = `a\n${[1, 2].map((x) => {\n  return `${x / 2}/${ { a: '}' }.a }`;\n})} /* not ${ '`' } a comment`;", [("constant", "label{n}", None, 1, 4, True)], [], [("map", 2, None)]),
        ('/* class No{n} {} */ // function nor{n}() {}\nlog{n}("function not{n}() {", `and ${1} not`);', [], [], [("log{n}", 2, None)]),
    ],
    "m.py": [
        ("import kettle{n}, cup{n}.rim", [], [("kettle{n}", 1), ("cup{n}.rim", 1)], []),
        ("import leaf{n} as lf", [], [], []),
        ("from tins.box{n} import lid", [], [("tins.box{n}", 1)], []),
        ("from . import jar{n}", [], [], []),
        ("@cached{n}(1)\ndef blend{n}(*leaves, steep=3) -> str:\n    return pour{n}(leaves)", [("function", "blend{n}", None, 2, 3, True)], [], [("cached{n}", 1, None), ("pour{n}", 3, "blend{n}")]),
        ("class Kettle{n}(Vessel):\n    'Holds water.'\n\n    @property\n    def _heat{n}(self):\n        return self.coil.gauge{n}()",
         [("class", "Kettle{n}", None, 1, 6, True), ("function", "_heat{n}", "Kettle{n}", 5, 6, False)], [], [("gauge{n}", 6, "_heat{n}")]),
        ("class _Spout{n}: ...", [("class", "_Spout{n}", None, 1, 1, False)], [], []),
        ("async def brew{n}():\n    def inner{n}():\n        stir{n}()\n    await boil{n}(inner{n})", [("function", "brew{n}", None, 1, 4, True), ("function", "inner{n}", None, 2, 3, True)], [], [("stir{n}", 3, "inner{n}"), ("boil{n}", 4, "brew{n}")]),
        ("x{n} = 'def no(): class No: f('", [], [], []),
    ],
    "m.go": [
        ('import "net/{n}"', [], [("net/{n}", 1)], []),
        ('import (\n\tt "a/{n}"\n\t_ "b/{n}"\n)', [], [("a/{n}", 2), ("b/{n}", 3)], []),
        ("type Loom{n} interface {\n\tWeave(n int) error\n}", [("type", "Loom{n}", None, 1, 3, True)], [], []),
        ("type thread{n} = string", [("type", "thread{n}", None, 1, 1, False)], [], []),
        ("func (l *Loom{n}) Spin{n}(w Wool) (yarn Yarn, err error) {\n\treturn twist{n}(w), nil\n}", [("method", "Spin{n}", None, 1, 3, True)], [], [("twist{n}", 2, "Spin{n}")]),
        ("func dye{n}[T any](xs []T) {\n\tfor range xs {\n\t\tvat.Dip{n}(`func no{n}() {`)\n\t}\n}", [("function", "dye{n}", None, 1, 5, False)], [], [("Dip{n}", 3, "dye{n}")]),
        ("const Knots{n} = 12", [("constant", "Knots{n}", None, 1, 1, True)], [], []),
        ("var free{n} = '{'", [], [], []),
    ],
    "m.rs": [
        ("use mine::shaft{n};", [], [("mine::shaft{n}", 1)], []),
        ("pub enum Ore{n} {\n    Iron,\n    Tin(u8),\n}", [("enum", "Ore{n}", None, 1, 4, True)], [], []),
        ("/* outer /* fn no{n}() { */ still( */\nstruct Sack{n};", [("struct", "Sack{n}", None, 2, 2, False)], [], []),
        ("fn sift{n}() -> u8 {\n    let q = (b'{', '\\'', '\\u{7b}', \"\\\"{\", br##\"{\"#{\"##);\n    b'}'\n}", [("function", "sift{n}", None, 1, 4, False)], [], []),
        ("struct Cart{n}(u32);", [("struct", "Cart{n}", None, 1, 1, False)], [], []),
        ("pub trait Dig{n} {\n    fn deeper{n}(&self) -> bool;\n}", [("interface", "Dig{n}", None, 1, 3, True), ("function", "deeper{n}", None, 2, 2, False)], [], []),
        ("mod vein{n} {\n    pub async fn follow{n}<'a>(x: &'a str) -> char {\n        trace{n}(x);\n        '}'\n    }\n}", [("module", "vein{n}", None, 1, 6, False), ("function", "follow{n}", "vein{n}", 2, 5, True)], [], [("trace{n}", 3, "follow{n}")]),
        ('impl Cart{n} {\n    fn haul{n}(self) {\n        println!("{}", no{n}(1));\n        self.rail.push{n}(r#"fn no() {"#);\n        far::away{n}();\n    }\n}', [("function", "haul{n}", None, 2, 6, False)], [], [("push{n}", 4, "haul{n}")]),
        ("pub(super) const DEPTH{n}: [u8; 2] = [1, 2];", [("constant", "DEPTH{n}", None, 1, 1, False)], [], []),
        ("pub static mut LAMP{n}: u8 = 1;", [("constant", "LAMP{n}", None, 1, 1, True)], [], []),
    ],
}
PARTS["m.js"] = [p for p in PARTS["m.ts"] if not any(x in p[0] for x in ("declare", "protected", "enum", "type ", "interface", "<T>"))]
PARTS["m.tsx"] = PARTS["m.ts"][:12] + [
    ("export function Shed{n}({ open }: Props) {\n  return (\n    <section title=\"{(\" {...rest{n}(open)}>\n      don't {open ? <b>it's {count{n}(1)}</b> : <i/>} call{n}( {/* } */ '}'}\n    </section>\n  );\n}",
     [("function", "Shed{n}", None, 1, 7, True)], [], [("rest{n}", 3, "Shed{n}"), ("count{n}", 4, "Shed{n}")]),
    ("const Gate{n} = () => <><Latch key={`${turn{n}(1)}`} onPull={() => { pull{n}(); }}>{'<'}</Latch> {\"}\"} } </>;", [("function", "Gate{n}", None, 1, 1, False)], [], [("turn{n}", 1, None), ("pull{n}", 1, None)]),
    ("const same{n} = <T,>(x: T) => (x < limit{n}(x) ? x : `${x}`);", [("function", "same{n}", None, 1, 1, False)], [], [("limit{n}", 1, None)]),
    ("function less{n}(a, b) {\n  return a < b && b > cmp{n}(a) / 2;\n}", [("function", "less{n}", None, 1, 3, False)], [], [("cmp{n}", 2, "less{n}")]),
]
PARTS["m.jsx"] = PARTS["m.js"] + PARTS["m.tsx"][-1:] + PARTS["m.tsx"][-3:-2]


def program(path, seed, size=9):
    """A random program and what it holds."""
    draw = random.Random(f"{path}{seed}")
    text, want = "", ([], [], [])
    for n in range(size):
        source, *told = draw.choice(PARTS[path])
        line = text.count("\n")
        fill = lambda x, n=n: x.replace("{n}", str(n)) if isinstance(x, str) else x
        symbols, imports, calls = told
        want[0].extend((k, fill(name), fill(parent), a + line, b + line, e) for k, name, parent, a, b, e in symbols)
        want[1].extend((fill(name), a + line) for name, a in imports)
        want[2].extend((fill(name), a + line, fill(caller)) for name, a, caller in calls)
        text += fill(source) + "\n" * draw.choice((1, 2, 2, 3, 5))
    return text, want


def check_chunks(source, found):
    """What holds for chunks of any program."""
    lines = source.split("\n")
    covered = [0] * (len(lines) + 2)
    for a, b, _ in found.chunks:
        assert 1 <= a <= b <= len(lines) and b - a < parse.MAX_CHUNK_LINES
        for i in range(a, b + 1):
            covered[i] += 1
    assert all(covered[i] for i, line in enumerate(lines, 1) if line.strip())
    assert all(any(x.strip() for x in lines[a - 1 : b]) for a, b, _ in found.chunks) or not source.strip()


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("path", sorted(PARTS))
def test_random_programs(path, seed):
    source, (symbols, imports, calls) = program(path, seed)
    found = parse_source(source, path)
    assert not found.has_errors, source
    assert sorted((s.kind, s.name, s.parent or "", s.start_line, s.end_line, s.exported) for s in found.symbols) == sorted((k, n, p or "", a, b, e) for k, n, p, a, b, e in symbols), source
    assert sorted(found.imports) == sorted(imports), source
    assert sorted(map(str, found.calls)) == sorted(map(str, calls)), source
    check_chunks(source, found)


@pytest.mark.parametrize("seed", range(30))
def test_cut_programs_still_give_chunks(seed):
    path = random.Random(seed).choice(sorted(PARTS))
    source, _ = program(path, seed)
    cut = source[: random.Random(seed).randrange(len(source))]
    check_chunks(cut, parse_source(cut, path))


def signature(path, source):
    return parse_source(source, path).symbols[0].signature


def test_signatures_stop_before_the_body_and_at_400_characters():
    assert signature("a.ts", "function  mash (\n a,\tb )  { }") == "function mash ( a, b )"
    assert signature("a.py", "def mash(a: dict = {1: 2}, *, b=':'):\n    pass\n") == "def mash(a: dict = {1: 2}, *, b=':'):"
    assert signature("a.go", "func Mash(a int,\n\tb int) int { return a }") == "func Mash(a int, b int) int"
    long = "function f(" + ", ".join(f"p{i}" for i in range(300)) + ") {}"
    assert signature("a.ts", long) == long[:400].strip()


DOCS = [
    ("a.ts", "// one\n// two\nconst q = 1;", "// one\n// two"), ("a.ts", "// far\n\nconst q = 1;", None), ("a.ts", "w(); // beside\nconst q = 1;", "// beside"),
    ("a.ts", "/* wide\n   block */ // and more\nexport const q = 1;", "/* wide\n   block */\n// and more"), ("a.rs", "//! head\n/// of it\nstruct Q;", "//! head\n/// of it"),
    ("a.py", "# said\ndef q():\n    'not this'\n", "# said"), ("a.py", "def q():\n    r'raw'\n", "r'raw'"), ("a.py", "def q():\n    1\n    'late'\n", None), ("a.go", "// said\nfunc q() {}", "// said"),
]


@pytest.mark.parametrize(("path", "source", "doc"), DOCS)
def test_docs(path, source, doc):
    assert parse_source(source, path).symbols[0].doc == doc


def rows_of(n, name="v", gap=0):
    return ("\n" * (gap + 1)).join(f"const {name}{i} = {i};" for i in range(n)) + "\n"


def names(source):
    return [c[2] for c in parse_source(source, "a.ts").chunks if c[2]]


def test_limits_of_merging():
    assert names(rows_of(2, gap=parse.MERGE_GAP)) == ["v0, v1"]
    assert names(rows_of(2, gap=parse.MERGE_GAP + 1)) == ["v0", "v1"]
    small = "const a = [\n" + "1,\n" * (parse.SMALL_LINES - 2) + "];\n"
    large = "const a = [\n" + "1,\n" * (parse.SMALL_LINES - 1) + "];\n"
    assert names(small + "const b = 2;\n") == ["a, b"] and names(large + "const b = 2;\n") == ["a", "b"]
    chunks = parse_source(rows_of(100), "a.ts").chunks
    assert [b - a + 1 for a, b, _ in chunks] == [parse.MAX_MERGED_LINES] * 2 + [100 - 2 * parse.MAX_MERGED_LINES]


@pytest.mark.parametrize("container", ["class C { }", "interface C { }", "enum C { }"])
def test_containers_stand_alone(container):
    assert names(f"const a = 1;\n{container}\nconst b = 2;\n") == ["a", "C", "b"]


@pytest.mark.parametrize("lines", [parse.MAX_CHUNK_LINES, parse.MAX_CHUNK_LINES + 1, 7 * parse.MAX_CHUNK_LINES + 5])
def test_long_spans_are_cut(lines):
    source = "class Long {\n" + "  // row\n" * (lines - 2) + "}"
    sizes = [b - a + 1 for a, b, _ in parse_source(source, "a.ts").chunks]
    assert sum(sizes) == lines and max(sizes) == parse.MAX_CHUNK_LINES and len(sizes) == -(-lines // parse.MAX_CHUNK_LINES)


def test_files_without_symbols_and_without_parsers():
    assert parse_source("", "a.go").chunks == [(1, 1, None)] and not parse_source("", "a.go").has_errors
    assert parse_source("\n\n// said\n", "a.rs").chunks == [(1, 4, None)]
    assert parse_source("fn main() {}", "a.txt") is None and parse_source("x", "Makefile") is None


@pytest.mark.parametrize(("path", "source"), [("a.py", "x = " + "+".join(["1"] * 30_000)), ("a.py", "x = " + "-" * 5_000 + "1"), ("a.py", "(" * 3_000), ("a.py", "a\0b"), ("a.ts", "{" * 20_000), ("a.rs", "(" * 20_000)])
def test_files_that_break_a_parser_are_marked(path, source):
    found = parse_source(source, path)
    assert found.has_errors
    check_chunks(source, found)


@pytest.mark.parametrize("depth", [3, 400])
def test_modes_nest_to_any_depth(depth):
    """Templates in templates in markup, each closed in turn."""
    inner = "deep()"
    for i in range(depth):
        inner = f"`}} ${{{inner}}} {{`" if i % 2 else f"<p a={{{inner}}}>it's</p>"
    found = parse_source(f"const a = {inner};\nconst b = 1;\n", "a.tsx")
    assert not found.has_errors
    assert [(s.name, s.start_line, s.end_line) for s in found.symbols] == [("a", 1, 1), ("b", 2, 2)]
    assert found.calls == [("deep", 1, None)]


@pytest.mark.parametrize("source", ["const a = `${ { `;\n", "const a = `${(}`;\nconst b = 2;\n", "const A = () => <p>\n", "const r = /[/;\n", "f(`${`${`", "<", "/", "`"])
def test_what_is_never_closed_is_marked_or_plain(source):
    found = parse_source(source, "a.tsx")
    check_chunks(source, found)


def test_a_very_long_word_takes_time_in_proportion():
    import time

    began = time.process_time()
    assert not parse_source("const a = '" + "x" * 300_000 + "';\n" + "y" * 300_000 + ";\n", "a.ts").has_errors
    assert time.process_time() - began < 5


def test_large_files_take_time_in_proportion():
    import time

    def seconds(n):
        source = "".join(f"// d{i}\nexport function f{i}(a) {{\n  g{i}(a);\n}}\nconst c{i} = h{i}();\n" for i in range(n))
        began = time.process_time()
        assert len(parse_source(source, "a.ts").symbols) == 2 * n
        return time.process_time() - began

    seconds(100)
    assert seconds(6_000) < 40 * max(seconds(600), 0.02)


def test_parse_files(spark):
    source, (symbols, _, _) = program("m.rs", 1)
    df = spark.createDataFrame([("x/m.rs", source), ("b.txt", "x"), ("c.py", None), ("deep.py", "(" * 3_000), (None, "x")], "path string, source string")
    got = {r.path: r for r in parse_files(df).collect()}
    assert set(got) == {"x/m.rs", "c.py", "deep.py"}
    assert len(got["x/m.rs"].symbols) == len(symbols) and got["deep.py"].has_errors and got["c.py"].chunks


def test_symbols_alone_are_those_of_the_whole_parse(spark):
    files = [("a.ts", "// Winds.\nexport class Winch {\n  pull(n: number) { return haul(n); }\n}\nimport x from 'y';\n"), ("b.rs", "use a::b;\npub fn row(n: u32) -> u32 {\n  oar(n)\n}\n"), ("c.py", "import os\ndef dock():\n    return os.getcwd()\n"), ("d.txt", "no code"), ("e.go", None)]
    files = spark.createDataFrame(files, "path string, source string")
    whole, only = parse.parse_files(files), parse.parse_files(files, parts=["symbols"])
    assert only.columns == ["path", "lang", "has_errors", "symbols"]  # nothing else is made or sent back
    assert sorted(only.collect()) == sorted(whole.select(only.columns).collect())
    assert {r.path: len(r.symbols) for r in only.collect()} == {"a.ts": 2, "b.rs": 1, "c.py": 1, "e.go": 0}
