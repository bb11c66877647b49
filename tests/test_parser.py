"""The parser on what is hard to tell apart: literals, tags, templates, members, overloads, patterns; and on large files."""

import time

import pytest
from pyspark.sql import functions as F

from rillstone.sources import files as sources
from rillstone.sources import parse
from rillstone.sources.lexer import Lexer

FAR = "cross-file-or-external"

CLASSES = """class K {
  m = (a) => z(a);
  static n = function () { return w(); };
  get v() { return q(); }
  set v(x) { q(x); }
  @Log({ level: f(1) })
  async load<T>(id: T): Promise<{ a: T }> { return this.run(id); }
  over(a: string): void;
  over(a: number): void;
  over(a: any) { g(a) }
  'quoted name'() { h() }
  [Symbol.iterator]() { i() }
  *gen() { yield j() }
  #hidden() { k() }
  constructor(private x = make()) { super(1) }
  optional?(): void { l() }
}
export abstract class A { abstract go(): void; done() {} }
const E = class F { inner() { never() } };
"""
VARIABLES = """export const { a, b: [c] } = make(), other = () => 1;
const r = cond ? () => v1() : v2;
const s = (x): x is T => y(x)
const t = await later();
const u = new Thing(1);
const v = new Thing(1).start();
const w = f(1) + 2;
const x = a < b, y = c;
let z: Map<string, () => void> = build<T>(1), q
const fn = async function named(p = { a: 1 }, [d, e]: T[]): Promise<void> { await p() };
const tagged = css`a ${b}`;
const chain = one
  .two(3)
  .three(() => four())
const bound = function () {}.bind(this);
const arrowOfType = <T,>(v: T) => v;
for (const loop of list()) { inner(loop) }
"""
OVERLOADS = """export function o(a: string): void;
export function o(a: number): void;
export function o(a: any): { b: number } | null {
  function nested() { return deep(); }
  return nested();
}
export default async function* main() { yield o(1); }
declare function ambient(x: number): void;
"""
TAGS = """export const App = ({ items }: Props) => (
  <ul className="call(me)" onClick={() => pick(items)}>
    it's not a call(x) {items.map((i) => <li key={i}>{`n ${fmt(`deep ${inner(i)}`)}`}</li>)} // no comment
    <Empty /> text {/* note(1) */} <></>
  </ul>
);
function plain() { return a < b && c > (d); }
"""


@pytest.fixture(scope="module")
def parsed(spark):
    files = [("classes.ts", CLASSES), ("variables.ts", VARIABLES), ("overloads.ts", OVERLOADS), ("tags.tsx", TAGS)]
    found = parse.parse(sources.given_files(spark, files), "p")
    nodes = {(r["file_path"], r["node_identity"].split(":", 2)[2]): r for r in found.nodes.collect()}
    return nodes, [(r["file_path"], r["caller"].split(":", 2)[2], r["callee"] and r["callee"].split(":", 2)[2], r["line"], r["col"], r["hint"]) for r in found.call_edges.orderBy("file_path", "edge_seq").collect()], found


def symbols(nodes, path):
    return {s: (n["start_line"], n["end_line"]) for (p, s), n in nodes.items() if p == path}


def test_methods_are_methods_alone(parsed):
    nodes, calls, _ = parsed
    assert symbols(nodes, "classes.ts") == {
        "K.load": (6, 7), "K.over": (10, 10), "K.'quoted name'": (11, 11), "K.[Symbol.iterator]": (12, 12), "K.gen": (13, 13), "K.#hidden": (14, 14), "K.optional": (16, 16),
        "A.go": (18, 18), "A.done": (18, 18),
    }
    assert nodes["classes.ts", "K.load"]["signature"].asDict() == {"params": ["id: T"], "return_type": "Promise<{ a: T }>"}
    assert nodes["classes.ts", "A.go"]["signature"]["return_type"] == "void" and nodes["classes.ts", "K.over"]["signature"]["params"] == ["a: any"]
    assert [(a, b) for p, a, b, *_ in calls if p == "classes.ts"] == [("K.load", "Log"), ("K.load", "f"), ("K.load", "run"), ("K.over", "g"), ("K.'quoted name'", "h"), ("K.[Symbol.iterator]", "i"), ("K.gen", "j"), ("K.#hidden", "k"), ("K.optional", "l")]


def test_variables_by_what_they_are_set_to(parsed):
    nodes, calls, found = parsed
    assert symbols(nodes, "variables.ts") == {
        "{ a, b: [c] }": (1, 1), "other": (1, 1), "s": (3, 3), "v": (6, 6), "z": (9, 9), "fn": (10, 10), "named": (10, 10), "chain": (12, 14), "bound": (15, 15), "arrowOfType": (16, 16),
    }
    signature = lambda s: nodes["variables.ts", s]["signature"]
    assert signature("fn").asDict() == signature("named").asDict() == {"params": ["p = { a: 1 }", "[d, e]: T[]"], "return_type": "Promise<void>"}
    assert signature("s").asDict() == {"params": ["x"], "return_type": "x is T"} and signature("chain") is None and signature("bound") is None and signature("arrowOfType")["params"] == ["v: T"]
    # an outer call comes before what it is called on, and stands where the whole expression does
    assert [(a, b, line, col) for p, a, b, line, col, _ in calls if p == "variables.ts" and a != "bound"] == [
        ("{ a, b: [c] }", "make", 1, 30), ("s", "y", 3, 26), ("v", "start", 6, 11), ("z", "build", 9, 34), ("named", "p", 10, 83),
        ("chain", "three", 12, 15), ("chain", "two", 12, 15), ("chain", "four", 14, 16),
    ]
    assert ("variables.ts", "bound", "bind", 15) in [c[:4] for c in calls]
    exported = {r["name"]: r["node_identity"] for r in found.exports.where("file_path = 'variables.ts'").collect()}
    assert exported == {"a": None, "other": "p:variables.ts:other"}
    assert nodes["variables.ts", "other"]["exported"] and not nodes["variables.ts", "s"]["exported"]


def test_overloads_and_functions_within_functions(parsed):
    nodes, calls, _ = parsed
    assert symbols(nodes, "overloads.ts") == {"o": (3, 6), "main": (7, 7)}  # neither signatures without a body nor declarations inside
    assert nodes["overloads.ts", "o"]["signature"].asDict() == {"params": ["a: any"], "return_type": "{ b: number } | null"}
    assert [(a, b) for p, a, b, *_ in calls if p == "overloads.ts"] == [("o", "deep"), ("o", "nested"), ("main", "o")]


def test_tags_and_templates_in_templates(parsed):
    nodes, calls, _ = parsed
    assert nodes["tags.tsx", "App"]["kind"] == "component" and nodes["tags.tsx", "App"]["signature"]["params"] == ["{ items }: Props"]
    assert [(a, b) for p, a, b, *_ in calls if p == "tags.tsx"] == [("App", "pick"), ("App", "map"), ("App", "fmt"), ("App", "inner")]


def test_handlers_are_the_first_function_given(spark):
    code = "app.get('/a', function one() {});\napp.put(async function two() {}, () => 1);\napp.post(() => 1, function no() {});\nrun(x)(function three() {});\n"
    edges = parse.parse(sources.given_files(spark, [("a.js", code)]), "p").call_edges.orderBy("edge_seq").collect()
    assert [(r["caller"], r["callee"], r["hint"]) for r in edges] == [("p:a.js:one", "p:a.js:get", "handler-attached"), ("p:a.js:two", "p:a.js:put", "handler-attached")]


def test_hashes_cover_modifiers_and_not_comments(spark):
    code = {"a.ts": "export function f() { return 1; }", "b.ts": "/** doc */ export  function f() { // c\n return 1; }", "c.ts": "function f() { return 1; }", "d.ts": "const f = g(1)", "e.ts": "export var f = g(1);"}
    got = {r["file_path"]: r["content_hash"] for r in parse.parse(sources.given_files(spark, list(code.items())), "p").nodes.collect()}
    assert got["a.ts"] == got["b.ts"] != got["c.ts"] and got["d.ts"] == got["e.ts"]


@pytest.mark.parametrize("literal", ["'{}'", '"{}"', "`{}`", "`${{f('{}')}}`", "/{}/", "/* {} */ 1", "<p>{}</p>"])
def test_literals_of_half_a_megabyte(spark, literal):
    code = f"export function f(x) {{ return g({literal.format('aé)(' * (1 << 17) if literal != '/{}/' else 'a' * (1 << 19))}); }}"
    found = parse.parse(sources.given_files(spark, [("a.js", code)]), "p")
    assert [r["callee"] for r in found.call_edges.orderBy("edge_seq").collect()] == ["p:a.js:g", *(["p:a.js:f"] if "${" in code[:40] else [])]
    assert found.nodes.first()["end_line"] == 1


def test_tokens_take_time_in_proportion():
    for piece in ("(", "<", "{}", "a.b().", "a<b,", "`${", "'", "f<T>(", "<a>", "x = {a: `${b}`}\n", "class A { b() {} }\n", "])", "({"):
        for jsx in (False, True):
            began = time.process_time()
            found = Lexer("x = " + piece * (120_000 // len(piece)), jsx).columns()
            assert time.process_time() - began < 8, piece
            assert len({len(c) for c in found.values()}) == 1


def test_many_calls_in_many_functions_of_one_file(spark):
    n, m = 2_000, 10
    code = "".join(f"function f{i}() {{ {'g(1);' * (m - 1)} run(function h{i}() {{ g(2); }}); }}\n" for i in range(n))
    found = parse.parse(sources.given_files(spark, [("a.js", code)]), "p")
    calls = {(r["caller"].split(":")[-1][0], r["callee"].split(":")[-1]): r["n"] for r in found.call_edges.where("hint = 'cross-file-or-external'").groupBy("caller", "callee").agg(F.count("*").alias("n")).collect()}
    assert calls == {("f", "g"): m - 1, ("h", "g"): 1, ("f", "run"): 1}
    assert found.call_edges.count() == n * (m + 2) and found.nodes.count() == 2 * n


def test_innermost_spans(spark):
    points = spark.createDataFrame([("a", i, i) for i in range(12)] + [("b", 3, 99)], "path string, at int, nth int")
    spans = spark.createDataFrame([("a", 1, 10, "x"), ("a", 2, 5, "y"), ("a", 3, 3, "z"), ("a", 7, 8, "w")], "path string, low int, high int, value string")
    got = {r["at"]: r["holder"] for r in parse.innermost(points, spans).collect()}
    assert got == {1: "x", 2: "y", 3: "z", 4: "y", 5: "y", 6: "x", 7: "w", 8: "w", 9: "x", 10: "x"}


def test_files_are_dealt_to_all_cores_and_long_strings_left_out(spark):
    long = "x" * 5000
    text = f"import {{ a }} from './a';\nclass B {{\n  'some name'(x) {{ return f('{long}'); }}\n}}\nfunction g() {{ put(\"{long}\"); h(`{long}`); }}\n"
    files = spark.range(40).selectExpr("concat('src/f', id, '.ts') AS path").withColumn("content", F.lit(text))
    dealt = sources.numbered(files)
    assert dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    parsed = parse.parse(dealt, "p")
    assert parsed.tokens.where(F.length("t") > 100).count() == 0
    assert {r["name"] for r in parsed.nodes.select("name").distinct().collect()} == {"'some name'", "g"}
    assert {r["module"] for r in parsed.imports.select("module").distinct().collect()} == {"./a"}
    assert {tuple(r) for r in parsed.call_edges.where("file_path = 'src/f7.ts'").select("callee", "line").collect()} == {("p:src/f7.ts:f", 3), ("p:src/f7.ts:put", 5), ("p:src/f7.ts:h", 5)}


def test_calls_read_contents_once(spark):
    """Contents are read again for calls only where a name is a part of them; either way the calls are those of all symbols."""
    read = spark.sparkContext.accumulator(0)

    def passed(content):
        read.add(1)
        return content

    told = F.udf(passed, "string").asNondeterministic()
    plain = [(f"s{i}.ts", f"function f{i}() {{ g(); h{i}(); }}\nclass K {{ m() {{ f{i}(); }} }}\nconst h{i} = () => 1;\n") for i in range(8)]
    for more, times in (([], 1), ([("p.ts", "const { a } = make(() => { b(); });\nclass C { [k]() { a(); } }\n")], 2)):
        given = sources.given_files(spark, plain + more)
        files = given.withColumn("content", told("content"))
        before = read.value
        got = parse.parse(files, "p").call_edges.collect()
        assert read.value - before == times * (8 + len(more))
        other = parse.parse(given, "p")
        assert other.symbols.count() and sorted(got) == sorted(other.call_edges.collect())
        assert len([r for r in got if r["caller"].startswith("p:s")]) == 24
