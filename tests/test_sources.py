"""Sources, the parser, and an analysis end to end on a small service written for this test."""

import subprocess

import pytest
from pyspark.sql import functions as F

from rillstone.operators.delta import compare
from rillstone.plans.analysis import analyse
from rillstone.schemas import NODES
from rillstone.sources import files as sources
from rillstone.sources import parse
from rillstone.sources.store import RunStore, recent_codebases

ROUTES = """import express, { type Express } from 'express';
import { listThings as unused, makeThing } from '../services/thingService';

// register('not', 'a call') {
export function register(app: Express) {
  app.get('/things', function listAll(req, res) {
    res.json(makeThing(req.params.id, "} not a brace"));
  });
  app.post('/things', function addOne(req, res) {
    validateBody(req);
    const x = makeThing(1);
    saveThing(x);
  });
}
function validateBody(req) { return check(req); }
"""
SERVICE = """import { insertThing, findThing } from '../db/thingRepo.ts';
export const makeThing = async (id: number, name = `t${id}`) => {
  const found = await findThing(id);
  return found ?? insertThing({ id, name });
};
class Box { put(x) { return makeThing(x); } get size() { return 1; } }
export { Box as Crate };
"""
REPO = """export function insertThing(t) { rows.push(t); return t; }
export function findThing(id) { return rows.find((r) => r.id === id); }
const rows = makeRows();
"""
FILES = [("src/db/thingRepo.ts", REPO), ("src/routes/things.ts", ROUTES), ("src/services/thingService.ts", SERVICE)]


@pytest.fixture(scope="module")
def analysis(spark):
    return analyse(sources.given_files(spark, FILES), "p")


def test_nodes_and_exports(analysis):
    got = {r["node_identity"][2:]: (r["exported"], r["start_line"], r["end_line"]) for r in analysis.nodes.collect()}
    assert got == {
        "src/db/thingRepo.ts:insertThing": (True, 1, 1), "src/db/thingRepo.ts:findThing": (True, 2, 2), "src/db/thingRepo.ts:rows": (False, 3, 3),
        "src/routes/things.ts:register": (True, 5, 14), "src/routes/things.ts:listAll": (False, 6, 8), "src/routes/things.ts:addOne": (False, 9, 13), "src/routes/things.ts:validateBody": (False, 15, 15),
        "src/services/thingService.ts:makeThing": (True, 2, 5), "src/services/thingService.ts:Box.put": (False, 6, 6),  # an accessor is no method
    }


def test_signatures(analysis):
    got = {r["name"]: (r["signature"]["params"], r["signature"]["return_type"]) for r in analysis.nodes.where("signature is not null").collect()}
    assert got["makeThing"] == (["id: number", "name = `t${id}`"], "") and got["register"] == (["app: Express"], "")
    assert got["put"] == (["x"], "") and "rows" not in got


def test_parameters_and_types(spark):
    code = "export function f(a: Map<string, number>, { b, c }: P): Promise<T[]> { return g((x) => x, a); }\nconst h = x => f(x);\nconst k = async (): Promise<void> => { await f(1, 2); };\n"
    nodes = parse.parse(sources.given_files(spark, [("a.ts", code)]), "p").nodes
    got = {r["name"]: (r["signature"]["params"], r["signature"]["return_type"]) for r in nodes.collect()}
    assert got == {"f": (["a: Map<string, number>", "{ b, c }: P"], "Promise<T[]>"), "h": (["x"], ""), "k": ([], "Promise<void>")}


def test_declarations_longer_than_400_tokens(spark):
    kind = "{ " + " ".join(f"p{i}: string;" for i in range(150)) + " }"
    code = f"export const f = ({{ p0 }}: {kind}) => g(p0);\nconst h: {kind} = (x) => g(x);\nconst data: {kind} = {{ p0: 1 }};\n"
    nodes = parse.parse(sources.given_files(spark, [("a.ts", code)]), "p").nodes
    assert {r["name"]: (r["start_line"], r["end_line"]) for r in nodes.collect()} == {"f": (1, 1), "h": (2, 2)}


def test_calls_paths_and_rules(analysis):
    edges = {(r["caller"].split(":")[-1], r["callee"].split(":")[-1]) for r in analysis.call_edges.where(~F.col("unresolved")).collect()}
    assert {("makeThing", "findThing"), ("makeThing", "insertThing"), ("addOne", "validateBody"), ("Box.put", "makeThing"), ("listAll", "makeThing")} <= edges
    assert {(r["node_identity"].split(":")[-1], r["method"]) for r in analysis.entry_points.collect()} == {("listAll", "GET"), ("addOne", "POST")}
    nodes = {(r["entry"].split(":")[-1], r["position"]): r["node_identity"].split(":")[-1] for r in analysis.path_nodes.collect()}
    assert nodes[("listAll", 0)] == "listAll" and nodes[("listAll", 1)] == "makeThing" and nodes[("listAll", 2)] == "findThing" and nodes[("addOne", 1)] == "validateBody"
    verdicts = {(r["rule_id"].split(":")[-1], r["node_identity"].split(":")[-1]): r["kind"] for r in analysis.rule_results.collect()}
    assert verdicts[("input_validated", "addOne")] == "pass" and verdicts[("single_responsibility", "makeThing")] == "pass"


def test_results_of_a_model_are_hooked_in(spark):
    opinion = lambda roles: roles.where("path like '%things.ts'").select("path", F.lit("page").alias("role"), F.lit("high").alias("confidence"))
    category = lambda paths: paths.select("path_id", F.concat(F.lit("last "), F.element_at("nodes", -1)["node_identity"]).alias("category"), F.lit(1).alias("category_order"))
    last = lambda branches: branches.select("entry", "caller", F.element_at("candidates", -1).alias("choice"))
    found = analyse(sources.given_files(spark, FILES), "p", second_opinion=opinion, categories=category, answers=last)
    assert {r["role"] for r in found.classifications.where("file_path = 'src/routes/things.ts'").collect()} == {"page"}
    ends = {r["entry"].split(":")[-1]: r["category"].split(":")[-1] for r in found.paths.collect()}
    assert ends == {"listAll": "insertThing", "addOne": "insertThing"}  # makeThing's last callee, addOne's last known one is makeThing


def test_hashes_are_looked_up(spark):
    from rillstone.operators import review

    nodes = spark.createDataFrame([("a", "h1"), ("b", None)], "node_identity string, content_hash string")
    targets = spark.createDataFrame([("a",), ("b",), ("c",)], "node_identity string")
    events = review.set_status(review.with_hashes(targets, nodes), "approved", None, "me", F.current_timestamp())
    assert {r["node_identity"]: r["code_hash"] for r in events.collect()} == {"a": "h1", "b": "", "c": ""}


def test_two_revisions_compared(spark, analysis):
    head = [FILES[0], (FILES[1][0], ROUTES.replace("app.post", "app.put").replace("function addOne", "function putOne")), (FILES[2][0], SERVICE.replace("export const makeThing", "const makeThing"))]
    c = compare(analysis, analyse(sources.given_files(spark, head), "p"))
    assert {(r["node_identity"].split(":")[-1], r["change"]) for r in c.contract_changes.collect()} == {("makeThing", "export_removed")}
    assert {(r["entry"].split(":")[-1], r["classification"]) for r in c.path_deltas.collect()} == {("listAll", "modified_in_place"), ("addOne", "net_gone"), ("putOne", "net_new")}


def test_imports_come_from_tokens(spark):
    code = """// import { no } from 'comment';
const text = "import { no } from 'string'";
import type { A, type B as C } from './types';
import def, { named as other } from "pkg";
import * as whole from './whole';
import type from './odd';
import './effect';
const later = import('./dynamic');
"""
    got = parse.parse(sources.given_files(spark, [("a.ts", code)]), "p").imports.orderBy("import_ord").collect()
    assert [(r["module"], r["specifier"]) for r in got] == [
        ("./types", "A"), ("./types", "B"), ("pkg", "named"), ("pkg", "default"), ("./whole", "*"), ("./odd", "default"), ("./effect", None),
    ]


def test_exports_are_names(spark):
    code = "export default function main() { go(); }\nfunction inner() {}\nexport { inner as outer, helper };\nfunction helper() {}\nexport const n = 1;\nexport interface Shape { a: string }\nexport type { T } from './t';\nexport class Box { a() {} }\n"
    parsed = parse.parse(sources.given_files(spark, [("a.ts", code)]), "p")
    assert {(r["name"], r["node_identity"]) for r in parsed.exports.collect()} == {("default", None), ("outer", None), ("helper", "p:a.ts:helper"), ("n", None), ("Shape", None), ("T", None), ("Box", None)}
    assert {r["name"] for r in parsed.nodes.where("exported").collect()} == {"main", "inner", "helper"}


def test_calls_of_every_shape(spark):
    code = r"""function run(a, b) {
  useState<Map<string, number>>(a);
  b?.go?.(1);
  a[0](2);
  make()(3);
  const t = `x ${inTemplate(a)} y ${b} z`;
  const r = /call(me)"/.test(a);
  if (a < b && c > (d)) { after(); }
  return notCalled;
}
class Sub extends Base { constructor() { super(1); } load() { return super.load(import('./x')); } }
function go() { return run(1, 2); }
"""
    edges = parse.parse(sources.given_files(spark, [("a.ts", code)]), "p").call_edges.orderBy("edge_seq").collect()
    got = [(r["caller"].split(":")[-1], r["callee"] and r["callee"].split(":")[-1], r["hint"]) for r in edges]
    far = "cross-file-or-external"
    assert got == [
        ("run", "useState", far), ("run", "go", None), ("run", None, "indirect"), ("run", None, "indirect"), ("run", "make", far), ("run", "inTemplate", far), ("run", "test", far), ("run", "after", far),
        ("Sub.load", "load", far), ("Sub.load", None, "indirect"), ("go", "run", None),
    ]


def test_unbalanced_files_are_named(spark):
    df = sources.given_files(spark, [("a.ts", "f(1)"), ("b.ts", "f(1"), ("c.ts", ")("), ("d.ts", "")])
    assert {r["path"] for r in parse.unbalanced(df).collect()} == {"b.ts", "c.ts"}


def test_folder_scan(spark, tmp_path):
    for name, text in (("src/a.ts", "x"), ("src/B.MJS", "y"), ("node_modules/z/i.js", "z"), ("readme.md", "r"), ("big.js", "b" * (sources.LARGEST + 1))):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["path"]: r["content"] for r in sources.read_folder(spark, str(tmp_path)).collect()}
    assert got == {"src/a.ts": "x", "src/B.MJS": "y"}


def test_git_revision(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.ts").write_text("old")
    (tmp_path / "b.md").write_text("no")
    run("add", "-A")
    run("commit", "-qm", "one")
    (tmp_path / "a.ts").write_text("new")
    got = sources.read_git(spark, str(tmp_path), "HEAD").collect()
    assert [(r["path"], r["content"]) for r in got] == [("a.ts", "old")]
    assert [(r["path"], r["content"]) for r in sources.read_git(spark, str(tmp_path)).collect()] == [("a.ts", "new")]
    (tmp_path / "untracked.ts").write_text("no")
    assert [(r["file_ord"], r["path"], r["content"]) for r in sources.collect_files(spark, str(tmp_path)).collect()] == [(0, "a.ts", "new")]
    assert sources.revision(str(tmp_path), "HEAD") and sources.revision(str(tmp_path), "nothing") is None


def test_git_filters_reach_the_listing(spark, tmp_path):
    from pyspark.sql.datasource import LessThanOrEqual, Not, StringContains, StringStartsWith

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    run("init", "-q")
    for name, size in (("src/a.ts", 10), ("src/big.ts", 5_000), ("lib/b.ts", 20), ("src/c.md", 30)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * size)
    run("add", "-A")
    run("commit", "-qm", "one")
    for ref in ("HEAD", None):
        reader = sources._GitReader({"path": str(tmp_path), "endings": ".ts,.js"} | ({"ref": ref} if ref else {}))
        left = list(reader.pushFilters([StringStartsWith(("path",), "src/"), LessThanOrEqual(("size",), 100), Not(StringContains(("path",), "z")), StringContains(("content",), "x")]))
        assert [type(f).__name__ for f in left] == ["Not", "StringContains"]
        assert sum((p.files for p in reader.partitions()), []) == [("src/a.ts", 10)]  # of 5,060 bytes, 10 are read
        plan = sources.read_git(spark, str(tmp_path), ref, largest=100).where(F.col("path").startswith("src/"))
        assert [(r["path"], r["size"]) for r in plan.collect()] == [("src/a.ts", 10)]
        executed = plan._jdf.queryExecution().executedPlan().toString()
        assert "<= 100" not in executed and "StartsWith" not in executed  # the source has taken them over
    run("mv", "lib/b.ts", "lib/moved.ts")
    (tmp_path / "src/a.ts").write_text("changed")
    run("rm", "-q", "src/c.md")
    run("add", "-A")
    run("commit", "-qm", "two")
    got = {(r["status"], r["old_path"], r["path"]) for r in sources.changed_files(spark, str(tmp_path), "HEAD~1", "HEAD").collect()}
    assert got == {("M", None, "src/a.ts"), ("R", "lib/b.ts", "lib/moved.ts"), ("D", None, "src/c.md")}
    assert sources.changed_files(spark, str(tmp_path), "HEAD", "HEAD").count() == 0


def test_runs_are_swapped_by_pointer(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    assert store.read("nodes", NODES).count() == 0
    nodes = spark.createDataFrame([("a", "f", 0, 0, "function", "a", 1, 1, True, "h", None)], NODES)
    store.write("r1", {"nodes": nodes})
    store.write("r2", {"nodes": nodes.unionByName(nodes)})
    assert store.current() == "r2" and store.read("nodes", NODES).count() == 2


def test_registry_keeps_labels(spark):
    rows = [(1, "h", "/a", "mine", "open", 1), (2, "h", "/a", None, "open", 2), (3, "g", "/b", None, "open", 3), (4, "g", "/b", None, "remove", 4)]
    df = spark.createDataFrame(rows, "seq int, codebase_hash string, path string, label string, op string, at int")
    assert [(r["codebase_hash"], r["label"]) for r in recent_codebases(df).collect()] == [("h", "mine")]


def test_registry_by_operations(spark, tmp_path):
    from rillstone.sources.store import find_codebase, open_codebase, visit

    at = F.lit("2024-01-01").cast("timestamp")
    first = open_codebase(spark, str(tmp_path), 1, at)
    key = first.first()["codebase_hash"]
    log = first.unionByName(visit(spark, key, "label", 2, at, label="mine")).unionByName(visit(spark, "other", "label", 3, at, label="never opened"))
    assert [(r["path"], r["label"]) for r in find_codebase(log, key).collect()] == [(str(tmp_path), "mine")]
    assert find_codebase(log, "other").count() == 0
    log = log.unionByName(visit(spark, key, "remove", 4, at))
    assert find_codebase(log, key).count() == 0
    log = log.unionByName(open_codebase(spark, str(tmp_path), 5, at))
    assert [r["label"] for r in find_codebase(log, key).collect()] == [None]
    with pytest.raises(FileNotFoundError):
        open_codebase(spark, str(tmp_path / "none"), 1, at)
    (tmp_path / "file").write_text("x")
    with pytest.raises(NotADirectoryError):
        open_codebase(spark, str(tmp_path / "file"), 1, at)


def test_stream_keeps_current(spark, tmp_path):
    from datetime import datetime

    from rillstone.schemas import REVIEW_EVENTS
    from rillstone.streaming import reviews

    make = lambda seq, status: (seq, datetime(2024, 1, 1, seq), "a", "global", "set", status, None, "h", "me", "replaced")
    for i, status in enumerate(("approved", "rejected"), 1):
        spark.createDataFrame([make(i, status)], REVIEW_EVENTS).write.mode("append").parquet(str(tmp_path / "log"))
        reviews.keep_current(reviews.read_events(spark, str(tmp_path / "log")), str(tmp_path / "now"), str(tmp_path / "ck")).awaitTermination()
    assert [r["status"] for r in spark.read.parquet(str(tmp_path / "now" / "v1")).collect()] == ["rejected"]


def test_changes_by_keyed_state(spark, tmp_path):
    from datetime import datetime

    from rillstone.schemas import REVIEW_EVENTS
    from rillstone.streaming import reviews

    make = lambda seq, node, status, hour: (seq, datetime(2024, 1, 1, hour), node, "global", "set", status, None, "h", "me", "replaced")
    batches = [[make(1, "a", "approved", 1), make(2, "b", "approved", 1), make(3, "a", "rejected", 2)], [make(4, "a", "approved", 1), make(2, "b", "approved", 1)], [make(5, "b", "rejected", 3)]]
    for rows in batches:
        spark.createDataFrame(rows, REVIEW_EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        reviews.keep_changes(reviews.read_events(spark, str(tmp_path / "log")), str(tmp_path / "now"), str(tmp_path / "ck")).awaitTermination()
    assert {(r["node_identity"], r["status"], r["event_seq"]) for r in reviews.current_changes(spark, str(tmp_path / "now")).collect()} == {("a", "rejected", 3), ("b", "rejected", 5)}
    sizes = {r["batch"]: r["n"] for r in spark.read.parquet(str(tmp_path / "now")).groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 2, 2: 1}  # late and repeated events change nothing


def test_tokens_from_sql(spark):
    parse.register_tokens(spark)
    files = sources.given_files(spark, [*FILES, ("x.tsx", "const A = () => <p>{f(1)}</p>;"), ("empty.ts", "")])
    files.createOrReplaceTempView("files_to_read")
    got = spark.sql("SELECT * FROM source_tokens(TABLE(files_to_read) PARTITION BY path)")
    want = parse.tokens(files)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
