"""The analysis of source code on files made from the suppliers, each query beside the SQL that says the same.

Every supplier is a file: a route, a service, a repository or a library, by its key. Routes call the service of the
next supplier, services the repository of theirs. A second version of the files changes some by the supplier's nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import canonical_hash
from ..operators import browse, classify, paths, renames, resolve, rules
from ..operators.delta import Comparison, compare
from ..operators.signals import default_signals
from ..sources.files import numbered
from ..sources.parse import Parsed, parse
from .analysis import ORDER, Analysis, analyse
from .registry import query, read

_FOLDERS = ("src/routes/r", "src/services/s", "src/db/d", "src/lib/u")
_ROUTE = """import express from 'express';
import { run@j } from '../services/s@j';
// import { ghost } from './ghost';
export function setup@k(app: Router<string, number>) {
  app.get('/x', function getItem@k@v(req, res) {
    validate(req);
    run@j(req, `a ${title(res)}`);
  });
}
"""
_SERVICE = """import { load@j as fetchOne } from '../db/d@j';
export const run@k = async (id: number, m: Map<string, number>@v): Promise<void> => {
  helper@k(id);
  load@j(id);
};
function helper@k(x) { return x; }
"""
_REPOSITORY = "@vfunction load@k(id: string) {\n@calls}\n"
_LIBRARY = """export default class Box@k {
  put(a, b) { return a; }
}
export { Box@k as Crate };
"""


def code_files(spark: SparkSession, sf_dir: str, head: bool = False) -> DataFrame:
    """path, content and size of a file for each supplier."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    kind, changed = k % 4, F.lit(head)
    change = (
        F.when(kind == 0, F.when(changed & (n % 5 == 0), "Fast").otherwise("")).when(kind == 1, F.when(changed & (n % 2 == 0), ", extra: string").otherwise(""))
        .otherwise(F.when(changed & (n % 3 == 0), "").otherwise("export "))
    )
    text = F.get(F.array(*map(F.lit, (_ROUTE, _SERVICE, _REPOSITORY, _LIBRARY))), kind.cast("int"))
    for mark, value in (("@calls", F.repeat(F.lit("  query(id);\n"), (n % 7).cast("int"))), ("@v", change), ("@k", k.cast("string")), ("@j", (k + 1).cast("string"))):
        text = F.replace(text, F.lit(mark), value)
    path = F.concat(F.get(F.array(*map(F.lit, _FOLDERS)), kind.cast("int")), k.cast("string"), F.lit(".ts"))
    return read(spark, sf_dir, "supplier").select(path.alias("path"), text.alias("content"), F.length(text).cast("long").alias("size"))


def _code(spark: SparkSession, sf_dir: str) -> Parsed:
    return parse(numbered(code_files(spark, sf_dir)), "p")


def _analysis(spark: SparkSession, sf_dir: str, head: bool = False) -> Analysis:
    return analyse(numbered(code_files(spark, sf_dir, head)), "p")


_CODE = """
WITH code AS (
  SELECT s_suppkey AS k, s_suppkey + 1 AS j, s_nationkey AS n, s_suppkey % 4 AS t, (s_suppkey + 1) IN (SELECT s_suppkey FROM supplier) AS next,
    CASE s_suppkey % 4 WHEN 0 THEN 'src/routes/r' WHEN 1 THEN 'src/services/s' WHEN 2 THEN 'src/db/d' ELSE 'src/lib/u' END || s_suppkey || '.ts' AS path,
    CASE s_suppkey % 4 WHEN 0 THEN 'src/services/s' ELSE 'src/db/d' END || (s_suppkey + 1) || '.ts' AS next_path
  FROM supplier
), nodes AS (
  SELECT k, n, t, path, 'setup' || k AS symbol, 'setup' || k AS name, 4 AS start_line, 9 AS end_line, true AS exported, 'app: Router<string, number>' AS params, '' AS return_type FROM code WHERE t = 0
  UNION ALL SELECT k, n, t, path, 'getItem' || k, 'getItem' || k, 5, 8, false, 'req|res', '' FROM code WHERE t = 0
  UNION ALL SELECT k, n, t, path, 'run' || k, 'run' || k, 2, 5, true, 'id: number|m: Map<string, number>', 'Promise<void>' FROM code WHERE t = 1
  UNION ALL SELECT k, n, t, path, 'helper' || k, 'helper' || k, 6, 6, false, 'x', '' FROM code WHERE t = 1
  UNION ALL SELECT k, n, t, path, 'load' || k, 'load' || k, 1, CAST(2 + n % 7 AS INTEGER), true, 'id: string', '' FROM code WHERE t = 2
  UNION ALL SELECT k, n, t, path, 'Box' || k || '.put', 'put', 2, 2, false, 'a|b', '' FROM code WHERE t = 3
), known AS (SELECT *, 'p:' || path || ':' || symbol AS id FROM nodes
), calls AS (
  SELECT path, 'setup' || k AS f, 'get' AS g, NULL AS own, 'cross-file-or-external' AS hint, 5 AS line, 1 AS nth FROM code WHERE t = 0
  UNION ALL SELECT path, 'getItem' || k, 'get', NULL, 'handler-attached', 5, 2 FROM code WHERE t = 0
  UNION ALL SELECT path, 'getItem' || k, 'validate', NULL, 'cross-file-or-external', 6, 3 FROM code WHERE t = 0
  UNION ALL SELECT path, 'getItem' || k, 'run' || j, CASE WHEN next THEN next_path END, 'cross-file-or-external', 7, 4 FROM code WHERE t = 0
  UNION ALL SELECT path, 'getItem' || k, 'title', NULL, 'cross-file-or-external', 7, 5 FROM code WHERE t = 0
  UNION ALL SELECT path, 'run' || k, 'helper' || k, path, NULL, 3, 1 FROM code WHERE t = 1
  UNION ALL SELECT path, 'run' || k, 'load' || j, CASE WHEN next THEN next_path END, 'cross-file-or-external', 4, 2 FROM code WHERE t = 1
  UNION ALL SELECT path, 'load' || k, 'query', NULL, 'cross-file-or-external', CAST(1 + i AS INTEGER), CAST(i AS INTEGER) FROM code, range(1, 8) AS r(i) WHERE t = 2 AND i <= n % 7
), walked AS (
  SELECT k, n, next, 'p:' || path || ':getItem' || k AS entry, ['p:' || path || ':getItem' || k] || CASE WHEN next THEN ['p:' || next_path || ':run' || j, 'p:' || next_path || ':helper' || j] ELSE [] END AS nodes,
    sha256('{"entryNodeIdentity":"p:' || path || ':getItem' || k || '","kind":"path"}') AS path_id
  FROM code WHERE t = 0
), roles AS (
  SELECT *, CASE t WHEN 0 THEN 'route_handler' WHEN 1 THEN 'service' WHEN 2 THEN 'repository' ELSE 'unclassified' END AS role, CASE t WHEN 3 THEN 'none' ELSE 'medium' END AS confidence FROM code
)
"""


@query(_CODE + "SELECT id AS node_identity, 'function' AS kind, name, CAST(start_line AS INTEGER) AS start_line, end_line, exported, params, return_type FROM known")
def p1_code_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions, methods and handlers with their lines and signatures."""
    nodes = _code(spark, sf_dir).nodes
    return nodes.select("node_identity", "kind", "name", "start_line", "end_line", "exported", F.array_join("signature.params", "|").alias("params"), F.col("signature.return_type").alias("return_type"))


@query(_CODE + """SELECT path AS file_path, 'express' AS module, 'default' AS specifier, NULL AS source_path FROM code WHERE t = 0
UNION ALL SELECT path, '../services/s' || j, 'run' || j, CASE WHEN next THEN next_path END FROM code WHERE t = 0
UNION ALL SELECT path, '../db/d' || j, 'load' || j, CASE WHEN next THEN next_path END FROM code WHERE t = 1""")
def j2_code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported names and the files they come from."""
    return resolve.resolve_modules(_code(spark, sf_dir).imports, code_files(spark, sf_dir)).select("file_path", "module", "specifier", "source_path")


@query(_CODE + """SELECT path AS file_path, name, id AS node_identity FROM known WHERE exported
UNION ALL SELECT path, name, NULL FROM code, (VALUES ('default'), ('Crate')) AS v(name) WHERE t = 3""")
def p8_code_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code(spark, sf_dir).exports.select("file_path", "name", "node_identity")


@query(_CODE + """SELECT 'p:' || path || ':' || f AS caller, 'p:' || path || ':' || g AS callee, CAST(line AS INTEGER) AS line, hint IS NOT NULL AS unresolved, hint FROM calls""")
def p9_code_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls as one file tells them."""
    return _code(spark, sf_dir).call_edges.select("caller", "callee", "line", "unresolved", "hint")


@query(_CODE + """SELECT 'p:' || path || ':' || f AS caller, 'p:' || coalesce(own, path) || ':' || g AS callee, own IS NULL AS unresolved, CASE WHEN own IS NULL THEN hint END AS hint FROM calls""")
def j3_code_calls_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with those into other files filled in."""
    code = _code(spark, sf_dir)
    return resolve.resolve_calls(code.call_edges, code.imports, code.exports, code_files(spark, sf_dir)).select("caller", "callee", "unresolved", "hint")


@query(_CODE + """SELECT path, role, CAST(CASE t WHEN 3 THEN 0 ELSE 2 END AS INTEGER) AS score, confidence, false AS conflicting,
  CASE t WHEN 0 THEN 'path:routes' WHEN 1 THEN 'path:services' WHEN 2 THEN 'path:repositories' ELSE '' END AS signals FROM roles""")
def u4_code_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the signals of the language."""
    modules = _code(spark, sf_dir).imports.groupBy(F.col("file_path").alias("path")).agg(F.collect_set("module").alias("modules"))
    files = code_files(spark, sf_dir).select("path").join(modules, "path", "left")
    return classify.classify_files(files, default_signals()).withColumn("signals", F.array_join("signals", ","))


@query(_CODE + "SELECT entry AS node_identity, 'http_route' AS kind, 'GET' AS method FROM walked")
def g6_code_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _code(spark, sf_dir)
    return paths.entry_points(code.call_edges, code.imports).select("node_identity", "kind", "method")


@query(_CODE + """SELECT path_id, entry, CAST(len(nodes) AS INTEGER) AS node_count, CAST(len(nodes) - 1 AS INTEGER) AS max_depth, 'r' || k AS category, CAST(114 AS INTEGER) AS category_order, array_to_string(nodes, '>') AS nodes FROM walked""")
def c8_code_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the whole analysis, with their nodes in order."""
    a = _analysis(spark, sf_dir)
    nested = browse.paths_with_nodes(a.paths, a.path_nodes)
    return nested.withColumn("nodes", F.array_join(F.transform("nodes", lambda x: x["node_identity"]), ">"))


@query(_CODE + """SELECT sha256('{"kind":"classification","nodeIdentity":"file:' || path || '"}') AS key, 'classification' AS kind FROM code WHERE t = 3
UNION ALL SELECT sha256('{"callerIdentity":"p:src/services/s' || w.k + 1 || '.ts:run' || w.k + 1 || '","entryNodeIdentity":"' || entry || '","kind":"path_branch"}'), 'path_branch' FROM walked w JOIN code s ON s.k = w.k + 1 WHERE s.next""")
def c8_code_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the analysis leaves to ask: unsure files, and branches of paths."""
    return _analysis(spark, sf_dir).prep_questions.select("key", "kind")


_RULES = """, callees AS (SELECT 'p:' || path || ':' || f AS id, count(*) AS n_calls, count(DISTINCT CASE WHEN own IS NOT NULL THEN own || ':' || g END) AS n_callees, bool_or(g = 'validate') AS validates FROM calls GROUP BY 1
), results AS (
  SELECT 'builtin:route_handler:auth_check_present' AS rule_id, id AS node_identity, 'skip' AS kind, 'no in-handler auth call detected' AS message FROM known WHERE t = 0
  UNION ALL SELECT 'builtin:route_handler:input_validated', id, CASE WHEN validates THEN 'pass' ELSE 'fail' END, CASE WHEN validates THEN 'invokes a validate/parse/check call' ELSE 'no validate/parse/check call detected in body' END FROM known JOIN callees USING (id) WHERE t = 0
  UNION ALL SELECT 'builtin:service:single_responsibility', id, 'pass', coalesce(n_callees, 0) || ' callees, in budget' FROM known LEFT JOIN callees USING (id) WHERE t = 1
  UNION ALL SELECT 'builtin:repository:narrow_data_access', id, CASE WHEN n_calls IS NULL THEN 'skip' WHEN n_calls > 4 THEN 'fail' ELSE 'pass' END,
    CASE WHEN n_calls IS NULL THEN 'no calls observed (data access via direct expression?)' WHEN n_calls > 4 THEN n_calls || ' calls — wider than a single query' ELSE n_calls || ' calls, narrow' END FROM known LEFT JOIN callees USING (id) WHERE t = 2
)
"""


@query(_CODE + _RULES + "SELECT * FROM results")
def c7_code_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in rules on the functions of the analysis, from its calls."""
    a = _analysis(spark, sf_dir)
    return rules.evaluate_rules(a.nodes, a.classifications, a.call_edges, ORDER)


@query(_CODE + _RULES + """, labels AS (SELECT * FROM (VALUES ('builtin:route_handler:auth_check_present', 'Authentication checked before reaching this handler'), ('builtin:route_handler:input_validated', 'Input validated against a schema'),
  ('builtin:service:single_responsibility', 'Single responsibility'), ('builtin:repository:narrow_data_access', 'Single responsibility — narrow data access')) AS v(rule_id, label)
), items AS (SELECT * FROM (VALUES
  (0, 0, 'Authentication checked before reaching this handler'), (0, 1, 'Authorization (role / ownership) checked'), (0, 2, 'Input validated against a schema'), (0, 3, 'Errors handled consistently with the rest of the API'), (0, 4, 'Response shape matches the documented contract'),
  (1, 0, 'Single responsibility'), (1, 1, 'Caching / performance considerations'), (1, 2, 'Side-effect boundaries are clear'), (1, 3, 'Errors propagate cleanly'),
  (2, 0, 'Single responsibility — narrow data access'), (2, 1, 'Query inputs are typed / validated'), (2, 2, 'Errors map to a domain error, not a raw DB error'),
  (3, 0, 'Single responsibility — does one thing'), (3, 1, 'Boundary clarity — inputs / outputs are explicit'), (3, 2, 'Error handling')) AS v(t, item_ord, label))
SELECT id AS node_identity, item_ord, label, coalesce(kind, 'unchecked') AS state, message FROM known JOIN items USING (t) LEFT JOIN (SELECT * FROM results JOIN labels USING (rule_id)) r ON r.node_identity = id AND r.label = items.label""".replace("SELECT id AS node_identity, item_ord, label,", "SELECT id AS node_identity, item_ord, items.label,"))
def c20_code_checklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to look at in each function, with the rules that answer for it."""
    a = _analysis(spark, sf_dir)
    items = browse.checklist(a.classifications.join(a.nodes.select("node_identity"), "node_identity", "left_semi"))
    return browse.checked_items(items, a.rule_results).select("node_identity", "item_ord", "label", "state", "message")


# --- two versions ---------------------------------------------------------------------------------------------------


def _compared(spark: SparkSession, sf_dir: str) -> Comparison:
    return compare(_analysis(spark, sf_dir), _analysis(spark, sf_dir, True))


_CHANGED = """, changes AS (SELECT *, CASE t WHEN 1 THEN 'param_added' ELSE 'export_removed' END AS change, CASE t WHEN 1 THEN name || ' gained 1 parameter(s)' ELSE name || ' is no longer exported' END AS note
  FROM (SELECT *, 'p:' || path || ':' || CASE t WHEN 1 THEN 'run' ELSE 'load' END || k AS id, CASE t WHEN 1 THEN 'run' ELSE 'load' END || k AS name FROM code WHERE t = 1 AND n % 2 = 0 OR t = 2 AND n % 3 = 0)
), marked AS (SELECT *, sha256('{"kind":"' || change || '","nodeIdentity":"' || id || '"}') AS change_id FROM changes)
"""


@query(_CODE + _CHANGED + "SELECT change_id, id AS node_identity, change, note FROM marked")
def c6_code_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).contract_changes


@query(_CODE + """SELECT entry, path_id AS base_path_id, CASE WHEN n % 5 <> 0 THEN path_id END AS head_path_id, CASE WHEN n % 5 = 0 THEN 'net_gone' ELSE 'unchanged' END AS classification, '' AS added_nodes, CASE WHEN n % 5 = 0 THEN array_to_string(nodes, '>') ELSE '' END AS removed_nodes FROM walked
UNION ALL SELECT entry || 'Fast', NULL, sha256('{"entryNodeIdentity":"' || entry || 'Fast","kind":"path"}'), 'net_new', array_to_string([entry || 'Fast'] || nodes[2:], '>'), '' FROM walked WHERE n % 5 = 0""")
def c6_code_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).path_deltas.withColumns({c: F.array_join(c, ">") for c in ("added_nodes", "removed_nodes")})


@query(_CODE + _CHANGED + """SELECT change_id, entry || CASE WHEN w.n % 5 = 0 THEN 'Fast' ELSE '' END AS caller, true AS on_walked_path, w.n % 5 = 0 AS on_changed_path FROM marked m JOIN walked w ON w.k + 1 = m.k WHERE m.t = 1""")
def c6_code_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).affected_callers


@query(_CODE + _CHANGED + """SELECT w.path_id, change_id AS change_ids FROM marked m JOIN walked w ON w.k + 1 = m.k WHERE m.t = 1 AND w.n % 5 <> 0""")
def c6_code_crossed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).indirect_impact.withColumn("change_ids", F.array_join("change_ids", ","))


@query(_CODE + """SELECT id AS old_identity, id || 'Fast' AS new_identity, path AS file_path, 'function' AS kind, 2.0::DOUBLE / 3 AS similarity FROM known WHERE t = 0 AND n % 5 = 0 AND name LIKE 'getItem%'""")
def c5_code_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renames.rename_candidates(_analysis(spark, sf_dir).nodes, _analysis(spark, sf_dir, True).nodes)


# --- what the screens ask -------------------------------------------------------------------------------------------


def _reviews(analysis: Analysis) -> tuple[DataFrame, DataFrame]:
    """Reviews of what services and repositories export, some of an older text, and the hashes of all functions."""
    nodes = analysis.nodes
    k = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    rows = nodes.where("exported").select(
        "node_identity", F.lit("global").alias("scope"), F.when(k % 3 == 0, "approved").when(k % 3 == 1, "rejected").otherwise("info_requested").alias("status"),
        F.when(k % 5 == 0, F.lit("old")).otherwise(F.lit("")).alias("code_hash"), k.alias("event_seq"), "name",
    )
    return rows.where(~F.col("name").startswith("setup")).drop("name"), nodes.select("node_identity", "content_hash")


_STATES = """, states AS (SELECT *, CASE WHEN NOT exported OR t = 0 THEN 'never_reviewed' WHEN k % 5 = 0 THEN 'reviewed_stale' WHEN k % 3 = 2 THEN 'info_requested' ELSE 'reviewed_current' END AS state,
  CASE WHEN NOT exported OR t = 0 THEN NULL WHEN k % 3 = 0 THEN 'approved' WHEN k % 3 = 1 THEN 'rejected' ELSE 'info_requested' END AS status FROM known)
"""


@query(_CODE + _STATES + """SELECT path, role, confidence, CAST(count(*) FILTER (state = 'reviewed_current' AND status = 'approved') AS BIGINT) AS approved, CAST(count(*) FILTER (state = 'reviewed_current' AND status = 'rejected') AS BIGINT) AS rejected,
  CAST(count(*) FILTER (state = 'info_requested') AS BIGINT) AS info_requested, CAST(count(*) FILTER (state = 'reviewed_stale') AS BIGINT) AS stale, CAST(count(*) FILTER (state = 'never_reviewed') AS BIGINT) AS never_reviewed, CAST(count(*) AS BIGINT) AS total
FROM roles JOIN states USING (path) GROUP BY ALL""")
def j8_code_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files with their role and the states of their functions."""
    a = _analysis(spark, sf_dir)
    return browse.file_tree(a.files, a.nodes, a.classifications, *_reviews(a))


@query(_CODE + _STATES + """SELECT position, node_identity, name, role, state FROM (SELECT unnest(nodes) AS node_identity, CAST(unnest(range(len(nodes))) AS INTEGER) AS position FROM walked WHERE k = 4)
JOIN states ON id = node_identity JOIN (SELECT path, role FROM roles) r ON r.path = states.path""")
def j7_code_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path with its functions, their roles and states."""
    a = _analysis(spark, sf_dir)
    wanted = spark.range(1).select(canonical_hash(kind=F.lit("path"), entryNodeIdentity=F.lit("p:src/routes/r4.ts:getItem4")).alias("x")).first()["x"]
    nodes = a.nodes.select("node_identity", "name")
    return browse.get_path(a.path_nodes, nodes, a.classifications, *_reviews(a), wanted).select("position", "node_identity", "name", "role", "state")


@query(_CODE + _STATES + """SELECT id AS node_identity, name, CAST(start_line AS INTEGER) AS start_line, role, state FROM states JOIN (SELECT path, role FROM roles) r USING (path) WHERE path = 'src/services/s5.ts'""")
def j9_code_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions of one file in order."""
    a = _analysis(spark, sf_dir)
    files = a.files.withColumn("size", F.lit(0))
    return browse.file_detail(files, a.nodes, a.classifications, *_reviews(a), "src/services/s5.ts")[1].select("node_identity", "name", "start_line", "role", "state")


@query(_CODE + "SELECT k.id AS callee, k.name FROM calls JOIN known k ON k.path = own AND k.symbol = g WHERE f = 'run5'")
def j10_code_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known functions that one calls, in order of their first call."""
    a = _analysis(spark, sf_dir)
    return browse.callees_of(a.call_edges, a.nodes.select("node_identity", "name"), F.lit("p:src/services/s5.ts:run5"), ORDER)


@query(_CODE + "SELECT entry, 'GET' AS method, 'r' || k AS category, substr(entry, 3) AS label, 'getItem' || k AS entry_name FROM walked")
def o7_code_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by category, with their names."""
    a = _analysis(spark, sf_dir)
    named = browse.entry_names(browse.entries_by_category(a.entry_points, a.paths), a.nodes)
    return named.select("entry", "method", "category", "label", "entry_name")


@query(_CODE + """, bodies AS (
  SELECT t, k, name, id, CASE WHEN t = 0 AND name LIKE 'setup%' THEN 'export function setup' || k || '(app: Router<string, number>) {' || chr(10) || '  app.get(''/x'', function getItem' || k || '(req, res) {' || chr(10)
      || '    validate(req);' || chr(10) || '    run' || (k + 1) || '(req, `a ${title(res)}`);' || chr(10) || '  });' || chr(10) || '}'
    WHEN t = 0 THEN '  app.get(''/x'', function getItem' || k || '(req, res) {' || chr(10) || '    validate(req);' || chr(10) || '    run' || (k + 1) || '(req, `a ${title(res)}`);' || chr(10) || '  });'
    WHEN t = 1 AND name LIKE 'run%' THEN 'export const run' || k || ' = async (id: number, m: Map<string, number>): Promise<void> => {' || chr(10) || '  helper' || k || '(id);' || chr(10) || '  load' || (k + 1) || '(id);' || chr(10) || '};'
    WHEN t = 1 THEN 'function helper' || k || '(x) { return x; }'
    WHEN t = 2 THEN 'export function load' || k || '(id: string) {' || chr(10) || repeat('  query(id);' || chr(10), CAST(n % 7 AS INTEGER)) || '}'
    ELSE '  put(a, b) { return a; }' END AS body FROM known)
SELECT id AS node_identity, body FROM bodies""")
def j29_code_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all functions, from the files."""
    return browse.node_body(_analysis(spark, sf_dir).nodes, code_files(spark, sf_dir)).select("node_identity", "body")


# --- what is hard to tell apart -------------------------------------------------------------------------------------

_CARD = """import { Row@k } from './row';
const label@k = (n) => `n ${`deep ${fmt@k(n)}`}`;
export const Card@k = ({ items }: Props) => (
  <ul title="call(me)" onClick={() => pick@k(items)}>
    it's not(a call) {items.map((i) => <li key={i}>{label@k(i)}</li>)}
    <Row@k text={`a ${'b'}`} /> {/* note(1) */} <></>
  </ul>
);
"""
_STORE = """export class Store@k {
  mapped = (a) => lost@k(a);
  get size() { return count@k(); }
  @Timed({ unit: 1 })
  find(key: string): string;
  find(key: any): { hit: boolean } {
    function probe() { return peek@k(key); }
    return probe();
  }
  static async *each<T>(of: T[]) { yield this.find(of); }
  constructor(seed = make@k()) { super(seed); }
}
export function open@k(path: string): void;
export function open@k(path: any) { return new Store@k(path).find(path); }
"""
_VALUES = """export const { a@k, b: [c@k] } = make@k(), other@k = (x): x is number => test@k(x);
const either@k = flag ? () => one@k() : two;
const waited@k = await later@k();
const built@k = new Thing@k(1);
const chain@k = start@k
  .then(() => next@k())
let typed@k: Map<string, () => void> = typed@k<Map<string, Array<Record<string, { a: number, b: [x: string, y: string], c: Map<string, Set<number>>, d: Array<Array<string>> }>>>>(1)
"""


def hard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of a file for each supplier: tags and templates, a class with all kinds of members, or variables by what they are set to."""
    k = F.col("s_suppkey")
    text = F.get(F.array(*map(F.lit, (_CARD, _STORE, _VALUES))), (k % 3).cast("int"))
    path = F.concat(F.lit("src/h"), k.cast("string"), F.when(k % 3 == 0, ".tsx").otherwise(".ts"))
    return read(spark, sf_dir, "supplier").select(path.alias("path"), F.replace(text, F.lit("@k"), k.cast("string")).alias("content"))


_HARD = """
WITH hard AS (SELECT s_suppkey AS k, s_suppkey % 3 AS t, 'p:src/h' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '.tsx:' ELSE '.ts:' END AS p FROM supplier
)"""


@query(_HARD + """, made AS (SELECT * FROM (VALUES
  (0, 'label@', 'label@', 'function', 2, 2, false, 'n', ''), (0, 'Card@', 'Card@', 'component', 3, 8, true, '{ items }: Props', ''),
  (1, 'Store@.find', 'find', 'function', 6, 9, false, 'key: any', '{ hit: boolean }'), (1, 'Store@.each', 'each', 'function', 10, 10, false, 'of: T[]', ''), (1, 'open@', 'open@', 'function', 14, 14, true, 'path: any', ''),
  (2, '{ a@, b: [c@] }', '{ a@, b: [c@] }', 'function', 1, 1, true, NULL, NULL), (2, 'other@', 'other@', 'function', 1, 1, true, 'x', 'x is number'),
  (2, 'chain@', 'chain@', 'function', 5, 6, false, NULL, NULL), (2, 'typed@', 'typed@', 'function', 7, 7, false, NULL, NULL)) AS v(t, symbol, name, kind, start_line, end_line, exported, params, return_type))
SELECT p || replace(symbol, '@', k::VARCHAR) AS node_identity, replace(name, '@', k::VARCHAR) AS name, kind, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, exported, params, return_type FROM hard JOIN made USING (t)""")
def p2_code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions among tags, members, overloads, patterns and values of all kinds."""
    nodes = parse(numbered(hard_files(spark, sf_dir)), "p").nodes
    return nodes.select("node_identity", "name", "kind", "start_line", "end_line", "exported", F.array_join("signature.params", "|").alias("params"), F.col("signature.return_type").alias("return_type"))


@query(_HARD + """, made AS (SELECT * FROM (VALUES
  (0, 'label@', 'fmt@', 2), (0, 'Card@', 'pick@', 4), (0, 'Card@', 'map', 5), (0, 'Card@', '=label@', 5),
  (1, 'Store@.find', 'peek@', 7), (1, 'Store@.find', 'probe', 8), (1, 'Store@.each', '=Store@.find', 10), (1, 'open@', '=Store@.find', 14),
  (2, '{ a@, b: [c@] }', 'make@', 1), (2, 'other@', 'test@', 1), (2, 'chain@', 'then', 5), (2, 'chain@', 'next@', 6), (2, 'typed@', 'typed@', 7)) AS v(t, caller, callee, line))
SELECT p || replace(caller, '@', k::VARCHAR) AS caller, p || replace(replace(callee, '@', k::VARCHAR), '=', '') AS callee, CAST(line AS INTEGER) AS line, CASE WHEN callee NOT LIKE '=%' THEN 'cross-file-or-external' END AS hint FROM hard JOIN made USING (t)""")
def p14_code_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls among tags, templates in templates, members and type arguments of any length; text between tags calls nothing."""
    return parse(numbered(hard_files(spark, sf_dir)), "p").call_edges.select("caller", "callee", "line", "hint")


@query("""WITH told AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), coded AS (SELECT *, length(text) - length(replace(text, chr(10), '')) AS breaks FROM told)
SELECT 'd' || doc_id || '.js' AS file_path, 'p:d' || doc_id || '.js:f' AS caller, 'p:d' || doc_id || '.js:' || name AS callee, CAST(line + CASE WHEN after THEN breaks ELSE 0 END AS INTEGER) AS line
FROM coded, (VALUES ('log', 2, false), ('inner', 2, true), ('put', 3, true), ('last', 4, true)) AS v(name, line, after)""")
def p1_code_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls around whole documents that stand in a template, a string and a comment, however long."""
    body = F.col("body")
    template = F.replace(F.replace(F.replace(body, F.lit("\\"), F.lit("\\\\")), F.lit("`"), F.lit("\\`")), F.lit("$"), F.lit("\\$"))
    quoted = F.to_json(F.struct(body.alias("x")))
    code = F.concat(
        F.lit("function f(x) {\n  log(`"), template, F.lit("${inner(x)}`);\n  put("), F.regexp_replace(quoted, r'^\{"x":|\}$', ""), F.lit(");\n  last('"),
        F.regexp_replace(body, r"['\\\n]", "-"), F.lit("'); // "), F.replace(body, F.lit("\n"), F.lit(" ")), F.lit("\n}\n"),
    )
    # documents are numbered as they are, as code holds each of them four times
    docs = numbered(read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".js")).alias("path"), F.coalesce("text", F.lit("")).alias("body")))
    return parse(docs.select("path", "file_ord", code.alias("content")), "p").call_edges.select("file_path", "caller", "callee", "line")


_PLACES = (
    "src/__tests__/f@.ts", "src/types/f@.d.ts", "f@/vite.config.ts", "src/handlers/f@.ts", "src/services/f@.ts",
    "src/middleware/f@.ts", "src/useF@.ts", "src/components/f@.tsx", "src/pages/f@.jsx", "bin/f@.js",
    "db/seeds/f@.ts", "test/fixtures/f@.ts", "src/f@Repo.ts", "src/orm@.ts", "src/mail@.ts", "src/plain@.ts",
)


@query("""WITH places AS (SELECT * FROM (VALUES
  (0, 'src/__tests__/f@.ts', 'test', 3, 'high', 'path:tests'), (1, 'src/types/f@.d.ts', 'type_only', 3, 'high', 'filename:type-only'), (2, 'f@/vite.config.ts', 'config', 3, 'high', 'filename:config'),
  (3, 'src/handlers/f@.ts', 'route_handler', 2, 'medium', 'path:routes'), (4, 'src/services/f@.ts', 'service', 2, 'medium', 'path:services'), (5, 'src/middleware/f@.ts', 'middleware', 2, 'medium', 'path:middleware'),
  (6, 'src/useF@.ts', 'hook', 2, 'medium', 'path:hooks'), (7, 'src/components/f@.tsx', 'component', 2, 'medium', 'path:components'), (8, 'src/pages/f@.jsx', 'page', 2, 'medium', 'path:pages'),
  (9, 'bin/f@.js', 'script', 2, 'medium', 'path:scripts'), (10, 'db/seeds/f@.ts', 'seed', 3, 'high', 'path:seeds'), (11, 'test/fixtures/f@.ts', 'fixture', 3, 'high', 'path:fixtures'),
  (12, 'src/f@Repo.ts', 'repository', 2, 'medium', 'path:repositories'), (13, 'src/orm@.ts', 'repository', 2, 'medium', 'import:db-client'), (14, 'src/mail@.ts', 'client', 1, 'low', 'import:external-client'),
  (15, 'src/plain@.ts', 'unclassified', 0, 'none', '')) AS v(t, place, role, score, confidence, signals))
SELECT replace(place, '@', p_partkey::VARCHAR) AS path, role, CAST(score AS INTEGER) AS score, confidence, signals FROM part JOIN places ON t = p_partkey % 16""")
def u4_code_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by every signal of the language, those of imports read from their source."""
    k = F.col("p_partkey")
    place = F.get(F.array(*map(F.lit, _PLACES)), (k % len(_PLACES)).cast("int"))
    imports = F.when(k % 16 == 13, "import { x } from 'drizzle-orm/pg';").when(k % 16 == 14, "import mail from 'nodemailer';").otherwise("import { x } from 'other';")
    files = numbered(read(spark, sf_dir, "part").select(F.replace(place, F.lit("@"), k.cast("string")).alias("path"), imports.alias("content")))
    roles = analyse(files, "p").roles
    return roles.select("path", "role", "score", "confidence", F.array_join("signals", ",").alias("signals"))
