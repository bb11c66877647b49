"""Further operators on the test tables, each beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.lineage import running
from ..operators import browse, comments, edits, paths, prep, renames, rules
from ..sources.files import LARGEST, in_revision, name_status, numbered
from ..sources.parse import parse
from .code_queries import _CODE, _analysis, _code, code_files
from .incremental import IncrementalAnalysis
from .registry import query, read


@query("""SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN lang END AS role, CASE WHEN doc_id % 4 < 2 THEN n_chars ELSE -1 END AS score FROM documents""")
def x22_parsed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model, fenced, bare, without a field, or no JSON at all, read as what was asked for."""
    kind = F.col("doc_id") % 4
    said = F.to_json(F.struct(F.col("lang").alias("role"), F.col("n_chars").alias("score")))
    text = F.when(kind == 0, F.concat(F.lit("Sure:\n```json\n"), said, F.lit("\n```\nDone."))).when(kind == 1, F.concat(F.lit(" "), said, F.lit("\n"))).when(kind == 2, F.to_json(F.struct(F.col("lang").alias("role")))).otherwise(F.col("text"))
    found = ids.parsed_response(text, "role string, score long", ["role", "score"])
    return read(spark, sf_dir, "documents").select("doc_id", found["role"].alias("role"), F.coalesce(found["score"], F.lit(-1)).alias("score"))


@query("""SELECT doc_id, '{"n":' || doc_id || '}' AS inner_text FROM documents""")
def x21_unfenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in a fence, or the text itself."""
    said = F.concat(F.lit('{"n":'), F.col("doc_id").cast("string"), F.lit("}"))
    fenced = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x ```  "), said, F.lit(" ``` y"))).otherwise(said)
    return read(spark, sf_dir, "documents").select("doc_id", ids.unfenced(fenced).alias("inner_text"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(CAST(extract('milliseconds' FROM ts) AS BIGINT) % 1000 AS VARCHAR), 3, '0') || 'Z' AS at FROM events""")
def x26_iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", ids.iso_time(F.col("ts")).alias("at"))


@query("""SELECT 'file:d' || d.doc_id AS node_identity, CASE WHEN l.quality IS NOT NULL THEN CASE l.quality WHEN 1 THEN 'service' ELSE 'helper' END ELSE d.lang END AS role,
  CASE WHEN l.quality IS NOT NULL THEN 'high' ELSE 'low' END AS confidence, l.quality IS NULL AS conflicting FROM documents d LEFT JOIN labels l USING (doc_id)""")
def c11_answered_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of files after the answers to questions about them."""
    node = F.concat(F.lit("file:d"), F.col("doc_id").cast("string"))
    key = F.concat(F.lit("q"), F.col("doc_id").cast("string"))
    docs = read(spark, sf_dir, "documents")
    roles = docs.select(node.alias("node_identity"), F.col("lang").alias("role"), F.lit("low").alias("confidence"), F.lit(True).alias("conflicting"))
    questions = docs.select(key.alias("key"), F.lit("classification").alias("kind"), ids.canonical_json(nodeIdentity=node).alias("context"))
    said = ids.canonical_json(kind=F.lit("classification"), classification=F.when(F.col("quality") == 1, "service").otherwise("helper"))
    answers = read(spark, sf_dir, "labels").where(F.col("quality").isNotNull()).select(key.alias("question_key"), said.alias("answer"), F.lit("2024-01-01").cast("timestamp").alias("answered_at"))
    return prep.apply_class_answers(roles, questions, answers)


@query("""WITH log AS (
  SELECT o_custkey AS rule_id, o_orderkey AS seq, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth, o_orderstatus AS s FROM orders
), said AS (
  SELECT rule_id, seq, nth, CASE WHEN nth = 1 THEN 'create' WHEN s = 'P' THEN 'remove' ELSE 'update' END AS op, CASE WHEN p NOT LIKE '3%' THEN p END AS title,
    CASE WHEN nth = 1 OR p LIKE '2%' THEN '{"tier":"' || CASE p[1] WHEN '1' THEN 'shell' WHEN '2' THEN 'llm' ELSE 'other' END || '"}' END AS definition, CASE p[1] WHEN '1' THEN false WHEN '5' THEN true END AS enabled FROM log)
SELECT rule_id, arg_max(title, seq) FILTER (title IS NOT NULL) AS title, CASE arg_min(definition, seq) WHEN '{"tier":"shell"}' THEN 'shell' WHEN '{"tier":"llm"}' THEN 'llm' ELSE 'builtin' END AS tier,
  arg_max(definition, seq) FILTER (definition IS NOT NULL) AS definition, coalesce(arg_max(enabled, seq) FILTER (enabled IS NOT NULL), true) AS enabled
FROM said GROUP BY rule_id HAVING NOT bool_or(op = 'remove')""")
def c17_project_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a project as a log of versions amounts to them: customers as rules, their orders as versions."""
    p, first = F.substring("o_orderpriority", 1, 1), F.col("nth") == 1
    log = read(spark, sf_dir, "orders").withColumn("nth", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))).select(
        F.col("o_custkey").alias("rule_id"), F.col("o_orderkey").alias("seq"), F.when(first, "create").when(F.col("o_orderstatus") == "P", "remove").otherwise("update").alias("op"),
        F.lit("service").alias("classification"), F.when(p != "3", F.col("o_orderpriority")).alias("title"),
        F.when(first | (p == "2"), ids.canonical_json(tier=F.when(p == "1", "shell").when(p == "2", "llm").otherwise("other"))).alias("definition"),
        F.when(p == "1", False).when(p == "5", True).alias("enabled"), F.col("o_orderdate").cast("timestamp").alias("at"),
    )
    return rules.project_rules(log).select("rule_id", "title", "tier", "definition", "enabled")


@query("""SELECT CASE p_partkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'R' ELSE 'A' END AS status, CASE WHEN p_partkey % 3 = 1 THEN 'old/' || p_partkey || '.ts' END AS old_path, 'src/' || p_partkey || '.ts' AS path FROM part""")
def s10_name_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files as a version control system lists them."""
    k = F.col("p_partkey").cast("string")
    new = F.concat(F.lit("src/"), k, F.lit(".ts"))
    kind = F.col("p_partkey") % 3
    line = F.when(kind == 0, F.concat(F.lit("M\t"), new)).when(kind == 1, F.concat(F.lit("R097\told/"), k, F.lit(".ts\t"), new)).otherwise(F.concat(F.lit("A\t"), new))
    return name_status(read(spark, sf_dir, "part").select(line.alias("line")))


@query("""SELECT event_id AS comment_id, CASE WHEN event_id % 5 = 0 AND event_id % 7 <> 0 THEN 'edited' ELSE event_type END AS body, event_id % 7 = 0 OR event_id % 11 = 0 AS archived FROM events
UNION ALL SELECT -event_id, 'new', event_id % 11 = 0 FROM events WHERE event_id % 13 = 0""")
def k8_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments added, archived, and edited unless they are archived; those of gone functions are archived as well."""
    at, e = F.lit("2024-01-01").cast("timestamp"), read(spark, sf_dir, "events")
    make = lambda rows, key, body: rows.select(
        key.cast("long").alias("comment_id"), F.lit("function").alias("anchor_kind"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file_path"), F.col("event_id").cast("string").alias("function_identity"),
        F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), body.alias("body"), F.lit("me").alias("reviewer_id"), F.col("ts").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("archived_at"),
    )
    log = comments.archive(make(e, F.col("event_id"), F.col("event_type")), e.where("event_id % 7 = 0").select(F.col("event_id").alias("comment_id")), at)
    log = comments.edit(log, e.where("event_id % 5 = 0").select(F.col("event_id").alias("comment_id"), F.lit("edited").alias("body")))
    log = comments.add(log, make(e.where("event_id % 13 = 0"), -F.col("event_id"), F.lit("new")))
    alive = e.where("event_id % 11 <> 0").select(F.col("event_id").cast("string").alias("node_identity"))
    log = comments.archive_orphans(log, alive, e.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path")), at)
    return log.select("comment_id", "body", F.col("archived_at").isNotNull().alias("archived"))


@query("""SELECT event_id AS comment_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM events WHERE event_type = 'purchase' AND event_id % 7 <> 0""")
def c16_listed_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of one file that are not archived, oldest first, with their place in that order."""
    at = F.when(F.col("event_id") % 7 == 0, F.lit("2024-01-01").cast("timestamp"))
    log = read(spark, sf_dir, "events").select(
        F.col("event_id").cast("long").alias("comment_id"), F.lit("file").alias("anchor_kind"), F.col("event_type").alias("file_path"), F.lit(None).cast("string").alias("function_identity"),
        F.col("ts").cast("timestamp").alias("created_at"), at.alias("archived_at"),
    )
    listed = comments.list_comments(log, file_path="purchase").withColumn("_nth", F.monotonically_increasing_id())
    return running(listed, [F.col("_nth")], {"position": F.lit(1)}).select("comment_id", F.col("position").cast("long").alias("position"))


@query("""SELECT p_partkey AS path_id, CASE WHEN p_partkey % 4 = 0 THEN 'given' ELSE p_name END AS category, CAST(CASE WHEN p_partkey % 4 = 0 THEN 7 ELSE p_partkey END AS INTEGER) AS category_order FROM part""")
def c15_given_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories that a language model gave, laid over the derived ones."""
    part = read(spark, sf_dir, "part")
    derived = part.select(F.col("p_partkey").alias("path_id"), F.col("p_name").alias("category"), F.col("p_partkey").cast("int").alias("category_order"))
    given = part.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("path_id"), F.lit("given").alias("category"), F.lit(7).alias("category_order"))
    return paths.with_categories(derived, given)


_LCS = "list_reduce(list_prepend(list_transform(range(len({b}) + 1), lambda x: CAST(0 AS BIGINT)), list_transform({a}, lambda x: [CAST(x AS BIGINT)])), lambda row, x: list_reduce(list_prepend([CAST(0 AS BIGINT)], list_transform(range(1, len({b}) + 1), lambda j: [CAST(CASE WHEN {b}[j] = x[1] THEN row[j] + 1 ELSE -1 END AS BIGINT), row[j + 1]])), lambda done, c: list_append(done, greatest(c[1], c[2], done[-1]))))[-1]"


@query("""WITH lists AS (SELECT l_orderkey AS k, list(l_partkey % 5 ORDER BY l_linenumber, l_partkey % 5) AS a, list(l_suppkey % 5 ORDER BY l_linenumber, l_suppkey % 5) AS b FROM lineitem GROUP BY 1
), common AS (SELECT k, a, b, """ + _LCS.format(a="a", b="b") + """ AS n FROM lists)
SELECT k AS order_key, CAST(n AS INTEGER) AS kept, CAST(len(a) - n AS INTEGER) AS removed, CAST(len(b) - n AS INTEGER) AS added FROM common""")
def d13_sequence_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many positions of a path a shortest edit script keeps, removes and adds: parts of an order against its suppliers."""
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col(c) % 5).alias("x")))), lambda y: y["x"].cast("string"))
    lists = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(listed("l_partkey").alias("a"), listed("l_suppkey").alias("b"))
    return edits.sequence_edits(lists, "a", "b").select(F.col("l_orderkey").alias("order_key"), *[F.size(c).alias(c) for c in ("kept", "removed", "added")])


@query("""WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), made AS (SELECT doc_id, l, len(l) AS n, doc_id % 3 AS before FROM docs)
SELECT doc_id AS comment_id, CAST(1 + before AS INTEGER) AS new_start, CAST(n + before AS INTEGER) AS new_end FROM made""")
def x14_moved_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments on all lines of a document, after up to two lines were put before it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    head = docs.select("path", F.concat(F.repeat(F.lit("\x01 a line of its own\n"), (F.col("doc_id") % 3).cast("int")), "content").alias("content"))
    notes = docs.select(F.col("doc_id").alias("comment_id"), F.col("path").alias("file_path"), F.lit(1).alias("line_start"), F.size(F.split("content", "\n")).alias("line_end"))
    return edits.moved_comments(notes, edits.line_runs(docs, head), docs).select("comment_id", F.col("new_start").cast("int").alias("new_start"), F.col("new_end").cast("int").alias("new_end"))


@query(_CODE + """, texts AS (SELECT *, CASE WHEN t = 0 AND name LIKE 'setup%' THEN 'export function setup' || k || '(app: Router<string, number>) { app.get(''/x'', ' || handler || '); }' WHEN t = 0 THEN handler
    WHEN t = 1 AND name LIKE 'run%' THEN 'run' || k || ' = async (id: number, m: Map<string, number>): Promise<void> => { helper' || k || '(id); load' || (k + 1) || '(id); }'
    WHEN t = 1 THEN 'function helper' || k || '(x) { return x; }' WHEN t = 2 THEN 'export function load' || k || '(id: string) { ' || repeat('query(id); ', CAST(n % 7 AS INTEGER)) || '}' ELSE 'put(a, b) { return a; }' END AS body
  FROM (SELECT *, 'function getItem' || k || '(req, res) { validate(req); run' || (k + 1) || '(req, `a ${title(res)}`); }' AS handler FROM known))
SELECT id AS node_identity, sha256(body) AS content_hash FROM texts""")
def p5_code_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of functions' texts without comments, white space as single blanks."""
    return _code(spark, sf_dir).nodes.select("node_identity", "content_hash")


@query(_CODE + """SELECT entry || CASE WHEN n % 5 = 0 THEN 'Fast' ELSE '' END AS entry, array_to_string([entry || CASE WHEN n % 5 = 0 THEN 'Fast' ELSE '' END] || nodes[2:], '>') AS nodes,
  n % 5 = 0 OR coalesce((SELECT bool_or(s_nationkey % 3 = 0) FROM supplier s WHERE s.s_suppkey = k + 2), false) AS rewalked FROM walked""")
def c8_code_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the second version, going on from the analysis of the first: only entries that are new or meet other callees are walked anew."""
    before = _analysis(spark, sf_dir)
    found = IncrementalAnalysis(numbered(code_files(spark, sf_dir, True)), "p", before)
    again = found.rewalked.select(F.col("node_identity").alias("entry"), F.lit(True).alias("rewalked"))
    nested = browse.paths_with_nodes(found.paths, found.path_nodes).select("entry", F.array_join(F.transform("nodes", lambda x: x["node_identity"]), ">").alias("nodes"))
    return nested.join(again, "entry", "left").withColumn("rewalked", F.coalesce("rewalked", F.lit(False)))


@query(_CODE + """SELECT id AS old_identity, id || 'Fast' AS new_identity, round(0.75::DOUBLE + 0.25::DOUBLE * 5 / 7, 9) AS similarity FROM known WHERE t = 0 AND n % 5 = 0 AND name LIKE 'getItem%'""")
def d7_code_shape_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: renamed handlers by the shape of their code, their names and signatures."""
    before, after = (parse(numbered(code_files(spark, sf_dir, head)), "p") for head in (False, True))
    return renames.shape_renames(before, after).withColumn("similarity", F.round("similarity", 9))


@query("""SELECT p_partkey AS part, CASE p_partkey % 6 WHEN 0 THEN 'src/a.ts' ELSE 'src/deep/e.jsx' END AS path FROM part WHERE p_partkey % 6 IN (0, 4) AND p_size * 20000 <= 524288""")
def s4_source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and sizes that are source code of a revision: neither other files nor installed or built ones, nor too large."""
    places = ("src/a.ts", "node_modules/b.ts", "pkg/dist/c.js", "src/d.md", "src/deep/e.jsx", "src/f.ts.txt")
    k = F.col("p_partkey")
    files = read(spark, sf_dir, "part").select(k.alias("part"), F.get(F.array(*map(F.lit, places)), (k % 6).cast("int")).alias("path"), (F.col("p_size") * 20_000).alias("size"))
    return files.where(in_revision(F.col("path")) & (F.col("size") <= LARGEST)).select("part", "path")
