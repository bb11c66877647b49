"""The operators on the test tables, each beside the SQL that says the same.

The tables stand for what the operators expect: documents and labels for nodes and
reviews, events for calls and review events, orders for two snapshots, parts for
names, pages for paths. Every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.lineage import cut
from ..functions.state import choose_review, runtime_kind
from ..operators import browse, classify, comments, delta, paths, prep, renames, resolve, review, rules
from ..operators.signals import HIGH, LOW, MEDIUM, Signal
from .registry import QUERIES, SQL, query, read

# --- reviews of documents: coverage and states -------------------------------------------------------------------


def _document_reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as nodes, their hashes, and labels as reviews: some without a hash, some of an older text."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_identity"), "lang", "source", F.sha2("text", 256).alias("content_hash"))
    labels = read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "node_identity")
    recorded = F.when(F.col("node_identity") % 7 == 0, F.lit("")).when(F.col("node_identity") % 5 == 0, F.lit("old")).otherwise(F.col("content_hash"))
    reviews = labels.join(docs, "node_identity").select(
        "node_identity", F.lit("global").alias("scope"), F.when(F.col("quality") == 1, "approved").when(F.col("toxic") == 1, "rejected").otherwise("info_requested").alias("status"),
        recorded.alias("code_hash"), F.col("node_identity").alias("event_seq"),
    )
    return docs, reviews, docs.select("node_identity", "content_hash")


_REVIEWED = """
WITH reviewed AS (
  SELECT d.doc_id, d.lang, d.source, sha256(d.text) AS content_hash, l.doc_id AS labelled,
    CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 1 THEN 'approved' WHEN l.toxic = 1 THEN 'rejected' ELSE 'info_requested' END AS status,
    CASE WHEN d.doc_id % 7 = 0 THEN '' WHEN d.doc_id % 5 = 0 THEN 'old' ELSE sha256(d.text) END AS code_hash
  FROM documents d LEFT JOIN labels l USING (doc_id)
), kinds AS (
  SELECT *, CASE WHEN status IS NULL THEN 'never_reviewed' WHEN code_hash <> '' AND code_hash <> content_hash THEN 'reviewed_stale'
    WHEN status = 'info_requested' THEN 'info_requested' WHEN status = 'approved' THEN 'reviewed_current_approved' ELSE 'reviewed_current_rejected' END AS kind
  FROM reviewed
)
"""
_COUNTS = """CAST(count(*) FILTER (kind = 'reviewed_current_approved') AS BIGINT) AS approved, CAST(count(*) FILTER (kind = 'reviewed_current_rejected') AS BIGINT) AS rejected,
  CAST(count(*) FILTER (kind = 'info_requested') AS BIGINT) AS info_requested, CAST(count(*) FILTER (kind = 'reviewed_stale') AS BIGINT) AS stale,
  CAST(count(*) FILTER (kind = 'never_reviewed') AS BIGINT) AS never_reviewed, CAST(count(*) AS BIGINT) AS total"""


@query(_REVIEWED + f"""SELECT lang, {_COUNTS}, CAST(count(*) FILTER (kind <> 'never_reviewed') AS DOUBLE) / count(*) AS coverage_path,
  CAST(count(*) FILTER (kind = 'reviewed_current_approved') AS DOUBLE) / count(*) AS coverage_full FROM kinds GROUP BY lang""")
def a3_review_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, reviews, hashes = _document_reviews(spark, sf_dir)
    return browse.progress(nodes.select("node_identity", "lang"), reviews, hashes, ["lang"])


@query(_REVIEWED + f"SELECT source AS path, {_COUNTS} FROM kinds GROUP BY source ORDER BY source")
def a4_file_tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, reviews, hashes = _document_reviews(spark, sf_dir)
    counted = browse.progress(nodes.select("node_identity", F.col("source").alias("path")), reviews, hashes, ["path"])
    return counted.drop("coverage_path", "coverage_full").orderBy("path")


@query(_REVIEWED + f"SELECT {_COUNTS} FROM kinds")
def a5_grand_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.tree_totals(a4_file_tree_counts(spark, sf_dir))


@query(_REVIEWED + """SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (kind = 'reviewed_stale') AS BIGINT) AS stale FROM kinds GROUP BY GROUPING SETS ((lang, source), (lang), ())""")
def ext_progress_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: several scopes of progress in one pass."""
    nodes, reviews, hashes = _document_reviews(spark, sf_dir)
    rows = nodes.join(choose_review(reviews, ["node_identity"], "event_seq").select("node_identity", "status", "code_hash"), "node_identity", "left")
    kinds = rows.withColumn("kind", runtime_kind(F.col("status"), F.col("content_hash"), F.col("code_hash")))
    counted = kinds.groupingSets([["lang", "source"], ["lang"], []], "lang", "source").agg(F.count("*").alias("total"), F.count_if(F.col("kind") == "reviewed_stale").alias("stale"))
    return counted.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "total", "stale")


# --- signals and classes of pages --------------------------------------------------------------------------------


def _url_signals() -> list[Signal]:
    p = F.col("path")
    return [
        Signal("utm", "tracked", HIGH, p.contains("utm_")),
        Signal("mobile", "mobile", MEDIUM, p.startswith("https://m.") | p.startswith("http://m.")),
        Signal("fragment", "part", MEDIUM, p.contains("#")),
        Signal("english", "text", MEDIUM, p.rlike("/(en|de)/")),
        Signal("plain", "insecure", LOW, p.startswith("http://")),
    ]


_SIGNALS = """
WITH found AS (
  SELECT page_id, 0 AS ord, 'utm' AS signal, 'tracked' AS role, 3 AS weight FROM pages WHERE contains(url, 'utm_')
  UNION ALL SELECT page_id, 1, 'mobile', 'mobile', 2 FROM pages WHERE starts_with(url, 'https://m.') OR starts_with(url, 'http://m.')
  UNION ALL SELECT page_id, 2, 'fragment', 'part', 2 FROM pages WHERE contains(url, '#')
  UNION ALL SELECT page_id, 3, 'english', 'text', 2 FROM pages WHERE regexp_matches(url, '/(en|de)/')
  UNION ALL SELECT page_id, 4, 'plain', 'insecure', 1 FROM pages WHERE starts_with(url, 'http://')
), scored AS (
  SELECT page_id, role, sum(weight) AS score, min(ord) AS first, string_agg(signal, ',' ORDER BY ord) AS signals FROM found GROUP BY page_id, role
), ranked AS (
  SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second FROM scored WINDOW w AS (PARTITION BY page_id ORDER BY score DESC, first)
), top AS (SELECT *, coalesce(second >= 0.8 * score, false) AS conflicting FROM ranked WHERE place = 1
), roles AS (
  SELECT p.page_id, coalesce(role, 'unclassified') AS role, CAST(coalesce(score, 0) AS INTEGER) AS score,
    CASE WHEN role IS NULL THEN 'none' WHEN conflicting THEN 'low' WHEN score >= 3 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS confidence,
    coalesce(conflicting, false) AS conflicting, coalesce(signals, '') AS signals
  FROM pages p LEFT JOIN top USING (page_id)
)
"""


def _page_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    return classify.classify_files(pages, _url_signals(), "page_id")


@query(_SIGNALS + "SELECT * FROM roles")
def c1_weighted_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_roles(spark, sf_dir).withColumn("signals", F.array_join("signals", ","))


@query(_SIGNALS + """, second AS (SELECT page_id, 'text' AS role2, CASE WHEN page_id % 2 = 0 THEN 'medium' ELSE 'high' END AS confidence2 FROM pages WHERE page_id % 3 = 0)
SELECT page_id, CASE WHEN takes THEN role2 ELSE role END AS role,
  CASE WHEN takes AND role = role2 THEN CASE WHEN confidence2 = 'high' OR confidence = 'high' THEN 'high' ELSE 'medium' END WHEN takes THEN 'low' ELSE confidence END AS confidence,
  CASE WHEN takes AND role <> role2 THEN true ELSE conflicting END AS conflicting, CASE WHEN takes THEN 'stage2' ELSE 'stage1' END AS source
FROM (SELECT *, confidence <> 'high' AND role2 IS NOT NULL AS takes FROM roles LEFT JOIN second USING (page_id))""")
def c2_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = read(spark, sf_dir, "pages").where(F.col("page_id") % 3 == 0).select("page_id", F.lit("text").alias("role"), F.when(F.col("page_id") % 2 == 0, "medium").otherwise("high").alias("confidence"))
    return classify.reconcile(_page_roles(spark, sf_dir), second, "page_id")


@query(_SIGNALS + """SELECT sha256('{"kind":"classification","nodeIdentity":"file:' || page_id || '"}') AS key, 'classification' AS kind,
  '{"kind":"classification","nodeIdentity":"file:' || page_id || '"}' AS context, CASE WHEN role <> 'unclassified' THEN role END AS suggestion, CAST(page_id AS VARCHAR) AS path
FROM roles WHERE confidence IN ('low', 'none') OR conflicting""")
def c3_open_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.open_questions(_page_roles(spark, sf_dir).withColumn("path", F.col("page_id").cast("string")))


# --- resolving and paths of calls ---------------------------------------------------------------------------------


@query("""
WITH edges AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders), tried AS (
  SELECT o_orderkey, c_nationkey AS k, 1 AS priority FROM edges JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority LIKE '1%'
  UNION ALL SELECT o_orderkey, c_nationkey, 2 FROM edges JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT o_orderkey, 0, 3 FROM edges)
SELECT n_name AS target, CAST(count(*) AS BIGINT) AS edges, CAST(min(priority) AS INTEGER) AS best
FROM (SELECT o_orderkey, arg_min(k, priority) AS k, min(priority) AS priority FROM tried GROUP BY o_orderkey) JOIN nation ON n_nationkey = k GROUP BY n_name""")
def j2_prioritised_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's nation by the first of three ways that finds one."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    placed = orders.join(customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    first = F.when(F.col("o_orderpriority").startswith("1") & F.col("c_nationkey").isNotNull(), F.struct(F.lit(1).alias("p"), F.col("c_nationkey").alias("k")))
    ways = (first, F.when(F.col("c_nationkey").isNotNull(), F.struct(F.lit(2).alias("p"), F.col("c_nationkey").alias("k"))), F.struct(F.lit(3).alias("p"), F.lit(0).alias("k")))
    tried = placed.select("o_orderkey", F.explode(F.filter(F.array(*ways), lambda w: w.isNotNull())).alias("f")).select("o_orderkey", "f.k", "f.p", (-F.col("f.p")).alias("rank"))
    chosen = resolve.last_by(tried, ["o_orderkey"], ["rank"], "k", "p").groupBy("k").agg(F.count("*").alias("edges"), F.min("p").alias("best"))
    return chosen.join(read(spark, sf_dir, "nation"), F.col("k") == F.col("n_nationkey")).select(F.col("n_name").alias("target"), "edges", "best")


_GRAPH = """
WITH RECURSIVE seen AS (
  SELECT user_id || ':' || strftime(ts, '%m-%d') || ':' || event_type AS node, ts, event_id,
    lead(user_id || ':' || strftime(ts, '%m-%d') || ':' || event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events
), firsts AS (SELECT node AS caller, next AS callee, min(event_id) AS seq FROM seen WHERE next IS NOT NULL GROUP BY ALL
), callees AS (SELECT caller, list(callee ORDER BY seq) AS callees FROM firsts GROUP BY caller
), entries AS (SELECT DISTINCT node AS entry FROM seen
), walk AS (
  SELECT entry, entry AS cur, [entry] AS nodes, 0 AS pos, NULL::INTEGER AS cycle_at, 0 AS max_depth FROM entries
  UNION ALL
  SELECT w.entry, CASE WHEN list_contains(nodes, callees[1]) THEN NULL ELSE callees[1] END,
    CASE WHEN list_contains(nodes, callees[1]) THEN nodes ELSE list_append(nodes, callees[1]) END, pos + 1,
    CASE WHEN list_contains(nodes, callees[1]) THEN CAST(list_position(nodes, callees[1]) - 1 AS INTEGER) END, pos + 1
  FROM walk w JOIN callees c ON c.caller = w.cur WHERE pos + 1 < 8
), ended AS (SELECT entry, arg_max(nodes, pos) AS nodes, arg_max(struct_pack(c := cycle_at), pos).c AS cycle_at, max(max_depth) AS max_depth FROM walk GROUP BY entry)
"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Callees in order and nodes: a node is a user's kind of event on a day, and calls the kind that came next."""
    node = F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "MM-dd"), "event_type")
    seen = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", node.alias("node"))
    edges = seen.withColumn("callee", F.lead("node").over(W.partitionBy("user_id").orderBy("ts", "event_id"))).select(F.col("node").alias("caller"), "callee", "event_id")
    nodes = seen.select(F.col("node").alias("node_identity")).distinct()
    return paths.callees_in_order(edges, nodes, ["event_id"]), nodes


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    callees, nodes = _graph(spark, sf_dir)
    return paths.walk(nodes, callees)


@query(_GRAPH + "SELECT entry, CAST(len(nodes) AS INTEGER) AS node_count, CAST(max_depth AS INTEGER) AS max_depth, coalesce(cycle_at, -1) AS cycle_at, array_to_string(nodes, '>') AS nodes FROM ended")
def g1_path_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spark, sf_dir).select("entry", F.size("nodes").alias("node_count"), "max_depth", F.coalesce("cycle_at", F.lit(-1)).alias("cycle_at"), F.array_join("nodes", ">").alias("nodes"))


@query(_GRAPH + """, steps AS (SELECT entry, unnest(nodes) AS caller FROM ended)
SELECT entry, caller, array_to_string(callees, '>') AS candidates,
  sha256('{"callerIdentity":"' || caller || '","entryNodeIdentity":"' || entry || '","kind":"path_branch"}') AS key FROM steps JOIN callees USING (caller) WHERE len(callees) > 1""")
def g2_branch_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.branch_questions(_walked(spark, sf_dir)).select("entry", "caller", F.array_join("candidates", ">").alias("candidates"), "key")


@query(_GRAPH + """SELECT entry, CAST(unnest(range(len(nodes))) AS INTEGER) AS position, unnest(nodes) AS node_identity,
  CASE WHEN cycle_at = unnest(range(len(nodes))) THEN cycle_at ELSE -1 END AS cycle_back_to_position FROM ended""")
def g4_path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.path_nodes_of(_walked(spark, sf_dir)).drop("path_id").fillna(-1, ["cycle_back_to_position"])


@query("""SELECT page_id, category, CAST(CASE WHEN category = 'other' THEN 999 ELSE unicode(category) END AS INTEGER) AS category_order FROM (
  SELECT page_id, CASE WHEN name = '' THEN 'other' ELSE name END AS category FROM (
    SELECT page_id, regexp_replace(string_split(coalesce(string_split(url, ':')[2], ''), '/')[-1], '\\.[^.]+$', '') AS name FROM pages))""")
def g5_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", ids.category_of(F.col("url")).alias("c")).select("page_id", "c.category", "c.category_order")


# --- two snapshots of orders --------------------------------------------------------------------------------------


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, sf_dir, "orders")
    middle = F.lit("1998-04-15").cast("timestamp_ntz")
    side = lambda rows: rows.groupBy(F.col("o_custkey").alias("node_identity")).agg(
        (F.count("*") % 2 == 0).alias("exported"), F.array_sort(F.collect_set("o_orderpriority")).alias("params"), F.max("o_orderstatus").alias("return_type")
    )
    return side(orders.where(F.col("o_orderdate") < middle)), side(orders.where(F.col("o_orderdate") >= middle))


_SNAPSHOTS = """
WITH sides AS (
  SELECT o_orderdate >= TIMESTAMP '1998-04-15' AS is_head, o_custkey AS k, count(*) % 2 = 0 AS exported, list_sort(list(DISTINCT o_orderpriority)) AS params, max(o_orderstatus) AS ret
  FROM orders GROUP BY ALL
), paired AS (
  SELECT coalesce(b.k, h.k) AS k, b.k IS NOT NULL AS b, h.k IS NOT NULL AS h, coalesce(b.exported, false) AS be, coalesce(h.exported, false) AS he,
    b.params AS bp, h.params AS hp, b.ret AS br, h.ret AS hr
  FROM (SELECT * FROM sides WHERE NOT is_head) b FULL JOIN (SELECT * FROM sides WHERE is_head) h ON b.k = h.k
)"""
_CHANGES = _SNAPSHOTS + """, changes AS (
  SELECT k, 'export_added' AS change FROM paired WHERE h AND he AND (NOT b OR NOT be)
  UNION ALL SELECT k, 'export_removed' FROM paired WHERE b AND be AND (NOT h OR NOT he)
  UNION ALL SELECT k, CASE WHEN len(hp) > len(bp) THEN 'param_added' WHEN len(hp) < len(bp) THEN 'param_removed' ELSE 'param_type_changed' END
    FROM paired WHERE b AND h AND array_to_string(bp, '|') <> array_to_string(hp, '|')
  UNION ALL SELECT k, 'return_type_changed' FROM paired WHERE b AND h AND br <> hr
), named AS (SELECT sha256('{"kind":"' || change || '","nodeIdentity":"' || k || '"}') AS change_id, k AS node_identity, change FROM changes)
"""


@query(_CHANGES + "SELECT * FROM named")
def x28_contract_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.contract_changes(*_snapshots(spark, sf_dir)).drop("note")


def _order_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda df: df.select(F.col("node_identity").alias("entry"), F.col("node_identity").cast("string").alias("path_id"), F.col("params").alias("nodes"))
    base, head = _snapshots(spark, sf_dir)
    return delta.sequence_deltas(side(base), side(head))


_DELTAS = """, deltas AS (SELECT k AS entry, CAST(CASE WHEN b THEN k END AS VARCHAR) AS base_path_id, CAST(CASE WHEN h THEN k END AS VARCHAR) AS head_path_id,
  CASE WHEN NOT b THEN 'net_new' WHEN NOT h THEN 'net_gone' WHEN bp = hp THEN 'unchanged' ELSE 'modified_in_place' END AS classification,
  array_to_string(list_filter(coalesce(hp, []), lambda x: NOT list_contains(coalesce(bp, []), x)), ',') AS added_nodes,
  array_to_string(list_filter(coalesce(bp, []), lambda x: NOT list_contains(coalesce(hp, []), x)), ',') AS removed_nodes FROM paired)
"""


@query(_SNAPSHOTS + _DELTAS + "SELECT * FROM deltas")
def j16_path_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_deltas(spark, sf_dir).withColumns({c: F.array_join(c, ",") for c in ("added_nodes", "removed_nodes")})


def _callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items call the customer of their order; suppliers are callers, and customers' orders are paths."""
    changes = delta.contract_changes(*_snapshots(spark, sf_dir))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    edges = read(spark, sf_dir, "lineitem").join(orders, "l_orderkey").select(F.col("o_custkey").alias("callee"), F.col("l_suppkey").alias("caller"))
    members = orders.select(F.col("o_custkey").cast("string").alias("path_id"), (F.col("l_orderkey") % 90).alias("node_identity"))
    return delta.affected_callers(changes, edges, members, _order_deltas(spark, sf_dir))


_CALLERS = _CHANGES + _DELTAS + """, member AS (
  SELECT o_orderkey % 90 AS caller, bool_or(coalesce(classification <> 'unchanged', false)) AS changed
  FROM orders LEFT JOIN (SELECT * FROM deltas WHERE head_path_id IS NOT NULL) ON head_path_id = CAST(o_custkey AS VARCHAR) GROUP BY 1
), callers AS (
  SELECT change_id, l_suppkey AS caller, m.caller IS NOT NULL AS on_walked_path, coalesce(m.changed, false) AS on_changed_path
  FROM named JOIN orders ON o_custkey = node_identity JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN member m ON m.caller = l_suppkey
)
"""


@query(_CALLERS + "SELECT * FROM callers")
def j17_affected_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _callers(spark, sf_dir)


@query(_CALLERS + """SELECT change_id, CAST(count(*) FILTER (on_changed_path) AS BIGINT) AS on_changed, CAST(count(*) FILTER (on_walked_path AND NOT on_changed_path) AS BIGINT) AS on_walked_only,
  CAST(count(*) FILTER (NOT on_walked_path) AS BIGINT) AS off_paths FROM callers GROUP BY change_id""")
def a12_caller_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.caller_buckets(_callers(spark, sf_dir))


@query(_CHANGES + _DELTAS + """SELECT CAST(o_custkey AS VARCHAR) AS path_id, array_to_string(list_sort(list(DISTINCT change_id)), ',') AS change_ids
FROM orders JOIN deltas ON head_path_id = CAST(o_custkey AS VARCHAR) AND classification = 'unchanged' JOIN named ON node_identity = o_orderkey % 90 GROUP BY o_custkey""")
def j19_indirect_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = delta.contract_changes(*_snapshots(spark, sf_dir))
    members = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path_id"), (F.col("o_orderkey") % 90).alias("node_identity"))
    return delta.indirect_impact(changes, members, _order_deltas(spark, sf_dir)).withColumn("change_ids", F.array_join("change_ids", ","))


# --- renames ------------------------------------------------------------------------------------------------------


@query("""
WITH t AS (SELECT p_partkey, p_brand, list_sort(list_distinct(list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[ _.-]+'), lambda x: x <> '')
    || ['size' || p_size % 3])) AS tokens FROM part
), pairs AS (
  SELECT a.p_brand, a.p_partkey AS old_key, b.p_partkey AS new_key,
    len(list_intersect(a.tokens, b.tokens))::DOUBLE / len(list_distinct(a.tokens || b.tokens)) AS similarity
  FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1
)
SELECT p_brand, old_key, arg_min(new_key, (-similarity, new_key)) AS new_key, max(similarity) AS similarity FROM pairs WHERE similarity >= 0.55 GROUP BY ALL""")
def c5_rename_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    words = F.filter(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), "[ _.-]+"), lambda t: t != "")
    tokens = F.array_distinct(F.concat(words, F.array(F.concat(F.lit("size"), (F.col("p_size") % 3).cast("string")))))
    return renames.best_matches(parts.where(F.col("p_partkey") % 2 == 0), parts.where(F.col("p_partkey") % 2 == 1), ["p_brand"], "p_partkey", "p_partkey", tokens)


# --- rules --------------------------------------------------------------------------------------------------------


@query("""
WITH calls AS (SELECT l_orderkey AS caller, count(*) AS n, count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_partkey || l_linestatus END) AS d, bool_or(l_linestatus = 'F') AS v FROM lineitem GROUP BY 1
), roles AS (SELECT o_orderkey AS node, CASE o_orderstatus WHEN 'F' THEN 'service' WHEN 'O' THEN 'repository' ELSE 'route_handler' END AS role FROM orders)
SELECT 'builtin:service:single_responsibility' AS rule_id, CAST(node AS VARCHAR) AS node_identity, CASE WHEN coalesce(d, 0) > 8 THEN 'fail' ELSE 'pass' END AS kind,
  coalesce(d, 0) || CASE WHEN coalesce(d, 0) > 8 THEN ' distinct callees — split this up?' ELSE ' callees, in budget' END AS message FROM roles LEFT JOIN calls ON caller = node WHERE role = 'service'
UNION ALL SELECT 'builtin:repository:narrow_data_access', CAST(node AS VARCHAR), CASE WHEN coalesce(n, 0) = 0 THEN 'skip' WHEN n > 4 THEN 'fail' ELSE 'pass' END,
  CASE WHEN coalesce(n, 0) = 0 THEN 'no calls observed (data access via direct expression?)' WHEN n > 4 THEN n || ' calls — wider than a single query' ELSE n || ' calls, narrow' END FROM roles LEFT JOIN calls ON caller = node WHERE role = 'repository'
UNION ALL SELECT 'builtin:route_handler:input_validated', CAST(node AS VARCHAR), CASE WHEN coalesce(v, false) THEN 'pass' ELSE 'fail' END,
  CASE WHEN coalesce(v, false) THEN 'invokes a validate/parse/check call' ELSE 'no validate/parse/check call detected in body' END FROM roles LEFT JOIN calls ON caller = node WHERE role = 'route_handler'
UNION ALL SELECT 'builtin:route_handler:auth_check_present', CAST(node AS VARCHAR), 'skip', 'no in-handler auth call detected' FROM roles WHERE role = 'route_handler'""")
def c7_builtin_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nodes, their line items as calls: to parts, and to ``validate`` where the line is finished."""
    role = F.when(F.col("o_orderstatus") == "F", "service").when(F.col("o_orderstatus") == "O", "repository").otherwise("route_handler")
    nodes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("node_identity"), role.alias("role"))
    callee = F.concat(F.lit("p:"), F.when(F.col("l_linestatus") == "F", "validate").otherwise("other"), F.col("l_partkey").cast("string"))
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("caller"), callee.alias("callee"), (F.col("l_returnflag") == "R").alias("unresolved"), F.col("l_linenumber").alias("edge_seq"))
    return rules.evaluate_rules(nodes, nodes, edges, ["edge_seq"])


@query("""SELECT l_orderkey AS caller, CAST(count(*) AS BIGINT) AS n_calls, CAST(count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN name END) AS BIGINT) AS n_callees,
  substr(arg_min(name, (l_linenumber, l_partkey)) FILTER (l_linenumber % 3 = 0), 3) AS first_auth, bool_or(l_linenumber % 3 = 1) AS validates, false AS asserts
FROM (SELECT *, 'p:' || CASE l_linenumber % 3 WHEN 0 THEN 'requireAuth' WHEN 1 THEN 'parse' ELSE 'other' END || l_partkey AS name FROM lineitem) GROUP BY 1""")
def a6_call_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("l_linenumber") % 3 == 0, "requireAuth").when(F.col("l_linenumber") % 3 == 1, "parse").otherwise("other")
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("caller"), F.concat(F.lit("p:"), name, F.col("l_partkey").cast("string")).alias("callee"), (F.col("l_returnflag") == "R").alias("unresolved"), "l_linenumber", "l_partkey")
    return rules.call_summary(edges, ["l_linenumber", "l_partkey"])


# --- the review log -----------------------------------------------------------------------------------------------


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a review log: errors clear, purchases approve, clicks reject, the rest ask."""
    e = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("event_seq"), F.col("ts").alias("event_ts"), F.col("user_id").cast("string").alias("node_identity"),
        F.when(F.col("event_id") % 3 == 0, F.lit("global")).otherwise(F.concat(F.lit("path:"), (F.col("event_id") % 2).cast("string"))).alias("scope"),
        F.when(kind == "error", "clear").otherwise("set").alias("op"), F.when(kind == "purchase", "approved").when(kind == "click", "rejected").otherwise("info_requested").alias("status"),
        F.lit(None).cast("string").alias("comment"), F.round("value", 0).cast("int").cast("string").alias("code_hash"), F.lit("r").alias("reviewer_id"),
        F.when(kind == "error", "manual_clear").otherwise("replaced").alias("reason"),
    )


_LOG = """
WITH log AS (SELECT event_id AS seq, ts, CAST(user_id AS VARCHAR) AS node_identity, CASE WHEN event_id % 3 = 0 THEN 'global' ELSE 'path:' || event_id % 2 END AS scope,
  event_type = 'error' AS clears, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'click' THEN 'rejected' ELSE 'info_requested' END AS status FROM events
), spans AS (SELECT *, sum(CASE WHEN clears THEN 1 ELSE 0 END) OVER w AS span, lead(ts) OVER w AS next_ts, lead(clears) OVER w AS next_clears,
  row_number() OVER (PARTITION BY node_identity, scope ORDER BY ts DESC, seq DESC) AS back FROM log WINDOW w AS (PARTITION BY node_identity, scope ORDER BY ts, seq)
), current AS (SELECT s.seq, s.ts, s.node_identity, s.scope, s.status, (SELECT min(f.ts) FROM spans f WHERE f.node_identity = s.node_identity AND f.scope = s.scope AND f.span = s.span AND NOT f.clears) AS created_at
  FROM spans s WHERE back = 1 AND NOT clears)
"""


@query(_LOG + "SELECT node_identity, scope, status, created_at, ts AS updated_at, seq AS event_seq FROM current")
def k6_current_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.current_reviews(_log(spark, sf_dir)).select("node_identity", "scope", "status", "created_at", "updated_at", "event_seq")


@query(_LOG + """SELECT node_identity, scope, status, ts AS event_ts, next_ts AS superseded_at, CASE WHEN next_clears THEN 'manual_clear' ELSE 'replaced' END AS reason
FROM spans WHERE NOT clears AND next_ts IS NOT NULL""")
def w12_review_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_history(_log(spark, sf_dir)).select("node_identity", "scope", "status", "event_ts", "superseded_at", "reason")


@query(_LOG + """SELECT node_identity, arg_min(status, CASE scope WHEN 'path:1' THEN 0 WHEN 'global' THEN 1 ELSE 2 END * 1000000000 + seq) AS path_status,
  arg_min(status, CASE scope WHEN 'global' THEN 0 ELSE 1 END * 1000000000 + seq) AS progress_status FROM current GROUP BY node_identity""")
def w7_scope_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two ways of choosing a row: a walkthrough honours the path, progress never does."""
    current = review.current_reviews(_log(spark, sf_dir))
    of_path = choose_review(current, ["node_identity"], "event_seq", F.lit("1")).select("node_identity", F.col("status").alias("path_status"))
    of_progress = choose_review(current, ["node_identity"], "event_seq").select("node_identity", F.col("status").alias("progress_status"))
    return of_path.join(of_progress, "node_identity")


@query("""
WITH targets AS (SELECT o_orderkey AS node, o_custkey AS file, o_orderpriority FROM orders), known AS (
  SELECT o_orderkey AS node, CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'rejected' END AS status FROM orders WHERE o_orderkey % 4 = 0
), rows AS (SELECT file, status IS NOT NULL AND status <> 'approved' AS differs, CASE file % 3 WHEN 0 THEN NULL WHEN 1 THEN 'preserve' ELSE 'override' END AS resolution FROM targets LEFT JOIN known USING (node)
), planned AS (SELECT *, bool_or(differs AND resolution IS NULL) OVER (PARTITION BY file) AS blocked FROM rows)
SELECT file, count(*) FILTER (blocked AND differs) = 0 AS applied, CAST(count(*) FILTER (NOT blocked AND NOT differs) AS BIGINT) AS functions_applied,
  CAST(count(*) FILTER (NOT blocked AND differs AND resolution = 'preserve') AS BIGINT) AS functions_preserved, CAST(count(*) FILTER (NOT blocked AND differs AND resolution = 'override') AS BIGINT) AS functions_overridden,
  CAST(count(*) FILTER (blocked AND differs) AS BIGINT) AS conflicts FROM planned GROUP BY file""")
def c10_file_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approving all orders of each customer, where some are already approved or rejected."""
    orders = read(spark, sf_dir, "orders")
    targets = orders.select(F.col("o_orderkey").alias("node_identity"), F.col("o_custkey").alias("file"))
    current = orders.where(F.col("o_orderkey") % 4 == 0).select(F.col("o_orderkey").alias("node_identity"), F.lit("global").alias("scope"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected").alias("status"))
    resolution = F.when(F.col("file") % 3 == 1, "preserve").when(F.col("file") % 3 == 2, "override")
    return review.cascade_counts(review.cascade_plan(targets, current, F.lit("approved"), resolution, ["file"]), ["file"])


@query("""SELECT o_orderkey AS comment_id FROM orders WHERE (CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey * 2 END) NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def j22_null_aware_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("comment_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") * 2).alias("k"))
    return comments.not_among(rows, "k", read(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0), "c_custkey").select("comment_id")


@query("""SELECT o_orderpriority AS kind, CAST(count(*) AS BIGINT) AS open FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1""")
def j14_unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("kind"))
    answers = read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("question_key"))
    return prep.open_count(questions, answers)


@query("""SELECT user_id AS input_hash, arg_max(event_type, event_id) AS response, min(event_id) AS created_at, max(event_id) AS last_used_at FROM events GROUP BY user_id""")
def k4_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of results after later ones: the last answer, and the first time of writing."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("input_hash"), F.col("event_type").alias("response"), F.col("event_id").alias("created_at"), F.col("event_id").alias("last_used_at"))
    return prep.upsert_memo(e.where("created_at % 2 = 0"), e.where("created_at % 2 = 1"))


@query("SELECT event_id FROM events WHERE json_extract_string(json_object('pathId', CAST(user_id AS VARCHAR)), '$.pathId') = '7'")
def f14_json_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about one path, by their context."""
    questions = read(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("user_id").cast("string").alias("pathId"))).alias("context"))
    return prep.for_path(questions, "7").select("event_id")


# --- browsing -----------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey AS path_id, coalesce(nodes, '') AS nodes FROM customer LEFT JOIN (SELECT o_custkey, string_agg(o_orderkey, '>' ORDER BY o_orderdate, o_orderkey) AS nodes FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def j25_ordered_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as paths with their orders in order, those without orders too."""
    steps = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path_id"), F.struct("o_orderdate", "o_orderkey").alias("position"), F.col("o_orderkey").alias("node_identity"))
    nested = browse.paths_with_nodes(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path_id")), steps)
    return nested.withColumn("nodes", F.array_join(F.transform("nodes", lambda x: x["node_identity"].cast("string")), ">"))


@query("""SELECT callee, p_name AS name FROM (SELECT l_partkey AS callee, min(l_orderkey * 8 + l_linenumber) AS seq FROM lineitem WHERE l_returnflag <> 'R' AND l_suppkey = 7 GROUP BY 1) JOIN part ON p_partkey = callee ORDER BY seq""")
def w4_first_call_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one supplier delivers, in the order of its first delivery."""
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee"), (F.col("l_returnflag") == "R").alias("unresolved"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))
    return browse.callees_of(edges, read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_identity"), F.col("p_name").alias("name")), F.lit(7), ["seq"])


@query("""SELECT c_custkey, n_name, r_name, o_orderkey AS last_order FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def j7_chained_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    last = resolve.last_by(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").withColumnRenamed("o_orderkey", "last_order")
    joined = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "n_name", "r_name", "last_order")


@query("""SELECT page_id, string_split(url, ':')[1] AS project, array_to_string(string_split(url, ':')[2:], ':') AS rest, string_split(url, '/')[-1] AS base,
  sha256('{"a":"' || url || '","b":' || page_id || '}') AS h, substr(sha256(url), 1, 16) AS short FROM pages""")
def x1_identity_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return read(spark, sf_dir, "pages").select(
        "page_id", F.substring_index(u, ":", 1).alias("project"), ids.without_first_segment(u).alias("rest"), ids.base_name(u).alias("base"),
        ids.canonical_hash(a=u, b=F.col("page_id")).alias("h"), ids.codebase_hash(u).alias("short"),
    )


@query("""SELECT doc_id, CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || chr(10) || '…[truncated ' || (length(text) - 600) || ' chars]' ELSE text END AS text FROM documents""")
def x20_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", ids.cut_off(F.col("text"), 600).alias("text"))


@query("""SELECT doc_id, coalesce(array_to_string(string_split(text, chr(10))[2:3], chr(10)), '') AS body FROM documents""")
def s14_line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", ids.body_lines(F.col("text"), F.lit(2), F.lit(3)).alias("body"))


@query("""SELECT doc_id, line FROM (SELECT doc_id, text AS line, length(text) AS size, lang FROM documents) WHERE size <= 5000 AND NOT regexp_matches(lang, '^(de|es)$')""")
def s4_size_and_name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.where((F.length("text") <= 5000) & ~F.col("lang").rlike("^(de|es)$")).select("doc_id", F.col("text").alias("line"))


# --- more of the inventory ----------------------------------------------------------------------------------------


_ANSWERED = _GRAPH.replace("callees[1]", "step")
_ANSWERED = _ANSWERED.replace("JOIN callees c ON c.caller = w.cur", "JOIN steps c ON c.entry = w.entry AND c.caller = w.cur").replace(
    "), walk AS (", """), steps AS (
  SELECT entry, caller, CASE WHEN left(entry, 2) = left(caller, 2) AND len(callees) > 1 THEN callees[-1] ELSE callees[1] END AS step
  FROM entries JOIN callees ON split_part(entry, ':', 1) = split_part(caller, ':', 1)
), walk AS ("""
)


@query(_ANSWERED + "SELECT entry, CAST(len(nodes) AS INTEGER) AS node_count, array_to_string(nodes, '>') AS nodes FROM ended")
def g3_branch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks that follow the answers to their questions: the last candidate, where entry and caller begin alike."""
    callees, nodes = map(cut, _graph(spark, sf_dir))  # read by walks and answers
    user = lambda c: F.substring_index(c, ":", 1)
    branching = callees.where(F.size("callees") > 1).select(user("caller").alias("user"), "caller", F.element_at("callees", -1).alias("choice"))
    entries = nodes.select(user("node_identity").alias("user"), F.col("node_identity").alias("entry"))
    answers = entries.join(branching, "user").where(F.left("entry", F.lit(2)) == F.left("caller", F.lit(2))).select("entry", "caller", "choice")
    return paths.walk(nodes, callees, answers).select("entry", F.size("nodes").alias("node_count"), F.array_join("nodes", ">").alias("nodes"))


@query("""SELECT page_id, regexp_replace(regexp_replace(url, '/+', '/', 'g'), '/$', '') || '/b/c' AS path FROM pages""")
def x8_path_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    tangled = F.concat(F.lit("../"), "url", F.lit("/./a/../b//c"))
    return read(spark, sf_dir, "pages").select("page_id", ids.normal_path(tangled).alias("path"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def f5_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").join(wanted, "o_custkey", "left_semi").select("o_orderkey")


@query("""SELECT o_orderkey AS key, o_orderpriority AS kind, answer FROM orders LEFT JOIN
  (SELECT l_orderkey, arg_max(l_shipmode, (l_linenumber, l_partkey, l_shipmode)) AS answer FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem WHERE l_linenumber > 3) GROUP BY 1) ON l_orderkey = o_orderkey""")
def j13_questions_with_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions beside the last answer given to each, if any."""
    questions = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("kind"))
    given = read(spark, sf_dir, "lineitem").where(F.col("l_linenumber") > 3).select(
        F.col("l_orderkey").alias("question_key"), F.concat("l_returnflag", "l_linestatus").alias("answer"), F.struct("l_linenumber", "l_partkey").alias("answered_at")
    )
    return prep.with_answers(questions, review.latest(given, ["question_key"], ["answered_at", "answer"])).select("key", "kind", "answer")


@query("""
WITH old AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1998-04-15'), new AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1998-04-15')
SELECT k AS node_identity, 'removed' AS side FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT k, 'new' FROM new WHERE k NOT IN (SELECT k FROM old)""")
def j20_removed_and_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head = _snapshots(spark, sf_dir)
    removed, new = renames.removed_and_new(base, head)
    return removed.select("node_identity", F.lit("removed").alias("side")).unionByName(new.select("node_identity", F.lit("new").alias("side")))


@query(_LOG + """, cleared AS (SELECT * FROM current WHERE node_identity IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'signup' AND event_id % 50 = 0))
SELECT 'cleared' AS side, CAST(count(*) AS BIGINT) AS n FROM cleared UNION ALL SELECT 'left', CAST((SELECT count(*) FROM current) - (SELECT count(*) FROM cleared) AS BIGINT)""")
def k10_progress_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clearing all reviews of a scope, whatever their own scopes, by events."""
    log = _log(spark, sf_dir)
    current = review.current_reviews(log)
    scope = read(spark, sf_dir, "events").where((F.col("event_type") == "signup") & (F.col("event_id") % 50 == 0)).select(F.col("user_id").cast("string").alias("node_identity"))
    events = review.reset(current, scope, F.lit("2030-01-01"))
    left = review.current_reviews(review.append(log, events))
    return events.agg(F.count("*").alias("n")).select(F.lit("cleared").alias("side"), "n").unionByName(left.agg(F.count("*").alias("n")).select(F.lit("left").alias("side"), "n"))


@query(_LOG + """, scoped AS (SELECT * FROM current WHERE scope = 'path:1'), rest AS (SELECT * FROM current WHERE scope NOT IN ('path:1', 'global') UNION ALL SELECT * FROM current WHERE scope = 'global' AND node_identity NOT IN (SELECT node_identity FROM scoped))
SELECT node_identity, scope, status FROM rest UNION ALL SELECT node_identity, 'global', status FROM scoped""")
def c9_promote_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    events = review.promote(review.current_reviews(log), "1", "r", F.lit("2030-01-01"))
    return review.current_reviews(review.append(log, events)).select("node_identity", "scope", "status")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 10 = 3 AND o_custkey % 20 <> 13 THEN 'c' || (o_custkey + 1) ELSE 'c' || o_custkey END AS node_identity FROM orders""")
def k9_carry_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities rewritten by a map of renames."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node_identity"))
    renamed = read(spark, sf_dir, "orders").where((F.col("o_custkey") % 10 == 3) & (F.col("o_custkey") % 20 != 13)).select("o_custkey").distinct()
    name = lambda k: F.concat(F.lit("c"), k.cast("string"))
    return prep.carry_renames(rows, renamed.select(name(F.col("o_custkey")).alias("old_identity"), name(F.col("o_custkey") + 1).alias("new_identity")), "node_identity")


@query("""SELECT hit, CAST(count(*) AS BIGINT) AS requests FROM (SELECT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderpriority = '1-URGENT') AS hit FROM customer) GROUP BY hit""")
def c14_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered from a store of results of the current prompt, and those that are not."""
    requests = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("input_hash"))
    stored = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("input_hash"), F.col("o_orderpriority").alias("prompt_version"), F.lit("r").alias("response"))
    found, missing = prep.memo(requests, stored.dropDuplicates(["input_hash", "prompt_version"]), F.lit("1-URGENT"))
    count = lambda df, hit: df.groupBy(F.lit(hit).alias("hit")).agg(F.count("*").alias("requests"))
    return count(found, True).unionByName(count(missing, False))


@query("""WITH v AS (SELECT *, max(event_id) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS gone FROM events)
SELECT user_id, max(ts) AS last_opened_at, arg_max(CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'used' END, event_id) FILTER (event_type IN ('view', 'click')) AS label
FROM v WHERE gone IS NULL OR event_id > gone GROUP BY user_id ORDER BY last_opened_at DESC""")
def k5_recent_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.store import recent_codebases

    e = read(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "remove").otherwise("open")
    label = F.when(F.col("event_type") == "view", "seen").when(F.col("event_type") == "click", "used")
    visits = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("codebase_hash"), F.lit("/").alias("path"), label.alias("label"), op.alias("op"), F.col("ts").alias("at"))
    return recent_codebases(visits).select(F.col("codebase_hash").alias("user_id"), "last_opened_at", "label")


@query("""SELECT doc_id, CASE WHEN h IS NULL THEN '' ELSE h END AS content_hash, CASE WHEN h IS NULL THEN 'unknown' ELSE lang END AS language, CAST(n_chars AS BIGINT) AS size FROM
  (SELECT d.doc_id, d.n_chars, d.lang, CASE WHEN l.doc_id IS NOT NULL THEN sha256(d.text) END AS h FROM documents d LEFT JOIN labels l USING (doc_id))""")
def k2_files_with_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.store import files_with_hashes

    docs = read(spark, sf_dir, "documents")
    parsed = docs.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("content_hash"), F.col("lang").alias("language"))
    return files_with_hashes(docs.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size")), parsed).withColumnRenamed("path", "doc_id")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'path' ELSE 'global' END AS kind, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) END AS path_id FROM events""")
def x13_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 3 == 0, "path").otherwise("global")
    keyed = read(spark, sf_dir, "events").select("event_id", ids.scope_key(kind, F.col("user_id").cast("string")).alias("scope"))
    return keyed.select("event_id", ids.scope_parts(F.col("scope")).alias("s")).select("event_id", "s.kind", "s.path_id")


@query("""SELECT role, item_ord, label, CAST(count(*) AS BIGINT) AS nodes FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'service' WHEN 'O' THEN 'hook' ELSE 'other' END AS role FROM orders) JOIN (VALUES
  ('service', 0, 'Single responsibility'), ('service', 1, 'Caching / performance considerations'), ('service', 2, 'Side-effect boundaries are clear'), ('service', 3, 'Errors propagate cleanly'),
  ('hook', 0, 'Single responsibility'), ('hook', 1, 'Stable identity (deps are correct)'), ('hook', 2, 'Cleanup on unmount where applicable'),
  ('other', 0, 'Single responsibility — does one thing'), ('other', 1, 'Boundary clarity — inputs / outputs are explicit'), ('other', 2, 'Error handling')) AS t(role, item_ord, label) USING (role) GROUP BY ALL""")
def c20_checklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("o_orderstatus") == "F", "service").when(F.col("o_orderstatus") == "O", "hook").otherwise("other")
    roles = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node_identity"), role.alias("role"))
    return browse.checklist(roles).groupBy("role", "item_ord", "label").agg(F.count("*").alias("nodes"))


@query("""SELECT 'customer' AS "table", CAST(count(*) AS BIGINT) AS rows FROM customer UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'orders', count(*) FROM orders""")
def a9_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.store import summary

    return summary({t: read(spark, sf_dir, t) for t in ("orders", "events", "customer")})


@query("""SELECT user_id, window_start, event_type AS status, CAST(count(*) AS BIGINT) AS events FROM (SELECT user_id, event_type, date_trunc('hour', ts) AS window_start FROM events) GROUP BY ALL""")
def ext_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the stream's windowed counts, as a batch."""
    from ..streaming.reviews import status_counts

    events = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("event_ts"), F.col("event_type").alias("status"))
    return status_counts(events, by=("user_id",))


def resolve_last_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.last_by(read(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_partkey")


QUERIES["w10_last_row_wins"] = resolve_last_import
SQL["w10_last_row_wins"] = "SELECT l_orderkey, arg_max(l_partkey, (l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1"
