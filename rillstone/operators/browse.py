"""What the screens ask: paths, trees of files, callees, states and progress, each one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import body_lines, without_first_segment
from ..functions.state import choose_review, coverage, runtime_kind, runtime_state, state_counts


def scope_nodes(kind: str, nodes: DataFrame, path_nodes: DataFrame, scope_id: str | None = None) -> DataFrame:
    """The nodes that a scope means: all of them, or those of a file or a path."""
    if kind in ("codebase", "project"):
        return nodes.select("node_identity")
    if kind == "file":
        return nodes.where(F.col("file_path") == scope_id).select("node_identity")
    return path_nodes.where(F.col("path_id") == scope_id).select("node_identity")


def progress(scope: DataFrame, reviews: DataFrame, hashes: DataFrame, by: list[str] | None = None, key: str = "node_identity", order: str = "event_seq") -> DataFrame:
    """Counts of the five states and coverage of a scope, by groups if wanted: two left joins and one aggregate.

    ``hashes``: key and ``content_hash``. Without groups an empty scope gives zeros.
    """
    chosen = choose_review(reviews, [key], order)
    rows = scope.join(chosen.select(key, "status", "code_hash"), key, "left").join(hashes.select(key, "content_hash"), key, "left")
    kind = runtime_kind(F.col("status"), F.col("content_hash"), F.col("code_hash"))
    return coverage(rows.withColumn("_kind", kind).groupBy(*(by or [])).agg(*state_counts(F.col("_kind"))))


def runtime_states(scope: DataFrame, reviews: DataFrame, hashes: DataFrame, path_id: Column | None = None, key: str = "node_identity", order: str = "event_seq") -> DataFrame:
    """Nodes with their state for a walkthrough, a path's own reviews first."""
    chosen = choose_review(reviews, [key], order, path_id)
    rows = scope.join(chosen.select(key, "status", "scope", "code_hash"), key, "left").join(hashes.select(key, "content_hash"), key, "left")
    return rows.withColumn("state", runtime_state(F.col("status"), F.col("content_hash"), F.col("code_hash")))


def get_path(path_nodes: DataFrame, nodes: DataFrame, roles: DataFrame, reviews: DataFrame, hashes: DataFrame, path_id: str) -> DataFrame:
    on_path = path_nodes.where(F.col("path_id") == path_id)
    states = runtime_states(on_path, reviews, hashes, F.lit(path_id))
    return states.join(nodes, "node_identity", "left").join(roles.select("node_identity", "role", "confidence"), "node_identity", "left").orderBy("position")


def file_tree(files: DataFrame, nodes: DataFrame, roles: DataFrame, reviews: DataFrame, hashes: DataFrame) -> DataFrame:
    """Files with their role and the states of their functions; files without functions too. Sorted as people sort names."""
    states = progress(nodes.select("node_identity", "file_path"), reviews, hashes, ["file_path"]).drop("coverage_path", "coverage_full")
    own = roles.where(F.col("node_identity").startswith("file:")).select(F.substr("node_identity", F.lit(6)).alias("path"), "role", "confidence")
    counted = files.select("path").join(own, "path", "left").join(states.withColumnRenamed("file_path", "path"), "path", "left")
    return counted.fillna(0, ["approved", "rejected", "info_requested", "stale", "never_reviewed", "total"]).orderBy(F.collate("path", "UNICODE"))


def tree_totals(tree: DataFrame) -> DataFrame:
    return tree.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("approved", "rejected", "info_requested", "stale", "never_reviewed", "total")])


def callees_of(edges: DataFrame, nodes: DataFrame, caller: Column, order: list[str]) -> DataFrame:
    """Distinct resolved callees of a caller that are known nodes, in order of their first call."""
    rows = edges.where((F.col("caller") == caller) & ~F.col("unresolved") & F.col("callee").isNotNull())
    first = rows.groupBy("callee").agg(F.min(F.struct(*order)).alias("_at"))
    return first.join(nodes.withColumnRenamed("node_identity", "callee"), "callee").orderBy("_at").drop("_at")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order, by an aggregate."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def paths_with_nodes(paths: DataFrame, path_nodes: DataFrame) -> DataFrame:
    nested = path_nodes.groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("position", "node_identity"))).alias("nodes"))
    return paths.join(nested, "path_id", "left").withColumn("nodes", F.coalesce("nodes", F.array().cast(nested.schema["nodes"].dataType)))


def entries_by_category(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """Entries under the category of their first categorised path, in order of category, then label."""
    first = first_by(paths.where(F.col("category").isNotNull()).select("entry", "category", "category_order", "path_id"), ["entry"], ["path_id"])
    rows = entries.select(F.col("node_identity").alias("entry"), "method").join(first, "entry", "left")
    label = without_first_segment(F.col("entry"))
    return rows.withColumn("label", label).withColumn("category", F.coalesce("category", F.lit("other"))).orderBy(
        F.coalesce("category_order", F.lit(999)), F.collate("category", "UNICODE"), "entry"
    )


def node_body(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes with the lines of their body; empty where the file can't be read."""
    text = files.select(F.col("path").alias("file_path"), "content")
    return nodes.join(text, "file_path", "left").withColumn("body", F.coalesce(body_lines(F.col("content"), F.col("start_line"), F.col("end_line")), F.lit(""))).drop("content")


def file_detail(files: DataFrame, nodes: DataFrame, roles: DataFrame, reviews: DataFrame, hashes: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """One file with its role and state (no row if it isn't known), and its functions with theirs, in order of their first line.

    ``files``: path, language, size. The file is reviewed as ``file:`` and its path; reviews of paths of calls don't count here.
    """
    own = files.where(F.col("path") == path).select("path", "language", "size", F.concat(F.lit("file:"), "path").alias("node_identity"))
    inside = nodes.where(F.col("file_path") == path).select("node_identity", "name", "kind", "start_line", "end_line", "exported")
    verdict = roles.select("node_identity", "role", "confidence")
    with_role = lambda rows: runtime_states(rows, reviews, hashes).join(verdict, "node_identity", "left")
    head = with_role(own).select("path", "language", "size", "role", "confidence", "state")
    body = with_role(inside).select("node_identity", "name", "kind", "start_line", "end_line", "exported", "role", "confidence", "state")
    return head, body.orderBy("start_line", "node_identity")


def entry_names(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Paths with the name of their entry; what follows the first colon of its identity where the node is gone."""
    known = nodes.select(F.col("node_identity").alias("entry"), F.col("name").alias("_name"))
    return paths.join(known, "entry", "left").withColumn("entry_name", F.coalesce("_name", without_first_segment(F.col("entry")))).drop("_name")


def not_drawn(callees: DataFrame, drawn: DataFrame) -> DataFrame:
    """Callees that a canvas doesn't show yet."""
    return callees.join(drawn.select(F.col("node_identity").alias("callee")), "callee", "left_anti")


#: What to look at in a node of a role, and in one of any other.
CHECKLISTS = {
    "route_handler": [
        "Authentication checked before reaching this handler", "Authorization (role / ownership) checked", "Input validated against a schema",
        "Errors handled consistently with the rest of the API", "Response shape matches the documented contract",
    ],
    "service": ["Single responsibility", "Caching / performance considerations", "Side-effect boundaries are clear", "Errors propagate cleanly"],
    "client": ["Timeout and retry policy", "Response validation against an expected shape", "Error mapping to caller-relevant errors"],
    "repository": ["Single responsibility — narrow data access", "Query inputs are typed / validated", "Errors map to a domain error, not a raw DB error"],
    "helper": ["Pure / side-effect-free where possible", "Inputs / outputs documented or obvious"],
    "middleware": ["Calls next() exactly once on the success path", "Errors propagate to the framework error handler", "Does not leak internal state into the response"],
    "component": [
        "Prop contract is typed and complete", "Accessibility — keyboard, ARIA, focus order", "Memoization where re-render cost matters",
        "Side-effect management (useEffect deps, cleanup)",
    ],
    "page": ["Loading / error / empty states handled", "Suspense / data dependencies are explicit", "Accessibility — landmarks and headings"],
    "hook": ["Single responsibility", "Stable identity (deps are correct)", "Cleanup on unmount where applicable"],
    "config": ["Secrets not committed", "Environment separation (dev / prod) is honoured", "Sane defaults"],
    "script": ["Idempotent or guards against re-run damage", "Logs intent before mutating state"],
    "seed": ["Deterministic", "Idempotent or wraps in a transaction"],
    "fixture": ["Realistic — exercises the real shape of the data", "Limited scope — one fixture, one purpose"],
    "test": ["Tests behavior, not implementation", "AAA structure", "No shared mutable state across tests"],
    "type_only": ["Names match the runtime shapes they describe", "No runtime code in this file"],
}
GENERAL = ["Single responsibility — does one thing", "Boundary clarity — inputs / outputs are explicit", "Error handling"]
#: The item that a built-in rule answers.
RULE_ITEMS = {
    "builtin:route_handler:auth_check_present": "Authentication checked before reaching this handler",
    "builtin:route_handler:input_validated": "Input validated against a schema",
    "builtin:service:single_responsibility": "Single responsibility",
    "builtin:repository:narrow_data_access": "Single responsibility — narrow data access",
    "builtin:test:has_assertion": "Test has at least one assertion",
}


def checklist(roles: DataFrame) -> DataFrame:
    """A row for each node and item of its role's list: an expression, no join."""
    lists = [F.when(F.col("role") == role, F.array(*map(F.lit, lines))) for role, lines in CHECKLISTS.items()]
    items = F.coalesce(*lists, F.array(*map(F.lit, GENERAL)))
    return roles.select("node_identity", "role", F.posexplode(items).alias("item_ord", "label"))


def checked_items(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items of checklists with the result of the rule that answers them, else ``unchecked``."""
    label = F.coalesce(*[F.when(F.col("rule_id") == rule, F.lit(item)) for rule, item in RULE_ITEMS.items()])
    told = results.select("node_identity", label.alias("label"), F.col("kind").alias("_kind"), "message").where(F.col("label").isNotNull())
    return items.join(told, ["node_identity", "label"], "left").withColumn("state", F.coalesce("_kind", F.lit("unchecked"))).drop("_kind")
