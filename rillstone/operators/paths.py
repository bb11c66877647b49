"""Execution paths: from each entry point along the first known callee, up to a depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import canonical_hash, canonical_json, category_of, last_segment
from ..functions.lineage import cut

DEPTH = 8
#: Methods of a router that register a handler.
VERBS = ("get", "post", "put", "patch", "delete", "options", "head", "all")


def entry_points(edges: DataFrame, imports: DataFrame, framework: str = "express") -> DataFrame:
    """Handlers that calls to a router's methods register, in files that import the framework."""
    users = imports.where(F.col("module") == framework).select("file_path").distinct()
    method = last_segment(F.col("callee"))
    attached = edges.where(F.col("hint") == "handler-attached").join(users, "file_path", "left_semi").where(method.isin(*VERBS))
    return attached.select(
        F.sha2(F.concat_ws("|", "caller", method, F.col("file_ord").cast("string"), F.col("edge_seq").cast("string")), 256).alias("entry_id"),
        F.col("caller").alias("node_identity"), F.lit("http_route").alias("kind"), F.upper(method).alias("method"), "file_ord", "edge_seq",
    )


def callees_in_order(edges: DataFrame, nodes: DataFrame, order: list[str]) -> DataFrame:
    """Each caller's distinct known callees in the order of their first call.

    Whether an edge counts as resolved does not matter, only that its callee is a known node.
    """
    known = edges.where(F.col("callee").isNotNull()).join(nodes.select(F.col("node_identity").alias("callee")).distinct(), "callee", "left_semi")
    first = known.groupBy("caller", "callee").agg(F.min(F.struct(*order)).alias("at"))
    # one row a distinct callee of a caller, pre-aggregated before this
    return first.groupBy("caller").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "callee"))), lambda x: x["callee"]).alias("callees"))


def walk(entries: DataFrame, callees: DataFrame, answers: DataFrame | None = None, depth: int = DEPTH) -> DataFrame:
    """One row an entry: the nodes of its path, whether it ended in a cycle and where, and the callers that branch.

    ``answers`` (entry, caller, choice) says which callee to follow, if it is still one of the candidates. Walks that have
    answers go step by step; all others follow the first callee, and so share their ways, which are joined by doubling.
    """
    start = entries.select(F.col("node_identity").alias("entry")).distinct()
    if answers is None:
        return _jumped(start, callees, depth)
    asked = answers.select("entry").distinct()
    return _jumped(start.join(asked, "entry", "left_anti"), callees, depth).unionByName(_stepped(start.join(asked, "entry", "left_semi"), callees, answers, depth))


def ways_ahead(callees: DataFrame, steps: int) -> DataFrame:
    """For each caller (``node``) the nodes that follow it within ``steps`` first calls, a power of two: each join doubles the ways, whatever the number of walks."""
    ways = cut(callees.select(F.col("caller").alias("node"), F.array(F.get("callees", F.lit(0))).alias("ahead")))
    reach = 1
    while reach < steps:
        # a way that has ended finds nothing under its own name
        at = F.when(F.size("ahead") == reach, F.element_at("ahead", -1)).otherwise(F.concat(F.lit("\0"), "node"))
        further = ways.select(F.col("node").alias("_at"), F.col("ahead").alias("_more"))
        ways = cut(ways.withColumn("_at", at).join(further, "_at", "left").select("node", F.concat("ahead", F.coalesce("_more", F.array().cast("array<string>"))).alias("ahead")))
        reach *= 2
    return ways


def _jumped(start: DataFrame, callees: DataFrame, depth: int) -> DataFrame:
    """Walks along first callees, half of the depth at a time; cycles are looked for when the nodes are spelled out."""
    callees = cut(callees)
    reach = 1
    while reach * 4 <= depth:
        reach *= 2
    ways = ways_ahead(callees, reach).select(F.col("node").alias("_at"), "ahead")
    state, full = start.withColumn("nodes", F.array("entry")), 1
    while full < depth:
        at = F.when(F.size("nodes") == full, F.element_at("nodes", -1)).otherwise(F.concat(F.lit("\0"), "entry"))
        state = state.withColumn("_at", at).join(ways, "_at", "left").select("entry", F.concat("nodes", F.coalesce("ahead", F.array().cast("array<string>"))).alias("nodes"))
        full += reach
    state = state.withColumn("nodes", F.slice("nodes", 1, depth))
    first_at = lambda i: F.array_position("nodes", F.get("nodes", i)).cast("int") - 1
    again = F.get(F.filter(F.sequence(F.lit(0), F.size("nodes") - 1), lambda i: first_at(i) < i), F.lit(0))
    state = cut(
        state.withColumn("again", again).select(
            "entry", F.when(F.col("again").isNotNull(), F.slice("nodes", F.lit(1), F.coalesce("again", F.lit(0)))).otherwise(F.col("nodes")).alias("nodes"),
            F.when(F.col("again").isNotNull(), first_at(F.col("again"))).alias("cycle_at"), F.coalesce("again", F.size("nodes") - 1).alias("max_depth"),
        )
    )
    several = callees.where(F.size("callees") > 1).select("caller", F.col("callees").alias("candidates"))
    met = state.select("entry", F.posexplode("nodes").alias("p", "caller")).join(several, "caller").groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("p", "caller", "candidates"))).alias("b"))
    branches = F.coalesce(F.transform("b", lambda x: F.struct(x["caller"].alias("caller"), x["candidates"].alias("candidates"))), F.array().cast("array<struct<caller:string,candidates:array<string>>>"))
    return state.join(met, "entry", "left").select("entry", "nodes", "cycle_at", "max_depth", branches.alias("branches"))


def _stepped(start: DataFrame, callees: DataFrame, answers: DataFrame, depth: int) -> DataFrame:
    """Walks that have answers: at most ``depth`` joins, each of the walks with the callers; a walk that has ended matches none."""
    state = start.select(
        "entry", F.col("entry").alias("cursor"), F.array().cast("array<string>").alias("nodes"), F.lit(None).cast("int").alias("cycle_at"), F.lit(0).alias("max_depth"),
        F.array().cast("array<struct<caller:string,candidates:array<string>>>").alias("branches"),
    )
    callees = callees.withColumnRenamed("caller", "_at")
    for position in range(depth):
        seen = F.array_position("nodes", F.col("cursor"))
        # a walk that has ended finds nothing under its own name, which no other shares: nulls would all meet in one task
        key = F.coalesce("cursor", F.concat(F.lit("\0"), "entry"))
        stepped = state.withColumn("_at", key).join(callees, "_at", "left")
        asked = answers.select("entry", F.col("caller").alias("cursor"), "choice")
        if position == 0:  # all walks stand at their entries, so other answers need not be shuffled
            asked = asked.where(F.col("entry") == F.col("cursor"))
        stepped = stepped.join(asked, ["entry", "cursor"], "left")
        choice = F.when(F.array_contains("callees", F.col("choice")), F.col("choice")).otherwise(F.get("callees", F.lit(0)))
        open_, again = F.col("cursor").isNotNull(), F.coalesce(seen > 0, F.lit(False))
        new = open_ & ~again
        state = stepped.select(
            "entry",
            F.when(new, choice).alias("cursor"),
            F.when(new, F.concat("nodes", F.array("cursor"))).otherwise(F.col("nodes")).alias("nodes"),
            F.when(open_ & again, (seen - 1).cast("int")).otherwise(F.col("cycle_at")).alias("cycle_at"),
            F.when(open_, F.lit(position)).otherwise(F.col("max_depth")).alias("max_depth"),
            F.when(new & (F.size("callees") > 1), F.concat("branches", F.array(F.struct(F.col("cursor").alias("caller"), F.col("callees").alias("candidates")))))
            .otherwise(F.col("branches")).alias("branches"),
        )
    return state.drop("cursor").select("entry", "nodes", "cycle_at", "max_depth", "branches")


def paths_of(walked: DataFrame) -> DataFrame:
    of = category_of(F.col("entry"))
    return walked.select(
        canonical_hash(kind=F.lit("path"), entryNodeIdentity=F.col("entry")).alias("path_id"), "entry", F.size("nodes").alias("node_count"), "max_depth",
        of["category"].alias("category"), of["category_order"].alias("category_order"),
    )


def path_nodes_of(walked: DataFrame) -> DataFrame:
    """Positions from 0. The node that a cycle comes back to carries its own position as the mark."""
    return walked.select("entry", "cycle_at", F.posexplode("nodes").alias("position", "node_identity")).select(
        canonical_hash(kind=F.lit("path"), entryNodeIdentity=F.col("entry")).alias("path_id"), "entry", "position", "node_identity",
        F.when(F.col("position") == F.col("cycle_at"), F.col("cycle_at")).alias("cycle_back_to_position"),
    )


def branch_questions(walked: DataFrame) -> DataFrame:
    rows = walked.select("entry", F.explode("branches").alias("b")).select("entry", "b.caller", "b.candidates")
    path_id = canonical_hash(kind=F.lit("path"), entryNodeIdentity=F.col("entry"))
    return rows.select(
        canonical_hash(kind=F.lit("path_branch"), entryNodeIdentity=F.col("entry"), callerIdentity=F.col("caller")).alias("key"),
        F.lit("path_branch").alias("kind"),
        canonical_json(kind=F.lit("path_branch"), pathId=path_id, callerIdentity=F.col("caller"), candidates=F.col("candidates")).alias("context"),
        "entry", "caller", "candidates",
    )


def with_categories(paths: DataFrame, given: DataFrame) -> DataFrame:
    """Categories from elsewhere (path_id, category, category_order) laid over the derived ones."""
    over = given.select("path_id", F.col("category").alias("_c"), F.col("category_order").alias("_o"))
    return paths.join(over, "path_id", "left").withColumns({"category": F.coalesce("_c", "category"), "category_order": F.coalesce("_o", "category_order")}).drop("_c", "_o")
