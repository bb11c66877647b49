"""Review state as a log of events: what is current, what came before, and the writes, each as new events.

Events are appended, never changed. ``op`` is set or clear; ``reason`` says why the
row before it was superseded. The order is (event_ts, event_seq), which is total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import running

KEYS = ["node_identity", "scope"]
COLUMNS = ["event_seq", "event_ts", "node_identity", "scope", "op", "status", "comment", "code_hash", "reviewer_id", "reason"]


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by an aggregate that each task does first for itself."""
    rest = [c for c in log.columns if c not in keys]
    picked = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def current_reviews(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Current rows, with created_at of the first write since the last clear and updated_at of the last."""
    keys = keys or KEYS
    order = W.partitionBy(*keys).orderBy("event_ts", "event_seq")
    spans = log.withColumn("_span", F.sum(F.when(F.col("op") == "clear", 1).otherwise(0)).over(order))
    made = spans.where(F.col("op") == "set").groupBy(*keys, "_span").agg(F.min("event_ts").alias("created_at"))
    last = latest(spans, keys, ["event_ts", "event_seq"]).where(F.col("op") == "set")
    return last.join(made, [*keys, "_span"]).drop("_span", "op", "reason").withColumnRenamed("event_ts", "updated_at")


def review_history(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every superseded row, with when and why: a projection of the same log."""
    order = W.partitionBy(*(keys or KEYS)).orderBy("event_ts", "event_seq")
    after = lambda c: F.lead(c).over(order)
    return log.withColumn("superseded_at", after("event_ts")).withColumn("superseded_by", F.coalesce(after("reason"), F.lit("replaced"))).where(
        (F.col("op") == "set") & F.col("superseded_at").isNotNull()
    ).drop("op", "reason").withColumnRenamed("superseded_by", "reason")


def _events(rows: DataFrame, op: str, reason: str, status: Column, code_hash: Column, comment: Column, reviewer: Column, now: Column, scope: Column) -> DataFrame:
    return rows.select(
        F.lit(None).cast("long").alias("event_seq"), now.cast("timestamp").alias("event_ts"), "node_identity", scope.alias("scope"), F.lit(op).alias("op"),
        status.alias("status"), comment.alias("comment"), code_hash.alias("code_hash"), reviewer.alias("reviewer_id"), F.lit(reason).alias("reason"),
    )


def set_status(nodes: DataFrame, status: str, comment: str | None, reviewer: str, now: Column, scope: str = "global", hash_column: str = "content_hash") -> DataFrame:
    """Events that set a status on nodes; an unknown hash is recorded as empty."""
    if status == "info_requested" and not (comment or "").strip():
        raise ValueError("a request for information needs a comment")
    return _events(nodes, "set", "replaced", F.lit(status), F.coalesce(hash_column, F.lit("")), F.lit(comment).cast("string"), F.lit(reviewer), now, F.lit(scope))


def with_hashes(targets: DataFrame, nodes: DataFrame, hash_column: str = "content_hash") -> DataFrame:
    """Targets (node_identity) with the hash that the last analysis has of each, for ``set_status``; null, and so recorded as empty, where it knows none."""
    known = nodes.groupBy("node_identity").agg(F.any_value(hash_column).alias("_hash"))
    return targets.drop(hash_column).join(known, "node_identity", "left").withColumnRenamed("_hash", hash_column)


def clear(current: DataFrame, now: Column, reason: str = "manual_clear") -> DataFrame:
    """Events that clear current rows."""
    none = F.lit(None).cast("string")
    return _events(current, "clear", reason, none, none, none, F.col("reviewer_id"), now, F.col("scope"))


def promote(current: DataFrame, path_id: str, reviewer: str, now: Column) -> DataFrame:
    """Events that make the path's rows global and clear them."""
    scoped = current.where(F.col("scope") == f"path:{path_id}")
    up = _events(scoped, "set", "superseded_by_promote", F.col("status"), F.col("code_hash"), F.col("comment"), F.lit(reviewer), now, F.lit("global"))
    return up.unionByName(clear(scoped, now, "promoted_to_global"))


def cascade_plan(targets: DataFrame, current: DataFrame, status: Column, resolution: Column, group: list[str], key: str = "node_identity") -> DataFrame:
    """What setting a status on whole files does to each of their functions.

    ``targets``: a row for each function, with its file's ``group`` columns. A file is
    applied unless a function's global status differs and no resolution is given.
    action: applied, preserved, overridden, or conflict (file not applied).
    """
    known = current.where(F.col("scope") == "global").select(F.col(key), F.col("status").alias("current_status"))
    rows = targets.join(known, key, "left")
    differs = F.col("current_status").isNotNull() & (F.col("current_status") != status)
    blocked = F.max(differs & resolution.isNull()).over(W.partitionBy(*group))
    return rows.withColumn("_blocked", blocked).withColumn(
        "action",
        F.when(F.col("_blocked"), F.when(differs, "conflict").otherwise("untouched"))
        .when(~differs, "applied")
        .when(resolution == "preserve", "preserved")
        .otherwise("overridden"),
    ).drop("_blocked")


def cascade_counts(plan: DataFrame, group: list[str]) -> DataFrame:
    n = lambda action: F.count_if(F.col("action") == action)
    return plan.groupBy(*group).agg(
        (n("conflict") == 0).alias("applied"), n("applied").alias("functions_applied"), n("preserved").alias("functions_preserved"),
        n("overridden").alias("functions_overridden"), n("conflict").alias("conflicts"),
    )


def cascade_events(plan: DataFrame, file_nodes: DataFrame, status: str, comment: str | None, reviewer: str, now: Column, group: list[str]) -> DataFrame:
    """Events of the applied files: each file's own row always, functions unless preserved."""
    applied = cascade_counts(plan, group).where("applied").select(*group)
    own = file_nodes.join(applied, group, "left_semi")
    functions = plan.where(F.col("action").isin("applied", "overridden")).select("node_identity", "content_hash")
    rows = own.select("node_identity", "content_hash").unionByName(functions)
    return _events(rows, "set", "file_cascade", F.lit(status), F.coalesce("content_hash", F.lit("")), F.lit(comment).cast("string"), F.lit(reviewer), now, F.lit("global"))


def reset(current: DataFrame, scope_nodes: DataFrame, now: Column) -> DataFrame:
    """Events that clear every current row of the nodes in scope, whatever its own scope."""
    return clear(current.join(scope_nodes.select("node_identity").distinct(), "node_identity", "left_semi"), now, "progress_reset")


def append(log: DataFrame, events: DataFrame) -> DataFrame:
    """The log with events numbered on after it, in order of time, node and scope. Where several write, ``sources.commits.EventLog`` gives the numbers."""
    last = log.agg(F.coalesce(F.max("event_seq"), F.lit(0)).alias("_last"))  # one row
    placed = running(events.drop("event_seq"), [F.col(c).asc_nulls_first() for c in ("event_ts", "node_identity", "scope", "op")], {"_nth": F.lit(1)})
    numbered = placed.crossJoin(F.broadcast(last)).withColumn("event_seq", F.col("_last") + 1 + F.col("_nth"))
    return log.select(*COLUMNS).unionByName(numbered.select(*COLUMNS))
