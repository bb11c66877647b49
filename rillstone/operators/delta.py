"""Two snapshots compared: contracts, paths, callers affected and unchanged paths crossed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import canonical_hash, last_segment
from .resolve import last_by


def contract_changes(base: DataFrame, head: DataFrame, key: str = "node_identity") -> DataFrame:
    """Up to three changes a node, from exported, params (array) and return_type on both sides.

    A full outer join on the identity; changes come from one array of cases, not from a join each. Kinds and notes are fixed values.
    """
    side = lambda df, m: df.select(key, F.lit(True).alias(f"{m}_in"), F.col("exported").alias(f"{m}_exported"), F.col("params").alias(f"{m}_params"), F.col("return_type").alias(f"{m}_return"))
    both = side(base, "b").join(side(head, "h"), key, "full_outer")
    b, h = F.coalesce("b_in", F.lit(False)), F.coalesce("h_in", F.lit(False))
    be, he = F.coalesce("b_exported", F.lit(False)), F.coalesce("h_exported", F.lit(False))
    name = last_segment(F.col(key).cast("string"))
    case = lambda cond, kind, note: F.when(cond, F.struct(F.lit(kind).alias("change"), note.alias("note")))
    export = F.coalesce(
        case(~b & h & he, "export_added", F.concat(name, F.lit(" is exported in head, not in base"))),
        case(~h & b & be, "export_removed", F.concat(name, F.lit(" was exported in base, not in head"))),
        case(b & h & he & ~be, "export_added", F.concat(name, F.lit(" became exported"))),
        case(b & h & be & ~he, "export_removed", F.concat(name, F.lit(" is no longer exported"))),
    )
    signed = F.col("b_params").isNotNull() & F.col("h_params").isNotNull()
    more = F.size("h_params") - F.size("b_params")
    params = F.coalesce(
        case(signed & (more > 0), "param_added", F.concat(name, F.lit(" gained "), more.cast("string"), F.lit(" parameter(s)"))),
        case(signed & (more < 0), "param_removed", F.concat(name, F.lit(" lost "), (-more).cast("string"), F.lit(" parameter(s)"))),
        case(signed & (F.array_join("b_params", "|") != F.array_join("h_params", "|")), "param_type_changed", F.concat(name, F.lit(" parameter shape changed"))),
    )
    shown = lambda c: F.when(F.col(c) == "", "<inferred>").otherwise(F.col(c))
    returned = case(signed & (F.col("b_return") != F.col("h_return")), "return_type_changed", F.concat(name, F.lit(" return type "), shown("b_return"), F.lit(" → "), shown("h_return")))
    rows = both.withColumn("_c", F.explode(F.filter(F.array(export, params, returned), lambda c: c.isNotNull())))
    change_id = canonical_hash(kind=F.col("_c.change"), nodeIdentity=F.col(key).cast("string"))
    return rows.select(change_id.alias("change_id"), key, F.col("_c.change").alias("change"), F.col("_c.note").alias("note"))


def path_change(in_base: Column, in_head: Column, base_nodes: Column, head_nodes: Column) -> Column:
    return (
        F.when(~in_base, "net_new").when(~in_head, "net_gone").when(base_nodes == head_nodes, "unchanged").otherwise("modified_in_place")
    )


def sequence_deltas(base: DataFrame, head: DataFrame, key: str = "entry", nodes: str = "nodes", path_id: str = "path_id") -> DataFrame:
    """Paths keyed by their entry on both sides: what kind of change, and the nodes added and removed, in order."""
    side = lambda df, m: df.select(key, F.col(path_id).alias(f"{m}_path_id"), F.col(nodes).alias(f"_{m}"), F.lit(True).alias(f"_in_{m}"))
    both = side(base, "base").join(side(head, "head"), key, "full_outer")
    none = F.array().cast(base.schema[nodes].dataType)
    b, h = F.coalesce("_base", none), F.coalesce("_head", none)
    flag = lambda m: F.coalesce(f"_in_{m}", F.lit(False))
    return both.select(
        key, "base_path_id", "head_path_id", path_change(flag("base"), flag("head"), b, h).alias("classification"),
        F.array_except(h, b).alias("added_nodes"), F.array_except(b, h).alias("removed_nodes"),
    )


def affected_callers(changes: DataFrame, edges: DataFrame, members: DataFrame, deltas: DataFrame, key: str = "node_identity") -> DataFrame:
    """A row for each call in head to a changed node, with whether its caller lies on a walked, or on a changed, path.

    Calls stay a bag: one row each, unresolved ones included. Membership is summed up
    before it is joined, so calls are never multiplied by paths. Calls are shuffled as callee and caller alone, and
    meet the changes last, so a change's key is not shuffled for each call.
    """
    return _flagged_calls(edges, members, deltas, key).join(_changes_by_callee(changes, key), "callee").select(F.explode("_ids").alias("change_id"), "caller", "on_walked_path", "on_changed_path")


def _changes_by_callee(changes: DataFrame, key: str) -> DataFrame:
    return changes.groupBy(F.col(key).alias("callee")).agg(F.collect_list("change_id").alias("_ids"))


def _flagged_calls(edges: DataFrame, members: DataFrame, deltas: DataFrame, key: str) -> DataFrame:
    """Calls (callee, caller) with ``on_walked_path`` and ``on_changed_path`` of their callers."""
    changed = deltas.where((F.col("classification") != "unchanged") & F.col("head_path_id").isNotNull()).select(F.col("head_path_id").alias("path_id"), F.lit(True).alias("_changed"))
    flags = members.join(changed, "path_id", "left").groupBy(F.col(key).alias("caller")).agg(F.lit(True).alias("_any"), F.bool_or(F.coalesce("_changed", F.lit(False))).alias("_some"))
    return edges.select("callee", "caller").join(flags, "caller", "left").select(
        "callee", "caller", F.coalesce("_any", F.lit(False)).alias("on_walked_path"), F.coalesce("_some", F.lit(False)).alias("on_changed_path")
    )


def indirect_impact(changes: DataFrame, members: DataFrame, deltas: DataFrame, key: str = "node_identity") -> DataFrame:
    """Unchanged paths of head that cross a changed node, with the changes."""
    unchanged = deltas.where((F.col("classification") == "unchanged") & F.col("head_path_id").isNotNull()).select(F.col("head_path_id").alias("path_id"))
    hit = members.select("path_id", key).join(unchanged, "path_id", "left_semi").join(changes.select(key, "change_id"), key)
    return hit.groupBy("path_id").agg(F.array_sort(F.collect_set("change_id")).alias("change_ids"))


def caller_buckets(callers: DataFrame) -> DataFrame:
    """How many affected callers lie on changed paths, on walked ones only, and on none."""
    return callers.groupBy("change_id").agg(
        F.count_if("on_changed_path").alias("on_changed"),
        F.count_if(F.col("on_walked_path") & ~F.col("on_changed_path")).alias("on_walked_only"),
        F.count_if(~F.col("on_walked_path")).alias("off_paths"),
    )


@dataclass(frozen=True)
class Comparison:
    contract_changes: DataFrame
    path_deltas: DataFrame
    affected_callers: DataFrame
    indirect_impact: DataFrame


def compare(base, head) -> Comparison:
    """Compares two analyses (see ``plans.analysis``)."""
    signed = lambda a: last_by(a.nodes, ["node_identity"], ["file_ord", "node_ord"], "exported", "signature").select("node_identity", "exported", "signature.params", "signature.return_type")
    changes = contract_changes(signed(base), signed(head))
    sequence = lambda a: a.path_nodes.groupBy("entry", "path_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "node_identity"))), lambda x: x["node_identity"]).alias("nodes"))
    deltas = sequence_deltas(sequence(base), sequence(head))
    members = head.path_nodes.select("path_id", "node_identity")
    return Comparison(changes, deltas, affected_callers(changes, head.call_edges.where(F.col("callee").isNotNull()), members, deltas), indirect_impact(changes, members, deltas))
