"""A Merkle manifest of a dataset, and an audit that climbs it from every leaf.

A row's leaf is a hash of its values. Per source, leaves in order of id are hashed in runs of 16, the hashes again in
runs of 16, until one is left, the source's subroot; subroots, in order of source, are hashed likewise into the root.
The levels are built bottom up and stored as rows with links to their parents. One recursive query of Spark then climbs
from the leaves along the links: at each step it appends the siblings to the proof and folds the claimed hash with them.

The leaves of one run have all nodes above them in common, so they climb in one row: it holds a folded hash for each of
them and the siblings above the run once. A row for each leaf would shuffle the same siblings 16 times a level.

Every run ends in the root, so a node is joined as often as there are blocks of ``BLOCK`` runs below it: no join brings
more than that many rows to one key. Places, and so runs, come from range-wise sums; no task holds a source.

Defined results: a null value is hashed as ``-``, other values as their size in bytes, a colon and the value, so null
differs from empty and texts of any length are hashed whole; a null source is a source of its own, the first; null ids
come first in their source, rows of one id in order of their leaves, and a repeated row is a leaf of its own; an empty
table gives an empty result. Only the named columns are read, so further columns have no part in the result, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, running

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes hashed together.
FAN = 16
#: Rows that one key of a join brings together at most, on the side that grows.
BLOCK = 256


@dataclass(frozen=True)
class Manifest:
    """``runs``: up to 16 leaves each, with their ids and claimed leaves. ``nodes``: all inner nodes, linked to their parents."""

    runs: DataFrame
    nodes: DataFrame


def leaf(values: Sequence[Column]) -> Column:
    """The hash of a row's values, in binary."""
    sized = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]
    return F.unhex(F.sha2(F.concat(*sized), 256))


def lower_ascii(text: Column) -> Column:
    """The text with A-Z lower-cased and all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _hash(digests: Column) -> Column:
    """The hash of digests, given one after the other, as hexadecimal text."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def _joined(digests: Column) -> Column:
    """An array of digests one after the other."""
    return F.unhex(F.array_join(F.transform(digests, F.hex), ""))


def _id(tree: Column | str, level: Column, pos: Column) -> Column:
    return F.struct(F.col(tree).alias("tree") if isinstance(tree, str) else tree.alias("tree"), level.cast("int").alias("level"), pos.cast("long").alias("pos"))


def _linked(level_nodes: DataFrame, level: int, top: bool, n_trees: int) -> DataFrame:
    """Nodes (tree, pos, n, …) of a level of ``n`` nodes with their id, their parent's id and their slot below it. The root has no parent."""
    none, t = F.lit(None), F.lit(-1).cast("long")
    pos = F.col("pos")
    up = F.when(F.col("n") > 1, _id("tree", F.lit(level + 1), F.floor(pos / FAN)))
    slot = pos
    if not top:
        # a subroot is a leaf of the tree of sources, at the place of its source
        up = up.otherwise(_id(t, F.lit(1), F.floor(F.col("tree") / FAN)) if n_trees > 1 else none)
        slot = F.when(F.col("n") > 1, pos).otherwise(F.col("tree"))
    return level_nodes.withColumns({"id": _id("tree", F.lit(level), pos), "parent": up, "slot": (slot % FAN).cast("int"), "subroot": (F.col("n") == 1) & (not top)})


def _climbed(level_nodes: DataFrame) -> DataFrame:
    """The level above one whose trees have more than one node."""
    held = level_nodes.where(F.col("n") > 1).groupBy("tree", F.floor(F.col("pos") / FAN).alias("pos"), F.ceil(F.col("n") / FAN).alias("n"))
    found = held.agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("below"), F.min("first").alias("first"), F.max("last").alias("last"))
    return cut(found.withColumn("children", _joined(F.col("below.digest"))).drop("below").withColumn("digest", _hash(F.col("children"))))


def build(docs: DataFrame, columns: Sequence[str] = COLUMNS, doc_id: str = "doc_id", source: str = "source", claims: Mapping[str, Column] | None = None, claimed_by: Column | None = None) -> Manifest:
    """The manifest of the documents. Where ``claimed_by`` holds, a row also claims a leaf with other values in the columns of ``claims``."""
    own = [F.col(c) for c in columns]
    claim = leaf([(claims or {}).get(c, F.col(c)) for c in columns])
    other = F.when(F.coalesce(claimed_by, F.lit(False)), claim) if claimed_by is not None else F.lit(None).cast("binary")
    leaves = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), leaf(own).alias("leaf"), other.alias("claim")))
    placed = running(leaves, [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("claim").asc_nulls_first()], {"place": F.lit(1)})
    sized = placed.groupBy("source").agg(F.min("place").alias("start"), F.count("*").alias("n"))
    sources = cut(running(sized, [F.col("source").asc_nulls_first()], {"tree": F.lit(1), "runs_before": F.ceil(F.col("n") / FAN)}))
    n_trees, largest = sources.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()

    # a source is dealt to as many blocks of places as it has, so a large one is no hot key
    each = FAN * BLOCK
    block = F.explode(F.sequence(F.floor(F.col("start") / each), F.floor((F.col("start") + F.col("n") - 1) / each)))
    of_blocks = sources.select(F.col("source").alias("of_source"), "start", "n", "tree", "runs_before", block.alias("of_block"))
    at = placed.join(of_blocks, F.col("source").eqNullSafe(F.col("of_source")) & (F.floor(F.col("place") / each) == F.col("of_block")))
    nth = F.col("place") - F.col("start")
    runs = cut(
        at.groupBy("tree", "n", (F.col("runs_before") + F.floor(nth / FAN)).alias("run"), F.floor(nth / FAN).alias("pos"))
        .agg(F.sort_array(F.collect_list(F.struct((nth % FAN).cast("int").alias("slot"), "leaf", "claim", "doc_id"))).alias("members"))
        .withColumn("children", _joined(F.col("members.leaf")))
    )

    first = runs.where(F.col("n") > 1).select("tree", "pos", F.ceil(F.col("n") / FAN).alias("n"), F.col("run").alias("first"), F.col("run").alias("last"), "children", _hash(F.col("children")).alias("digest"))
    level, levels, now = 1, [], first
    lone = runs.where(F.col("n") == 1).select("tree", "pos", "n", F.col("run").alias("first"), F.col("run").alias("last"), "children", F.col("children").alias("digest"))
    subroots, here = [lone], largest
    while here > 1:
        levels.append(_linked(now, level, False, n_trees))
        subroots.append(now.where(F.col("n") == 1).select(lone.columns))
        here = -(-here // FAN)
        if here > 1:
            level, now = level + 1, _climbed(now)
    if n_trees > 1:
        found = subroots[0]
        for s in subroots[1:]:
            found = found.unionByName(s)
        now, level, here = found.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_trees).cast("long").alias("n"), "first", "last", "children", "digest"), 0, n_trees
        while here > 1:
            level, now, here = level + 1, _climbed(now), -(-here // FAN)
            levels.append(_linked(now, level, True, n_trees))
    linked = _linked(runs.select("tree", "n", "pos", "run", "members", "children"), 0, False, n_trees)
    # a leaf of a source of many has a parent in it and its own slot; a source's only leaf is its subroot
    slots = F.when(F.col("n") > 1, F.transform("members", lambda m: m["slot"])).otherwise(F.array("slot"))
    up = F.when(F.col("n") > 1, _id("tree", F.lit(1), F.col("pos"))).otherwise(F.col("parent"))
    runs = linked.select("run", "members", "children", slots.alias("slots"), up.alias("parent"), F.when(F.col("n") == 1, F.col("children")).alias("subroot"))
    columns_of_nodes = ["id", "parent", "slot", "digest", "children", "subroot", "first", "last"]
    nodes = None
    for x in levels:
        nodes = x.select(columns_of_nodes) if nodes is None else nodes.unionByName(x.select(columns_of_nodes))
    if nodes is None:
        nodes = _linked(lone, 0, False, n_trees).where(F.lit(False)).select(columns_of_nodes)
    return Manifest(runs, cut(nodes))


CLIMB = """
WITH RECURSIVE climb AS (
  SELECT run, parent, slots, folds, proof, subroot, digest, 0 AS depth FROM {start}
  UNION ALL
  SELECT c.run, n.parent, transform(c.slots, s -> n.slot),
    zip_with(c.folds, c.slots, (f, s) -> unhex(sha2(lower(concat(hex(substring(n.children, 1, 32 * s)), hex(f), hex(substring(n.children, 32 * s + 33)))), 256))),
    CASE WHEN c.depth > 0 OR size(c.slots) = 1 THEN concat(c.proof, substring(n.children, 1, 32 * c.slots[0]), substring(n.children, 32 * c.slots[0] + 33)) ELSE c.proof END,
    CASE WHEN n.subroot THEN n.digest ELSE c.subroot END, n.digest, c.depth + 1
  FROM climb c JOIN {nodes} n ON n.id = c.parent AND n.block = c.run DIV {block}
)
SELECT run, folds, proof, subroot, digest AS root FROM climb WHERE parent IS NULL
"""
#: Sessions limit the rows and steps of recursive queries; the depth of the tree bounds both here.
UNLIMITED = {"spark.sql.cteRecursionRowLimit": "-1"}


def climb(manifest: Manifest) -> DataFrame:
    """For each run: what its leaves' claims fold to, the siblings above it, its subroot and the root.

    A run's own leaves are not in ``proof`` where there are several, as each has other siblings among them.
    """
    spark = manifest.runs.sparkSession
    claims = F.transform("members", lambda m: F.coalesce(m["claim"], m["leaf"]))
    start = manifest.runs.select("run", "parent", "slots", claims.alias("folds"), F.unhex(F.lit("")).alias("proof"), "subroot", F.coalesce("subroot", F.unhex(F.lit(""))).alias("digest"))
    blocks = F.sequence(F.floor(F.col("first") / BLOCK), F.floor(F.col("last") / BLOCK))
    nodes = manifest.nodes.select("id", "parent", "slot", "digest", "children", "subroot", F.explode(blocks).alias("block"))
    before = {k: spark.conf.get(k, None) for k in UNLIMITED}
    for k, v in UNLIMITED.items():
        spark.conf.set(k, v)
    try:
        return cut(spark.sql(CLIMB, start=start, nodes=nodes, block=BLOCK))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def audit(manifest: Manifest) -> DataFrame:
    """A row for each leaf: doc_id, leaf, subroot, root, the hash of its proof, the root that its claim folds to, and whether that is the root. Hashes are hexadecimal text."""
    text = lambda c: F.lower(F.hex(c))
    ends = climb(manifest)
    each = manifest.runs.select("run", "children", F.size("members").alias("held"), F.posexplode("members").alias("k", "m")).join(ends, "run")
    # the leaves of the run but for the row's own, in order, come before what is above the run
    beside = F.when(F.col("held") > 1, F.concat(F.substring("children", F.lit(1), 32 * F.col("k")), F.substring("children", 32 * F.col("k") + 33, F.lit(32 * FAN)))).otherwise(F.unhex(F.lit("")))
    fold = F.get("folds", F.col("k"))
    return each.select(
        F.col("m.doc_id").alias("doc_id"), text("m.leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        F.sha2(text(F.concat(beside, "proof")), 256).alias("proof_sha256"), text(fold).alias("folded_root"), (fold == F.col("root")).alias("verified"),
    )
