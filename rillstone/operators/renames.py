"""Renamed functions: removed and new ones of one file and kind whose names share enough tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import canonical_hash, canonical_json, name_tokens, token_similarity
from ..functions.lineage import cut
from .edits import overlapping

#: A name in source code, and words that are part of its shape.
NAME = r"^#?[\p{L}_$][\p{L}\p{N}_$]*$"
WORDS = tuple("if else for while do switch case return throw new function class const let var await yield typeof async try catch finally break continue in of instanceof delete void".split())

THRESHOLD = 0.55


def removed_and_new(prior: DataFrame, current: DataFrame, key: str = "node_identity") -> tuple[DataFrame, DataFrame]:
    return prior.join(current.select(key), key, "left_anti"), current.join(prior.select(key), key, "left_anti")


def best_matches(removed: DataFrame, new: DataFrame, block: list[str], key: str, order: str, tokens: Column, name: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """For each removed row the new row of its block with the most similar tokens, the first in order among equals.

    Of n tokens in one order, rows as similar as wanted share one of the first n - ceil(t n) + 1 of each. Rare tokens
    come first, so rows meet by those alone, and a token that all share brings nobody together. Rows whose numbers of
    tokens lie too far apart are left out before they are compared. Rows of a block with equal tokens, and equal names if
    names count, are compared once: of new ones the first in order stands for all, and every removed one takes what was
    found for its like. Not one to one: two removed rows may share a match.
    """
    told = F.array_sort(F.coalesce(tokens, F.array().cast("array<string>")))
    named = [F.col(name).alias("_name")] if name else []
    kept = ["tokens", *(["name"] if name else [])]

    def alike(df: DataFrame) -> DataFrame:
        rows = df.select(*block, F.col(key).alias("_key"), F.col(order).alias("_order"), told.alias("_tokens"), *named)
        return rows.withColumn("_like", F.to_json(F.struct(*[f"_{c}" for c in kept])))

    old, like = alike(removed), [*block, "_like", *[f"_{c}" for c in kept]]
    first = F.min_by(F.struct("_key", "_order"), F.struct("_order")).alias("_first")
    side = lambda df, mark, *more: df.select(*block, F.col("_like").alias(f"{mark}_key"), *[F.col(f"_{c}").alias(f"{mark}_{c}") for c in kept], *more)
    both = {"old": side(old.select(*like).distinct(), "old"), "new": side(alike(new).groupBy(*like).agg(first), "new", F.col("_first").alias("new_first"))}
    pairs = near_pairs(both, block, threshold, [*kept, "first"])
    score = token_similarity(F.col("old_tokens"), F.col("new_tokens"))
    if name:  # equal names count as the same even without a token
        score = F.when(F.col("old_name") == F.col("new_name"), F.lit(1.0)).otherwise(score)
        of_name = lambda mark: both[mark].withColumn("_name", F.col(f"{mark}_name"))
        pairs = pairs.unionByName(of_name("old").join(of_name("new"), [*block, "_name"]).select(pairs.columns))
    scored = pairs.withColumn("similarity", score).where(F.col("similarity") >= threshold)
    best = scored.groupBy(*block, F.col("old_key").alias("_like")).agg(F.min_by(F.struct(F.col("new_first._key").alias("new_key"), "similarity"), F.struct(-F.col("similarity"), F.col("new_first._order"))).alias("_b"))
    found = old.select(*block, "_key", "_like").join(best, [*block, "_like"])
    return found.select(*block, F.col("_key").alias("old_key"), F.col("_b.new_key").alias("new_key"), F.col("_b.similarity").alias("similarity"))


def near_pairs(both: dict[str, DataFrame], block: list[str], threshold: float, kept: list[str] | None = None) -> DataFrame:
    """Pairs (old_key, new_key) of a block that can be as similar as wanted by the distinct ``old_tokens`` and ``new_tokens``.

    With ``kept`` (for short tokens) pairs carry these columns of their sides, as far as those have them. They are told
    where they meet first, so none of them is shuffled.
    """
    each = reduce(DataFrame.unionByName, [df.select(F.explode(f"{mark}_tokens").alias("_token")) for mark, df in both.items()])
    often = each.groupBy("_token").agg(F.count("*").alias("_n"))
    carried = {mark: [f"{mark}_{c}" for c in kept or () if f"{mark}_{c}" in df.columns] for mark, df in both.items()}

    def dealt(mark: str) -> DataFrame:
        own = [*block, f"{mark}_key"]
        rows = both[mark].select(*own, *carried[mark], F.explode(f"{mark}_tokens").alias("_token")).join(often, "_token")
        ranked = rows.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("_n", "_token"))).alias("_ts"), *[F.first(c).alias(c) for c in carried[mark]])
        n = F.size("_ts") - F.ceil(F.lit(threshold) * F.size("_ts") - 1e-9).cast("int") + 1
        met = ranked.withColumns({f"{mark}_size": F.size("_ts"), f"{mark}_met": F.transform(F.slice("_ts", F.lit(1), n), lambda x: x["_token"])})
        return met.select(*own, *carried[mark], f"{mark}_size", *([f"{mark}_met"] if kept else []), F.explode(f"{mark}_met").alias("_token"))

    near = (F.col("old_size") >= F.lit(threshold) * F.col("new_size") - 1e-9) & (F.col("new_size") >= F.lit(threshold) * F.col("old_size") - 1e-9)
    pairs = dealt("old").join(dealt("new"), [*block, "_token"]).where(near)
    if not kept:
        return pairs.select(*block, "old_key", "new_key").distinct()
    once = F.get(F.array_intersect("old_met", "new_met"), F.lit(0)) == F.col("_token")
    return pairs.where(once).select(*block, "old_key", "new_key", *carried["old"], *carried["new"])


def rename_candidates(prior: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Nodes that seem renamed; files that are gone as a whole are left out, since they have no new nodes."""
    removed, new = removed_and_new(prior, nodes)
    of_order = lambda df: df.withColumn("_order", F.struct("file_ord", "node_ord")) if "node_ord" in df.columns else df.withColumn("_order", F.col("node_identity"))
    tokens = F.array_distinct(name_tokens(F.col("name")))
    old = removed.withColumn("_order", F.lit(0))
    found = best_matches(old, of_order(new), ["file_path", "kind"], "node_identity", "_order", tokens, "name", threshold)
    return found.select(F.col("old_key").alias("old_identity"), F.col("new_key").alias("new_identity"), "file_path", "kind", "similarity")


#: How much the shape of the code, its names and its signature weigh in a score, and the score from which a rename is likely.
WEIGHTS, SHAPE_THRESHOLD = (0.5, 0.25, 0.25), 0.75


def shapes(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """For symbols (path, node_identity, low, high: their tokens) the distinct ``shape`` elements and ``names`` of their text.

    What stands straight in a bracket, with names and literals replaced by their kinds, is the shape of a subtree; of
    equal subtrees the first, second and so on are different elements.
    """
    t = F.col("t")
    kind = F.when(t.rlike(NAME) & ~t.isin(*WORDS), "n").when(t.rlike("^['\"]"), "s").when(t.rlike(r"^\.?\d"), "0").otherwise(t)
    here = tokens.select("path", "ord", "t", F.coalesce("within", F.lit(-1)).alias("within"), kind.alias("kind"), F.col("ord").alias("_o"))
    held = overlapping(here, symbols.select("path", "node_identity", "low", "high"), (F.col("ord"), F.col("low")), (F.col("_o"), F.col("high")))
    trees = held.groupBy("node_identity", "within").agg(F.xxhash64(F.transform(F.sort_array(F.collect_list(F.struct("ord", "kind"))), lambda x: x["kind"])).alias("h"))
    nth = trees.groupBy("node_identity", "h").agg(F.count("*").cast("int").alias("n")).select("node_identity", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.xxhash64("h", i))).alias("e"))
    bags = nth.groupBy("node_identity").agg(F.sort_array(F.collect_list(F.col("e").cast("string"))).alias("shape"))
    names = held.where(F.col("kind") == "n").groupBy("node_identity").agg(F.array_sort(F.collect_set("t")).alias("names"))
    return bags.join(names, "node_identity", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def signature_similarity(a: Column, b: Column) -> Column:
    """1 for equal parameters and result, 0.5 for as many parameters, else 0; two without a signature are equal."""
    return (
        F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).when((a["params"] == b["params"]) & (a["return_type"] == b["return_type"]), 1.0)
        .when(F.size(a["params"]) == F.size(b["params"]), 0.5).otherwise(0.0)
    )


def one_to_one(scored: DataFrame) -> DataFrame:
    """Of pairs (old_key, new_key, similarity) a matching: in rounds, pairs in which each is the other's best, until none is left."""
    left, taken = cut(scored), None
    rank = lambda other: F.min(F.struct((-F.col("similarity")).alias("s"), F.col(other).alias("k"))).alias("best")
    while not left.isEmpty():
        old, new = left.groupBy("old_key").agg(rank("new_key")), left.groupBy("new_key").agg(rank("old_key"))
        mutual = old.select("old_key", F.col("best.k").alias("new_key"), (-F.col("best.s")).alias("similarity")).join(new.select("new_key", F.col("best.k").alias("old_key")), ["old_key", "new_key"])
        mutual = cut(mutual.select("old_key", "new_key", "similarity"))
        taken = mutual if taken is None else taken.unionByName(mutual)
        left = cut(left.join(mutual.select("old_key"), "old_key", "left_anti").join(mutual.select("new_key"), "new_key", "left_anti"))
    return scored.select("old_key", "new_key", "similarity").limit(0) if taken is None else taken


def shape_renames(prior, current, threshold: float = SHAPE_THRESHOLD) -> DataFrame:
    """An extension: removed and new functions of one file and kind (of two results of ``parse``) that are alike by shape, names and signature, one to one.

    A score of ``threshold`` needs half of what the shape weighs, so pairs are met by the rarest elements of their shapes.
    """
    keys = ["node_identity", "file_path", "kind", "signature"]
    old, new = removed_and_new(prior.nodes.select(*keys).dropDuplicates(["node_identity"]), current.nodes.select(*keys).dropDuplicates(["node_identity"]))

    def side(parsed, rows: DataFrame, mark: str) -> DataFrame:
        spans = parsed.symbols.join(rows.select("node_identity"), "node_identity", "left_semi").select(F.col("file_path").alias("path"), "node_identity", F.col("node_ord").alias("low"), F.col("close_ord").alias("high"))
        told = rows.join(shapes(parsed.tokens, spans.dropDuplicates(["node_identity"])), "node_identity")
        return cut(told.select("file_path", "kind", *[F.col(c).alias(f"{mark}_{n}") for c, n in (("node_identity", "key"), ("shape", "tokens"), ("names", "names"), ("signature", "signature"))]))

    both, block = {"old": side(prior, old, "old"), "new": side(current, new, "new")}, ["file_path", "kind"]
    least = (threshold - sum(WEIGHTS[1:])) / WEIGHTS[0]
    pairs = near_pairs(both, block, least).join(both["old"], [*block, "old_key"]).join(both["new"], [*block, "new_key"])
    parts = (token_similarity(F.col("old_tokens"), F.col("new_tokens")), token_similarity(F.col("old_names"), F.col("new_names")), signature_similarity(F.col("old_signature"), F.col("new_signature")))
    scored = pairs.withColumn("similarity", sum((w * p for w, p in zip(WEIGHTS, parts, strict=True)), F.lit(0.0))).where(F.col("similarity") >= threshold - 1e-9)
    found = one_to_one(scored.select("old_key", "new_key", "similarity"))
    return found.select(F.col("old_key").alias("old_identity"), F.col("new_key").alias("new_identity"), "similarity")


def rename_questions(candidates: DataFrame) -> DataFrame:
    old, new = F.col("old_identity"), F.col("new_identity")
    return candidates.select(
        canonical_hash(kind=F.lit("rename"), oldIdentity=old, newIdentity=new).alias("key"),
        F.lit("rename").alias("kind"),
        canonical_json(kind=F.lit("rename"), oldIdentity=old, newIdentity=new, similarity=F.col("similarity")).alias("context"),
        F.lit("same").alias("suggestion"),
    )
