"""Roles of files and nodes from weighted signals, from a second opinion, and what is left to ask."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import canonical_hash, canonical_json
from .signals import Signal

#: Confidences from least to most.
LEVELS = ("none", "low", "medium", "high")


def level(confidence: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), confidence)


def matched_signals(df: DataFrame, signals: Sequence[Signal]) -> DataFrame:
    """A row for each signal that a row of ``df`` gives: its ordinal, name, role and weight. No join: signals are expressions."""
    found = [F.when(s.when, F.struct(F.lit(i).alias("signal_ord"), F.lit(s.name).alias("signal"), F.lit(s.role).alias("role"), F.lit(s.weight).alias("weight"))) for i, s in enumerate(signals)]
    return df.withColumn("_s", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull()))).select(*df.columns, "_s.*")


def rank_roles(matched: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the role of the greatest weight, first signal first among equals, and how sure it is.

    Conflicting: the next role has at least 0.8 of its weight. Two aggregates on a
    prefix of one key, so rows are shuffled once, already summed by role.
    """
    by_role = matched.groupBy(*keys, "role").agg(
        F.sum("weight").cast("int").alias("score"), F.min("signal_ord").alias("first"), F.collect_list(F.struct("signal_ord", "signal")).alias("named")
    )
    ranked = by_role.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "first", "role", "named"))).alias("r"))
    top, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    score = -top["minus"]
    conflicting = F.coalesce(-second["minus"] >= F.lit(0.8) * score, F.lit(False))
    confidence = F.when(conflicting, "low").when(score >= 3, "high").when(score >= 2, "medium").otherwise("low")
    signals = F.transform(F.sort_array(top["named"]), lambda x: x["signal"])
    return ranked.select(*keys, top["role"].alias("role"), score.alias("score"), confidence.alias("confidence"), conflicting.alias("conflicting"), signals.alias("signals"))


def classify_files(files: DataFrame, signals: Sequence[Signal], key: str = "path") -> DataFrame:
    """Every file with its role; files without a signal are unclassified."""
    ranked = rank_roles(matched_signals(files, signals).select(key, "signal_ord", "signal", "role", "weight"), [key])
    return files.select(key).join(ranked, key, "left").select(
        key,
        F.coalesce("role", F.lit("unclassified")).alias("role"),
        F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce("confidence", F.lit("none")).alias("confidence"),
        F.coalesce("conflicting", F.lit(False)).alias("conflicting"),
        F.coalesce("signals", F.array().cast("array<string>")).alias("signals"),
    )


def classify_nodes(nodes: DataFrame, file_roles: DataFrame) -> DataFrame:
    """Files as nodes ``file:<path>``, and nodes with the verdict on their file."""
    of_files = file_roles.select(F.concat(F.lit("file:"), "path").alias("node_identity"), F.col("path").alias("file_path"), "role", "confidence", "conflicting", "signals")
    of_nodes = nodes.select("node_identity", "file_path").join(file_roles.withColumnRenamed("path", "file_path").drop("score"), "file_path")
    return of_files.unionByName(of_nodes.select(of_files.columns))


def reconcile(first: DataFrame, second: DataFrame, key: str = "path") -> DataFrame:
    """A second opinion on files that are not sure: agreement keeps the greater confidence, else the second wins with a conflict."""
    asked = second.select(F.col(key), F.col("role").alias("_role"), F.col("confidence").alias("_confidence"))
    both = first.join(asked, key, "left")
    takes = (F.col("confidence") != "high") & F.col("_role").isNotNull()
    agree = takes & (F.col("_role") == F.col("role"))
    greater = F.get(F.array(*map(F.lit, LEVELS)), F.greatest(level(F.col("confidence")), level(F.col("_confidence"))).cast("int") - 1)
    return both.select(
        key,
        F.when(takes, F.col("_role")).otherwise(F.col("role")).alias("role"),
        F.when(agree, greater).when(takes, F.lit("low")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(agree, F.col("conflicting")).when(takes, F.lit(True)).otherwise(F.col("conflicting")).alias("conflicting"),
        F.when(takes, "stage2").otherwise("stage1").alias("source"),
    )


def open_questions(file_roles: DataFrame) -> DataFrame:
    """A question for each file whose role is unsure or in conflict."""
    unsure = file_roles.where(F.col("confidence").isin("low", "none") | F.col("conflicting"))
    node = F.concat(F.lit("file:"), F.col("path"))
    return unsure.select(
        canonical_hash(kind=F.lit("classification"), nodeIdentity=node).alias("key"),
        F.lit("classification").alias("kind"),
        canonical_json(kind=F.lit("classification"), nodeIdentity=node).alias("context"),
        F.when(F.col("role") != "unclassified", F.col("role")).alias("suggestion"),
        F.col("path"),
    )
