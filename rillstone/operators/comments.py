"""Comments anchored to files, functions and lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def anchor(row: DataFrame) -> Column:
    """The anchor rebuilt from its flat columns: parts that its kind lacks are null."""
    kind = F.col("anchor_kind")
    return F.struct(
        kind.alias("kind"), F.col("file_path").alias("file_path"), F.when(kind != "file", F.col("function_identity")).alias("function_identity"),
        F.when(kind == "line", F.col("line_start")).alias("line_start"), F.when(kind == "line", F.coalesce("line_end", "line_start")).alias("line_end"),
    )


def list_comments(comments: DataFrame, file_path: str | None = None, function_identity: str | None = None, kind: str | None = None, archived: bool = False) -> DataFrame:
    """Comments by any of the given conditions, oldest first."""
    wanted = [("file_path", file_path), ("function_identity", function_identity), ("anchor_kind", kind)]
    conditions = [F.col(c) == v for c, v in wanted if v is not None] + ([] if archived else [F.col("archived_at").isNull()])
    return comments.where(reduce(lambda a, b: a & b, conditions, F.lit(True))).orderBy("created_at", "comment_id")


def line_ranges(comments: DataFrame) -> DataFrame:
    return comments.where(F.col("anchor_kind") == "line").select("comment_id", "file_path", F.col("line_start").alias("start"), F.coalesce("line_end", "line_start").alias("end"))


def add(comments: DataFrame, new: DataFrame) -> DataFrame:
    return comments.unionByName(new.select(*comments.columns))


def edit(comments: DataFrame, changes: DataFrame) -> DataFrame:
    """New bodies (comment_id, body) for comments that are not archived."""
    new = changes.select("comment_id", F.col("body").alias("_body"))
    return comments.join(new, "comment_id", "left").withColumn("body", F.when(F.col("archived_at").isNull(), F.coalesce("_body", "body")).otherwise(F.col("body"))).select(*comments.columns)


def archive(comments: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Archives comments by id; those archived before keep their time."""
    gone = ids.select("comment_id").distinct().withColumn("_gone", F.lit(True))
    return comments.join(gone, "comment_id", "left").withColumn("archived_at", F.when(F.col("_gone"), F.coalesce("archived_at", now)).otherwise(F.col("archived_at"))).select(*comments.columns)


def not_among(rows: DataFrame, column: str, alive: DataFrame, alive_column: str) -> DataFrame:
    """SQL's NOT IN: rows whose value is not alive; null values are neither in nor out and stay behind.

    A filter and an anti-join, which scales where the null-aware join that Spark plans
    for NOT IN needs one side on every executor. Nulls among the alive are left out first.
    """
    known = alive.where(F.col(alive_column).isNotNull()).select(F.col(alive_column).alias(column)).distinct()
    return rows.where(F.col(column).isNotNull()).join(known, column, "left_anti")


def archive_orphans(comments: DataFrame, functions: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """Archives comments whose function, then whose file, is gone; a pass without anything alive is left out."""
    for column, alive, name in (("function_identity", functions, "node_identity"), ("file_path", files, "path")):
        if not alive.isEmpty():
            comments = archive(comments, not_among(comments.where(F.col("archived_at").isNull()), column, alive, name), now)
    return comments
