"""Review states as column expressions, and the choice of the row that counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_stale(current_hash: Column, recorded_hash: Column) -> Column:
    """Both hashes must be known: a null current or an empty recorded hash never makes a review stale."""
    return F.coalesce(current_hash.isNotNull() & (recorded_hash != "") & (recorded_hash != current_hash), F.lit(False))


def runtime_state(status: Column, current_hash: Column, recorded_hash: Column) -> Column:
    """State shown for a node: stale comes before a request for information."""
    return (
        F.when(status.isNull(), "never_reviewed")
        .when(is_stale(current_hash, recorded_hash), "reviewed_stale")
        .when(status == "info_requested", "info_requested")
        .otherwise("reviewed_current")
    )


def runtime_kind(status: Column, current_hash: Column, recorded_hash: Column) -> Column:
    """State counted by progress; a status that is none of the three counts as never reviewed."""
    return (
        F.when(status.isNull(), "never_reviewed")
        .when(is_stale(current_hash, recorded_hash), "reviewed_stale")
        .when(status == "info_requested", "info_requested")
        .when(status == "approved", "reviewed_current_approved")
        .when(status == "rejected", "reviewed_current_rejected")
        .otherwise("never_reviewed")
    )


def choose_review(reviews: DataFrame, keys: list[str], order: str, path_id: Column | None = None) -> DataFrame:
    """One review a key: that of the path, if a path is given, else the global one, else the first in order.

    A least-by aggregate, so each task sends one row a key and no key is sorted.
    """
    rank = F.when(F.col("scope") == "global", 1).otherwise(2)
    if path_id is not None:
        rank = F.when(F.col("scope") == F.concat(F.lit("path:"), path_id), 0).otherwise(rank)
    rest = [c for c in reviews.columns if c not in keys]
    chosen = reviews.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(rank, F.col(order))).alias("_r"))
    return chosen.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def state_counts(kind: Column) -> list[Column]:
    count = lambda value, name: F.count_if(kind == value).alias(name)
    return [
        count("reviewed_current_approved", "approved"),
        count("reviewed_current_rejected", "rejected"),
        count("info_requested", "info_requested"),
        count("reviewed_stale", "stale"),
        count("never_reviewed", "never_reviewed"),
        F.count("*").alias("total"),
    ]


def coverage(df: DataFrame) -> DataFrame:
    """Adds the shares reviewed at all (stale ones included) and approved; 0 for an empty scope."""
    reviewed = F.col("total") - F.col("never_reviewed")
    share = lambda n: F.coalesce(F.try_divide(n.cast("double"), F.col("total")), F.lit(0.0))
    return df.withColumn("coverage_path", share(reviewed)).withColumn("coverage_full", share(F.col("approved")))
