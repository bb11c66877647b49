"""Connected components of a table of links, by rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Links for each task of a round: a few megabytes. Where one task holds them all, a round needs no shuffle.
LINKS = 200_000


def _each(df: DataFrame, *ends: tuple[Column, Column]) -> DataFrame:
    """Rows (a, b) for each pair of columns, without a union, which would part what lies together."""
    return df.select(F.explode(F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in ends])).alias("x")).select("x.a", "x.b")


def _star(edges: DataFrame, large: bool, together: bool) -> DataFrame:
    """Links every node's greater (large star) or lesser (small star) neighbours to the least of its neighbourhood.

    ``together``: the links are so few that one task holds them all, and a window shuffles nothing. Else least neighbours
    are pre-aggregated, so a node with very many links is no one task's work.
    """
    a, b = F.col("a"), F.col("b")
    both = _each(edges, (a, b), (b, a)) if large else edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    if together:
        joined = both.withColumn("low", F.least("a", F.min("b").over(W.partitionBy("a"))))
    else:
        joined = both.join(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "a")
    low = F.col("low")
    out = joined.where(b > a).select(b.alias("a"), low.alias("b")) if large else _each(joined, (b, low), (a, low))
    return out.where(a != b)


def components(links: DataFrame) -> DataFrame:
    """Columns node and root (the least node of its component) for every node of links (a, b)."""
    edges = cut(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while before[0]:
        tasks = -(-before[0] // LINKS)
        # a large star puts out no more links than it got, so repeats wait for the small one
        edges = cut(_star(_star(edges.coalesce(tasks), True, tasks == 1), False, tasks == 1).distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    a, b = F.col("a"), F.col("b")
    edges = edges.coalesce(max(1, -(-before[0] // LINKS)))
    return _each(edges, (a, b), (b, b)).groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
