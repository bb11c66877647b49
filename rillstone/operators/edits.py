"""Shortest edit scripts between two sequences, and what they carry along: positions of paths, lines of files, comments on lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import ship

#: Lines in a bin of the join of comments with runs of lines.
BIN = 64


def _middle(a: list, b: list) -> tuple[int, int, int, int, int]:
    """Where a shortest script is half done: the run of equal items there (from x, y to u, v) and the length of the whole script."""
    n, m = len(a), len(b)
    gap, ways = n - m, ({1: 0}, {1: 0})
    for d in range((n + m + 1) // 2 + 1):
        for back in (0, 1):
            own, other = ways[back], ways[1 - back]
            # diagonals outside of the two sequences are left out
            for k in range(-(d - 2 * max(0, d - m)), d - 2 * max(0, d - n) + 1, 2):
                down = k == -d or (k != d and own.get(k - 1, -1) < own.get(k + 1, -1))
                x = own.get(k + 1, 0) if down else own[k - 1] + 1
                y = x - k
                s, t = x, y
                while x < n and y < m and (a[n - 1 - x] == b[m - 1 - y] if back else a[x] == b[y]):
                    x, y = x + 1, y + 1
                own[k] = x
                if gap % 2 == 1 - back and abs(gap - k) <= d - 1 + back and x + other.get(gap - k, -n - m) >= n:
                    return (n - x, m - y, n - s, m - t, 2 * d) if back else (s, t, x, y, 2 * d - 1)
    raise AssertionError("a script always exists")


def kept_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Positions in ``a`` and ``b`` of a longest common subsequence, by Myers's algorithm in linear space: time grows with length times changes."""
    there = set(a) & set(b)  # what one side lacks can't be kept
    at_a, at_b = [i for i, x in enumerate(a) if x in there], [j for j, y in enumerate(b) if y in there]
    a, b, found = [a[i] for i in at_a], [b[j] for j in at_b], []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            found.append((at_a[i], at_b[j]))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            found.append((at_a[n], at_b[m]))
        if i == n or j == m:
            continue
        x, y, u, v, _ = _middle(a[i:n], b[j:m])
        found += [(at_a[i + x + k], at_b[j + y + k]) for k in range(u - x)]
        todo += [(i, i + x, j, j + y), (i + u, n, j + v, m)]
    return sorted(found)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])))
def _kept(a: pd.Series, b: pd.Series) -> pd.Series:
    listed = lambda x: [] if x is None else list(x)
    return pd.Series([[{"a": i, "b": j} for i, j in kept_pairs(listed(x), listed(y))] for x, y in zip(a, b, strict=True)], dtype=object)


def sequence_edits(df: DataFrame, base: str, head: str) -> DataFrame:
    """Adds ``kept`` (pairs of positions a, b from 0), ``removed`` (positions in ``base``) and ``added`` (in ``head``) of two arrays of texts; null counts as empty."""
    ship(df.sparkSession)
    rest = lambda c, side: F.array_except(
        F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda _, i: i), F.transform("kept", lambda p: p[side])
    )
    found = df.withColumn("kept", _kept(F.col(base), F.col(head)))
    return found.withColumns({"removed": rest(F.col(base), "a"), "added": rest(F.col(head), "b")})


def line_runs(base: DataFrame, head: DataFrame) -> DataFrame:
    """Runs of lines that files (path, content) of both sides have in common: path, first and last line in base, counted from 1, and by how much they move."""
    lines = lambda df, name: df.select("path", F.split("content", "\n").alias(name))
    both = sequence_edits(lines(base, "old").join(lines(head, "new"), "path"), "old", "new")
    # lines of a run that move alike and follow each other have one difference to their place in the order
    runs = both.select("path", F.explode(F.transform("kept", lambda p, i: F.struct(p["a"].alias("a"), (p["b"] - p["a"]).alias("shift"), (p["a"] - i).alias("gap")))).alias("p"))
    return runs.groupBy("path", "p.shift", "p.gap").agg((F.min("p.a") + 1).alias("from_line"), (F.max("p.a") + 1).alias("to_line")).select("path", "from_line", "to_line", "shift")


def overlapping(left: DataFrame, right: DataFrame, low: tuple[Column, Column], high: tuple[Column, Column], on: str = "path", size: int = BIN) -> DataFrame:
    """Pairs of rows of one ``on`` whose ranges overlap, each once: both are cut into bins, which are joined by equality.

    ``low``, ``high``: first and last place of the ranges of the left and the right side. A pair counts in the bin where its overlap begins.
    """
    cut_up = lambda df, i: df.withColumn("_bin", F.explode(F.sequence(F.floor(low[i] / size), F.floor(high[i] / size)))).where(low[i] <= high[i])
    met = cut_up(left, 0).join(cut_up(right, 1), [on, "_bin"])
    return met.where((low[0] <= high[1]) & (low[1] <= high[0]) & (F.floor(F.greatest(low[0], low[1]) / size) == F.col("_bin"))).drop("_bin")


def moved_comments(comments: DataFrame, runs: DataFrame, edited: DataFrame) -> DataFrame:
    """Comments on lines (comment_id, file_path, line_start, line_end) with ``new_start`` and ``new_end``: from the first to the last of their lines that is still there.

    Both are null where no line is left; in files that were not ``edited`` (path) nothing moves.
    """
    ranged = comments.withColumnRenamed("file_path", "path")
    met = overlapping(ranged.select("comment_id", "path", "line_start", "line_end"), runs, (F.col("line_start"), F.col("from_line")), (F.col("line_end"), F.col("to_line")))
    ends = met.groupBy("comment_id").agg(
        F.min(F.greatest("line_start", "from_line") + F.col("shift")).alias("_start"), F.max(F.least("line_end", "to_line") + F.col("shift")).alias("_end")
    )
    marked = ranged.join(edited.select("path", F.lit(True).alias("_edited")).distinct(), "path", "left").join(ends, "comment_id", "left")
    place = lambda c, new: F.when(F.col("_edited"), F.col(new)).otherwise(F.col(c))
    return marked.withColumns({"new_start": place("line_start", "_start"), "new_end": place("line_end", "_end")}).drop("_edited", "_start", "_end").withColumnRenamed("path", "file_path")
