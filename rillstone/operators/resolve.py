"""Calls across files: imported names resolved to the functions that other files export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import ENDINGS, joined_path, parent_dir, symbol_of


def candidates(module: Column, from_path: Column) -> Column:
    """Where a relative module can lie: struct (priority, path) in an array; empty for a package."""
    base = joined_path(parent_dir(from_path), module)
    exact = [base]
    with_ending = [F.concat(base, F.lit(e)) for e in ENDINGS]
    index = [F.concat(base, F.lit(f"/index{e}")) for e in ENDINGS]
    swapped = [F.when(base.endswith(".ts"), F.concat(base, F.lit("x"))).when(base.endswith(".tsx"), F.substr(base, F.lit(1), F.length(base) - 1))]
    tries = [F.struct(F.lit(i).alias("priority"), c.alias("path")) for i, c in enumerate(exact + with_ending + index + swapped)]
    return F.when(module.startswith("."), F.filter(F.array(*tries), lambda t: t["path"].isNotNull()))


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``source_path``, the file that each import means, or null: an equi-join on candidates, least priority first."""
    distinct = imports.select("file_path", "module").distinct()
    tried = distinct.withColumn("_c", F.explode(candidates(F.col("module"), F.col("file_path")))).select("file_path", "module", "_c.priority", "_c.path")
    found = tried.join(files.select("path"), "path").groupBy("file_path", "module").agg(F.min_by("path", "priority").alias("source_path"))
    return imports.join(found, ["file_path", "module"], "left")


def last_by(df: DataFrame, keys: list[str], order: list[str], *values: str) -> DataFrame:
    """The values of the last row of each key, as a map filled row by row would keep them."""
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v"))
    return picked.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def resolve_calls(edges: DataFrame, imports: DataFrame, exports: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with callees in other files filled in.

    Only unresolved edges with the hint ``cross-file-or-external`` are looked up, by
    the name their callee ends in, among the imports of their file and then the
    exports of the file imported from. Default and whole-module imports never
    resolve. Of imports or exports of one name the last counts.
    """
    named = resolve_modules(imports.where(~F.col("specifier").isin("*", "default")), files).where(F.col("source_path").isNotNull())
    named = last_by(named, ["file_path", "specifier"], ["import_ord"], "source_path")
    exported = last_by(exports.where(F.col("node_identity").isNotNull()), ["file_path", "name"], ["export_ord"], "node_identity")
    target = named.join(
        exported.select(F.col("file_path").alias("source_path"), F.col("name").alias("specifier"), "node_identity"), ["source_path", "specifier"]
    ).select("file_path", F.col("specifier").alias("_name"), F.col("node_identity").alias("_target"))
    open_ = F.col("unresolved") & (F.col("hint") == "cross-file-or-external") & F.col("callee").isNotNull()
    joined = edges.withColumn("_name", F.when(open_, symbol_of(F.col("callee")))).join(target, ["file_path", "_name"], "left")
    return joined.select(
        *[c for c in edges.columns if c not in ("callee", "unresolved", "hint")],
        F.coalesce("_target", "callee").alias("callee"),
        (F.col("unresolved") & F.col("_target").isNull()).alias("unresolved"),
        F.when(F.col("_target").isNull(), F.col("hint")).alias("hint"),
    )
