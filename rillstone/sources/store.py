"""Tables of runs as Parquet: a run is written whole, then a commit names it, so readers never see half a run."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import codebase_hash
from .commits import CommitLog


class RunStore:
    """Under ``root``: ``runs/<run>/<write>/<table>`` and commits, of which the last counts. Works on any file system of Spark."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/_commits")

    def write(self, run_id: str, tables: dict[str, DataFrame]) -> dict[str, int]:
        """Writes and commits a run; gives the rows of each table, counted while they are written."""
        folder, rows = f"runs/{run_id}/{uuid.uuid4().hex}", {}
        for name, df in tables.items():
            seen = Observation()
            df.observe(seen, F.count("*").alias("rows")).write.parquet(f"{self.root}/{folder}/{name}")
            rows[name] = seen.get["rows"]
        self.log.commit(lambda _, __: {"run": run_id, "folder": folder, "rows": rows})
        return rows

    def _last(self) -> dict | None:
        found = self.log.last()
        return found[1] if found else None

    def current(self) -> str | None:
        found = self._last()
        return found["run"] if found else None

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        """A table of the current run; empty before the first."""
        found = self._last()
        return self.spark.read.schema(schema).parquet(f"{self.root}/{found['folder']}/{name}") if found else self.spark.createDataFrame([], schema)

    def summary(self) -> DataFrame:
        """Rows of each table of the current run, as counted when it was written."""
        found = self._last()
        return self.spark.createDataFrame(sorted(found["rows"].items()) if found else [], "table string, rows long")


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table of a run."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in sorted(tables.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def files_with_hashes(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Scanned files with hash and language of their parse; empty and ``unknown`` where there is none. Size is that of the scan."""
    found = parsed.select("path", F.col("content_hash").alias("_h"), F.col("language").alias("_l"))
    return files.join(found, "path", "left").select("path", "size", F.coalesce("_h", F.lit("")).alias("content_hash"), F.coalesce("_l", F.lit("unknown")).alias("language"))


def visit(spark: SparkSession, codebase_hash: str, op: str, seq: int, at: Column, path: str | None = None, label: str | None = None) -> DataFrame:
    """A row for the log of visits: ``open`` (with its path), ``label`` (a label, or an empty one to take it away) or ``remove``."""
    if op not in ("open", "label", "remove"):
        raise ValueError("op must be open, label or remove")
    return spark.range(1).select(
        F.lit(seq).cast("long").alias("seq"), F.lit(codebase_hash).alias("codebase_hash"), F.lit(path).cast("string").alias("path"), F.lit(label).cast("string").alias("label"),
        F.lit(op).alias("op"), F.when(F.lit(op) == "open", at).alias("at"),
    )


def open_codebase(spark: SparkSession, path: str, seq: int, at: Column) -> DataFrame:
    """The visit of a codebase in a folder, which must exist and be one, on any file system of Spark."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        raise FileNotFoundError(f"no such path: {path}")
    if not system.getFileStatus(where).isDirectory():
        raise NotADirectoryError(f"not a directory: {path}")
    named = spark.range(1).select(codebase_hash(F.lit(path)).alias("h")).first()["h"]
    return visit(spark, named, "open", seq, at, path)


def recent_codebases(visits: DataFrame) -> DataFrame:
    """The last visit of each codebase, latest first. ``op`` remove forgets it and its label; an empty label takes the label away, null keeps it."""
    gone = visits.where(F.col("op") == "remove").groupBy("codebase_hash").agg(F.max("seq").alias("_gone"))
    since = visits.join(gone, "codebase_hash", "left").where(F.col("_gone").isNull() | (F.col("seq") > F.col("_gone")))
    said = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    last = since.groupBy("codebase_hash").agg(said("path").alias("path"), F.nullif(said("label"), F.lit("")).alias("label"), F.max("at").alias("last_opened_at"))
    return last.where(F.col("last_opened_at").isNotNull()).orderBy(F.desc("last_opened_at"), "codebase_hash")


def find_codebase(visits: DataFrame, codebase_hash: str) -> DataFrame:
    return recent_codebases(visits.where(F.col("codebase_hash") == codebase_hash))
