"""Source files as tables: from folders, from given rows, and from a Git repository at a revision."""

from __future__ import annotations

import io
import subprocess
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
)

from ..functions.lineage import running
from ..schemas import FILES

#: Endings for a scan of a folder (any case) and of a revision, the largest file, and folders that a walk leaves out.
FOLDER_ENDINGS = r"(?i)\.[cm]?[jt]sx?$"
REVISION_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".cts", ".mts")
LARGEST = 512 * 1024
SKIPPED = ("node_modules", ".git", "dist", "build", ".next", ".turbo", "coverage", ".cache", "out")


def numbered(files: DataFrame) -> DataFrame:
    """Files in the order of their paths: ``file_ord`` is the order key of all that is parsed from them.

    Paths are numbered by ranges, so no task holds them all. Contents are shuffled once and dealt to all cores, however few
    bytes they are, as what is done with them takes long; they are neither sorted nor broadcast.
    """
    order = running(files.select("path").distinct(), [F.col("path")], {"file_ord": F.lit(1)})
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return files.repartition(tasks, "path").join(order.withColumn("file_ord", F.col("file_ord").cast("int")).hint("shuffle_hash"), "path")


def read_folder(spark: SparkSession, root: str, walk: bool = True) -> DataFrame:
    """Columns path (under the root), content, size. Size and name are filtered before contents are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    top = F.lit(root.rstrip("/") + "/")
    path = F.substr(F.col("path"), F.instr(F.col("path"), root.rstrip("/") + "/") + F.length(top))
    rows = raw.where(F.col("length") <= LARGEST).withColumn("path", path).where(F.col("path").rlike(FOLDER_ENDINGS))
    if walk:
        rows = rows.where(~F.col("path").rlike("(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"))
    return rows.select("path", F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"))


def given_files(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    made = [(i, path, content, len(content.encode())) for i, (path, content) in enumerate(rows)]
    return spark.createDataFrame(made, FILES)


def in_revision(path: Column) -> Column:
    """Is this path of a revision source code, and not installed or built?"""
    named = F.lit(False)
    for ending in REVISION_ENDINGS:
        named = named | path.endswith(ending)
    return named & ~path.rlike("(^|/)(node_modules|dist)/")


def name_status(lines: DataFrame, column: str = "line") -> DataFrame:
    """Rows of a name-status listing: status letter, old path (renames and copies) and path."""
    parts = F.split(column, "\t")
    moved = F.col(column).rlike("^[RC]")
    return lines.select(
        F.substring(column, 1, 1).alias("status"), F.when(moved, F.get(parts, F.lit(1))).alias("old_path"),
        F.when(moved, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("path"),
    )


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout


def _of_revision(repo: str, ref: str, paths: list[str]) -> Iterator[tuple]:
    """Path and content of files of a revision, by one process; null where the revision has no such file."""
    asked = "".join(f"{ref}:{p}\n" for p in paths if "\n" not in p).encode()
    found = io.BytesIO(subprocess.run(["git", "-C", repo, "cat-file", "--batch"], input=asked, check=True, capture_output=True).stdout)
    for path in paths:
        if "\n" in path:  # a batch can't ask for it
            yield path, _git(repo, "show", f"{ref}:{path}").decode("utf-8", "replace")
            continue
        head = found.readline().rstrip(b"\n").rsplit(b" ", 2)
        if len(head) == 3 and head[1] == b"blob":
            yield path, found.read(int(head[2])).decode("utf-8", "replace")
            found.read(1)
        else:
            if len(head) == 3:  # something other than a file, such as a submodule's commit
                found.read(int(head[2]) + 1)
            yield path, None


class GitSource(DataSource):
    """``spark.read.format("git_files")``: options path, ref (a revision; without it, tracked files as they stand in the work tree),
    endings (of paths, with commas between) and batch.

    Sizes come from the listing, so what filters on path and size leave out is never read, nor is any content if none is asked for.
    """

    @classmethod
    def name(cls) -> str:
        return "git_files"

    def schema(self) -> str:
        return "path string, size long, content string"

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(self.options)


class _Batch(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


#: Filters of Spark that the listing answers, by class: what they say of a value.
_ANSWERED = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
    LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, IsNotNull: lambda x, v: True,
}


class _GitReader(DataSourceReader):
    def __init__(self, options):
        self.repo, self.ref, self.batch = options["path"], options.get("ref"), int(options.get("batch", "64"))
        self.endings = tuple(e for e in options.get("endings", "").split(",") if e)
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _ANSWERED and f.attribute in (("path",), ("size",)):
                self.wanted.append(f)
            else:
                yield f

    def listed(self) -> Iterator[tuple[str, int]]:
        """Paths and sizes that the filters leave."""
        if self.ref:
            for line in _git(self.repo, "ls-tree", "-r", "-l", "-z", self.ref).split(b"\0"):
                head, _, path = line.partition(b"\t")
                if path and head.split()[1] == b"blob":
                    yield path.decode(), int(head.split()[3])
            return
        for path in _git(self.repo, "ls-files", "-z").split(b"\0"):
            try:
                if path:
                    yield path.decode(), Path(self.repo, path.decode()).stat().st_size
            except OSError:  # tracked, but no longer in the work tree
                pass

    def partitions(self) -> list[_Batch]:
        said = lambda f, file: _ANSWERED[type(f)](file[0] if f.attribute == ("path",) else file[1], getattr(f, "value", None))
        files = [f for f in self.listed() if (not self.endings or f[0].endswith(self.endings)) and all(said(w, f) for w in self.wanted)]
        return [_Batch(files[i : i + self.batch]) for i in range(0, len(files), self.batch)] or [_Batch([])]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        sizes = dict(partition.files)
        if self.ref:
            for path, content in _of_revision(self.repo, self.ref, list(sizes)):
                yield path, sizes[path], content
            return
        for path, size in sizes.items():
            try:
                yield path, size, Path(self.repo, path).read_bytes().decode("utf-8", "replace")
            except OSError:
                yield path, size, None


def read_git(spark: SparkSession, repo: str, ref: str | None = None, largest: int | None = None) -> DataFrame:
    """Source files of a revision, or tracked ones of the work tree, of at most ``largest`` bytes: path, size, content.

    Session settings let Spark push filters into Python sources; the size is such a filter, the endings are an option.
    """
    spark.dataSource.register(GitSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("git_files").option("path", repo).option("endings", ",".join(REVISION_ENDINGS))
    rows = (reader.option("ref", ref) if ref else reader).load()
    rows = rows.where(F.col("size") <= largest) if largest is not None else rows
    return rows.where(in_revision(F.col("path")) & F.col("content").isNotNull()).select("path", "content", "size")


def changed_files(spark: SparkSession, repo: str, base: str, head: str) -> DataFrame:
    """Files that differ between two revisions: status letter, old path (renames and copies) and path."""
    lines = _git(repo, "-c", "core.quotePath=false", "diff", "--name-status", "-M", base, head).decode("utf-8", "replace").splitlines()
    return name_status(spark.createDataFrame([(line,) for line in lines], "line string"))


def revision(repo: str, ref: str) -> str | None:
    """The commit that a name means, or null."""
    try:
        return _git(repo, "rev-parse", "--verify", f"{ref}^{{commit}}").decode().strip()
    except (subprocess.CalledProcessError, OSError):
        return None


def is_repository(path: str) -> bool:
    try:
        return _git(path, "rev-parse", "--is-inside-work-tree").strip() == b"true"
    except (subprocess.CalledProcessError, OSError):
        return False


def collect_files(spark: SparkSession, root: str) -> DataFrame:
    """Source files of a folder, numbered: those that git tracks if it is a repository, else those that a walk finds."""
    if is_repository(root):
        tracked = read_git(spark, root, largest=LARGEST)
        found = tracked.where(F.col("path").rlike(FOLDER_ENDINGS)).select("path", "content", "size")
    else:
        found = read_folder(spark, root)
    return numbered(found)
