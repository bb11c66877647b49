"""An analysis that goes on from the one before: only what changed is parsed, resolved and walked anew.

A file whose content hash is that of the run before keeps the rows that it was parsed to. Calls are resolved again only
where they could mean something else: in changed files, and in files that import from changed, new or gone ones. Walks
are gone again only from entries that are new or whose path crosses a function whose known callees are others than before.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import paths, resolve
from .analysis import ORDER, Analysis


class Continued:
    """The tables of ``parse`` for files, taken from an earlier parse where the content is the same."""

    def __init__(self, before, files: DataFrame, project: str, parse) -> None:
        self._before, self._source = before, files
        hashed = files.select("path", F.sha2("content", 256).alias("content_hash"))
        same = hashed.join(before.files.select("path", "content_hash"), ["path", "content_hash"], "left_semi").select("path")
        #: Files that stay as they are, with their present places, and those to parse.
        self.same = cut(files.select("path", "file_ord").join(same, "path", "left_semi"))
        self.changed = cut(files.join(self.same.select("path"), "path", "left_anti"))
        self.gone = before.files.select("path").join(files.select("path"), "path", "left_anti")
        self.fresh = parse(self.changed, project)

    @property
    def files(self) -> DataFrame:
        kept = self._before.files.join(self.same.select("path"), "path", "left_semi")
        return kept.unionByName(self.fresh.files)

    def _both(self, name: str) -> DataFrame:
        before, fresh = getattr(self._before, name), getattr(self.fresh, name)
        kept = before.join(self.same.select(F.col("path").alias("file_path"), F.col("file_ord").alias("_ord")), "file_path")
        kept = kept.withColumn("file_ord", F.col("_ord")) if "file_ord" in before.columns else kept
        return cut(kept.select(fresh.columns).unionByName(fresh))

    @cached_property
    def nodes(self) -> DataFrame:
        return self._both("nodes")

    @cached_property
    def imports(self) -> DataFrame:
        return self._both("imports")

    @cached_property
    def exports(self) -> DataFrame:
        return self._both("exports")

    @cached_property
    def call_edges(self) -> DataFrame:
        return self._both("call_edges")


class IncrementalAnalysis(Analysis):
    """As ``Analysis``, going on from ``before``, an analysis of an earlier state of the project with the same language."""

    def __init__(self, files: DataFrame, project: str, before: Analysis, **given) -> None:
        if given.get("answers") is not None or before._answers is not None:
            raise ValueError("walks with answers are those of a whole analysis")
        super().__init__(files, project, **given)
        self._was = before
        self._parsed = Continued(before._parsed, files, project, self._language.parse)

    @cached_property
    def stale_files(self) -> DataFrame:
        """Paths of files whose calls are resolved anew: changed ones, and those whose imports mean other files than before or changed ones."""
        parsed = self._parsed
        moved = parsed.changed.select("path").unionByName(parsed.gone)
        means = lambda imports, files: resolve.resolve_modules(imports.select("file_path", "module").distinct(), files.select("path")).select("file_path", "module", "source_path")
        now, then = cut(means(self.imports, self._source)), means(self._was.imports, self._was.files)
        other = now.exceptAll(then).select("file_path")
        crossing = now.join(moved.select(F.col("path").alias("source_path")), "source_path", "left_semi").select("file_path")
        return cut(parsed.changed.select(F.col("path").alias("file_path")).unionByName(other).unionByName(crossing).distinct())

    @cached_property
    def call_edges(self) -> DataFrame:
        raw = self._parsed.call_edges
        again = resolve.resolve_calls(raw.join(self.stale_files, "file_path", "left_semi"), self.imports, self.exports, self._source)
        still = self._parsed.same.select(F.col("path").alias("file_path"), F.col("file_ord").alias("_ord")).join(self.stale_files, "file_path", "left_anti")
        kept = self._was.call_edges.join(still, "file_path").withColumn("file_ord", F.col("_ord"))
        return cut(kept.select(again.columns).unionByName(again))

    @cached_property
    def _callees(self) -> DataFrame:
        return cut(paths.callees_in_order(self.call_edges, self.nodes, ORDER))

    @cached_property
    def rewalked(self) -> DataFrame:
        """Entries whose paths are walked anew: those without an earlier walk, and those whose walk crosses a function with other callees than before."""
        other = self._callees.exceptAll(self._was._callees).select("caller").unionByName(self._was._callees.exceptAll(self._callees).select("caller")).distinct()
        crossed = self._was._walked.select("entry", F.explode("nodes").alias("caller")).join(other, "caller", "left_semi").select("entry").distinct()
        known = self._was._walked.select("entry").join(crossed, "entry", "left_anti")
        return cut(self.entry_points.select("node_identity").distinct().join(known.select(F.col("entry").alias("node_identity")), "node_identity", "left_anti"))

    @cached_property
    def _walked(self) -> DataFrame:
        again = paths.walk(self.rewalked, self._callees)
        asked = self.entry_points.select(F.col("node_identity").alias("entry")).distinct().join(self.rewalked.select(F.col("node_identity").alias("entry")), "entry", "left_anti")
        return cut(self._was._walked.join(asked, "entry", "left_semi").select(again.columns).unionByName(again))
