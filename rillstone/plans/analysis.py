"""The analysis of a codebase from its files to its tables. Tables used by several others are written once on the way."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import browse, classify, paths, renames, resolve, rules
from .adapters import JAVASCRIPT, Framework, Language

ORDER = ["file_ord", "edge_seq"]
#: A table, or how to make it from the one that it judges.
Given = DataFrame | Callable[[DataFrame], DataFrame] | None


def _given(table: Given, judged: Callable[[], DataFrame]) -> DataFrame | None:
    return table(judged()) if callable(table) else table


def one_of_each(nodes: DataFrame) -> DataFrame:
    """The first of nodes that share an identity, in source order."""
    rest = [c for c in nodes.columns if c != "node_identity"]
    first = nodes.groupBy("node_identity").agg(F.min_by(F.struct(*rest), F.struct("file_ord", "node_ord")).alias("_n"))
    return first.select("node_identity", *[F.col(f"_n.{c}").alias(c) for c in rest])


class Analysis:
    """The tables of a codebase. Each is made when it is first asked for, once for this object; those that others need are written then.

    ``prior``: nodes of the run before, for renames. ``second_opinion`` (path, role, confidence), ``categories``
    (path_id, category, category_order): results of a language model, if there are any. ``answers``: choices at branches
    (entry, caller, choice). Each of these may also be a function of the table that it judges, called when that is known:
    roles of files, paths with their nodes in order, branches (key, context, entry, caller, candidates) that the walks
    meet, those that answers lead to in further rounds.
    """

    TABLES = ("files", "nodes", "imports", "exports", "call_edges", "classifications", "entry_points", "paths", "path_nodes", "rule_results", "prep_questions")

    def __init__(
        self,
        files: DataFrame,
        project: str,
        prior: DataFrame | None = None,
        second_opinion: Given = None,
        answers: Given = None,
        categories: Given = None,
        language: Language = JAVASCRIPT,
    ) -> None:
        self._source, self._language, self._parsed = files, language, language.parse(files, project)
        self._prior, self._second_opinion, self._answers, self._categories = prior, second_opinion, answers, categories

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.TABLES}

    @property
    def files(self) -> DataFrame:
        return self._parsed.files

    @property
    def imports(self) -> DataFrame:
        return self._parsed.imports

    @property
    def exports(self) -> DataFrame:
        return self._parsed.exports

    @cached_property
    def _frameworks(self) -> Sequence[Framework]:
        return self._language.used(self.imports)

    @cached_property
    def nodes(self) -> DataFrame:
        return cut(one_of_each(self._parsed.nodes))

    @cached_property
    def roles(self) -> DataFrame:
        """A row for each file."""
        modules = self.imports.groupBy(F.col("file_path").alias("path")).agg(F.collect_set("module").alias("modules"))
        signals = [*self._language.signals(), *(s for f in self._frameworks for s in f.signals())]
        roles = classify.classify_files(self._source.select("path").join(modules, "path", "left"), signals)
        opinion = _given(self._second_opinion, lambda: roles)
        if opinion is not None:
            # only files with content are asked about
            asked = opinion.join(self._source.where(F.coalesce("content", F.lit("")) != "").select("path"), "path", "left_semi")
            roles = classify.reconcile(roles, asked).drop("source").withColumn("signals", F.array().cast("array<string>")).withColumn("score", F.lit(0))
        return cut(roles)

    @property
    def classifications(self) -> DataFrame:
        return classify.classify_nodes(self.nodes, self.roles)

    @cached_property
    def call_edges(self) -> DataFrame:
        return cut(resolve.resolve_calls(self._parsed.call_edges, self.imports, self.exports, self._source))

    @cached_property
    def entry_points(self) -> DataFrame:
        found = [f.entry_points(self._parsed.call_edges, self.imports) for f in self._frameworks]
        return reduce(DataFrame.unionByName, found) if found else paths.entry_points(self._parsed.call_edges.limit(0), self.imports)

    @cached_property
    def _callees(self) -> DataFrame:
        return cut(paths.callees_in_order(self.call_edges, self.nodes, ORDER))

    @cached_property
    def _walked(self) -> DataFrame:
        if not callable(self._answers):
            return cut(paths.walk(self.entry_points, self._callees, self._answers))
        # an answer can lead to further branches: at most as many rounds as a path has nodes
        walked, answers, asked = cut(paths.walk(self.entry_points, self._callees)), None, None
        for _ in range(paths.DEPTH):
            branches = paths.branch_questions(walked)
            new = cut(branches if asked is None else branches.join(asked, "key", "left_anti"))
            if new.isEmpty():
                break
            said, keys = cut(self._answers(new)), new.select("key")
            answers, asked = (said, keys) if asked is None else (answers.unionByName(said), asked.unionByName(keys))
            walked = cut(paths.walk(self.entry_points, self._callees, answers))
        return walked

    @property
    def paths(self) -> DataFrame:
        found = paths.paths_of(self._walked)
        given = _given(self._categories, lambda: browse.paths_with_nodes(found, self.path_nodes))
        return paths.with_categories(found, given) if given is not None else found

    @property
    def path_nodes(self) -> DataFrame:
        return paths.path_nodes_of(self._walked)

    @property
    def rule_results(self) -> DataFrame:
        return rules.evaluate_rules(self.nodes, self.classifications, self.call_edges, ORDER)

    @property
    def prep_questions(self) -> DataFrame:
        found = classify.open_questions(self.roles).select("key", "kind", "context", "suggestion")
        branches = paths.branch_questions(self._walked).dropDuplicates(["key"])
        found = found.unionByName(branches.select("key", "kind", "context", F.lit(None).cast("string").alias("suggestion")))
        if self._prior is not None:
            found = found.unionByName(renames.rename_questions(renames.rename_candidates(self._prior, self.nodes)))
        return found


def analyse(files: DataFrame, project: str, **given) -> Analysis:
    """The analysis of files (file_ord, path, content); ``given`` as ``Analysis`` has it."""
    return Analysis(files, project, **given)
