"""Questions to the reviewer, their answers, and what an answer changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import canonical_hash, parsed_response
from .review import clear, latest


def with_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    return questions.join(answers.withColumnRenamed("question_key", "key"), "key", "left")


def unanswered(questions: DataFrame, answers: DataFrame) -> DataFrame:
    return questions.join(answers.select(F.col("question_key").alias("key")), "key", "left_anti")


def open_count(questions: DataFrame, answers: DataFrame) -> DataFrame:
    return unanswered(questions, answers).groupBy("kind").agg(F.count("*").alias("open"))


def for_path(questions: DataFrame, path_id: str) -> DataFrame:
    return questions.where(F.get_json_object("context", "$.pathId") == path_id)


def answer_kind_fits(questions: DataFrame, given: DataFrame) -> DataFrame:
    """Given answers (question_key, answer) whose kind is that of their question."""
    kinds = questions.select(F.col("key").alias("question_key"), F.col("kind").alias("_kind"))
    return given.join(kinds, "question_key").where(F.get_json_object("answer", "$.kind") == F.col("_kind")).drop("_kind")


def upsert_answers(answers: DataFrame, given: DataFrame) -> DataFrame:
    """One answer a question: the last given."""
    both = answers.select("question_key", "answer", "answered_at").unionByName(given.select("question_key", "answer", "answered_at"))
    return latest(both, ["question_key"], ["answered_at", "answer"])


def branch_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Choices at branches for ``paths.walk``: entry, caller, choice."""
    chosen = answers.where(F.get_json_object("answer", "$.kind") == "path_branch").select(F.col("question_key").alias("key"), F.get_json_object("answer", "$.choice").alias("choice"))
    return questions.join(chosen, "key").select("entry", "caller", "choice")


def apply_class_answers(roles: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Roles of files as answered; nodes keep theirs, and the next analysis starts anew."""
    said = with_answers(questions.where(F.col("kind") == "classification"), answers).where(F.col("answer").isNotNull()).select(
        F.get_json_object("context", "$.nodeIdentity").alias("node_identity"), F.get_json_object("answer", "$.classification").alias("_said")
    )
    said = said.where(F.col("node_identity").startswith("file:"))
    return roles.join(said, "node_identity", "left").select(
        "node_identity",
        *[
            {"role": F.coalesce("_said", "role"), "confidence": F.when(F.col("_said").isNotNull(), "high").otherwise(F.col("confidence")), "conflicting": F.col("conflicting") & F.col("_said").isNull()}.get(c, F.col(c)).alias(c)
            for c in roles.columns if c != "node_identity"
        ],
    )


def carry_renames(rows: DataFrame, renames: DataFrame, column: str) -> DataFrame:
    """Identities rewritten by a map (old_identity, new_identity), archived rows too."""
    new = renames.select(F.col("old_identity").alias(column), F.col("new_identity").alias("_new")).dropDuplicates([column])
    return rows.join(new, column, "left").withColumn(column, F.coalesce("_new", column)).select(*rows.columns)


def rename_decisions(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """What was answered to questions about renames: old_identity, new_identity, decision (carry_forward or treat_as_new)."""
    said = with_answers(questions.where(F.col("kind") == "rename"), answers).where(F.get_json_object("answer", "$.kind") == "rename")
    return said.select(F.get_json_object("context", "$.oldIdentity").alias("old_identity"), F.get_json_object("context", "$.newIdentity").alias("new_identity"), F.get_json_object("answer", "$.decision").alias("decision"))


def archived_as_new(current: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Events that archive the reviews of functions whose successor is to be treated as new: it starts without any."""
    old = decisions.where(F.col("decision") == "treat_as_new").select(F.col("old_identity").alias("node_identity")).distinct()
    return clear(current.join(old, "node_identity", "left_semi"), now, "rename_treat_as_new")


def carried(rows: DataFrame, decisions: DataFrame, column: str) -> DataFrame:
    """Rows under the new identity where a rename is carried forward."""
    return carry_renames(rows, decisions.where(F.col("decision") == "carry_forward"), column)


def needs_analysis(given: DataFrame) -> DataFrame:
    """Given answers with ``requires_reanalysis``: a choice at a branch changes paths, which only an analysis can walk anew."""
    return given.withColumn("requires_reanalysis", F.coalesce(F.get_json_object("answer", "$.kind") == "path_branch", F.lit(False)))


def open_totals(questions: DataFrame, answers: DataFrame, project_rules: DataFrame) -> DataFrame:
    """One row: questions still open, and project rules that are enabled."""
    counted = unanswered(questions, answers).select(F.lit(1).alias("q"), F.lit(0).alias("r")).unionByName(project_rules.where("enabled").select(F.lit(0).alias("q"), F.lit(1).alias("r")))
    return counted.agg(F.coalesce(F.sum("q"), F.lit(0)).alias("open_questions"), F.coalesce(F.sum("r"), F.lit(0)).alias("enabled_rules"))


def in_order(questions: DataFrame, order: str = "seq") -> DataFrame:
    """Questions by time of creation, then as they were written."""
    return questions.orderBy("created_at", order)


def request_hash(pipeline: Column, prompt_name: Column, prompt_version: Column, model: Column, request: Column) -> Column:
    """The key of a request in the store of results: all that its answer depends on."""
    return canonical_hash(pipeline=pipeline, promptName=prompt_name, promptVersion=prompt_version, model=model, input=request)


def memo(requests: DataFrame, cached: DataFrame, version: Column, schema: str | None = None, required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Requests found in a store of earlier results by input hash and prompt version, and those that are not.

    With ``schema`` a stored response counts only if it can still be read by it.
    """
    readable = cached if schema is None else cached.where(parsed_response(F.col("response"), schema, required or []).isNotNull())
    found = readable.where(F.col("prompt_version") == version).select("input_hash", "response")
    return requests.join(found, "input_hash"), requests.join(found, "input_hash", "left_anti")


def touched(cached: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """The store with the time of the last use of results that were found."""
    used = found.select("input_hash").distinct().withColumn("_used", F.lit(True))
    return cached.join(used, "input_hash", "left").withColumn("last_used_at", F.when(F.col("_used"), now).otherwise(F.col("last_used_at"))).select(*cached.columns)


def upsert_memo(cached: DataFrame, new: DataFrame) -> DataFrame:
    """The last result of each input; the first time of writing is kept."""
    both = cached.unionByName(new.select(*cached.columns))
    first = both.groupBy("input_hash").agg(F.min("created_at").alias("created_at"))
    return latest(both.drop("created_at"), ["input_hash"], ["last_used_at"]).join(first, "input_hash").select(*cached.columns)
