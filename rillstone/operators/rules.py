"""Built-in rules on classified nodes, from one summary of each caller's calls; and rules run as shell commands."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import last_segment

#: Names of calls that check rights, check input, or assert.
AUTH = "(?i)^(authenticate|authorize|requireAuth|isAuthenticated|verifyAuth)"
VALIDATION = "(?i)^(validate|parse|check|sanitize|coerce|schema)"
ASSERTION = "(?i)^(expect|assert|t)$"
MOST_CALLEES, MOST_CALLS = 8, 4


def call_summary(edges: DataFrame, order: list[str]) -> DataFrame:
    """What the rules need of a caller's calls, in one aggregate: n_calls, n_callees, first_auth, validates, asserts."""
    name = last_segment(F.coalesce("callee", F.lit("")))
    resolved = F.when(~F.col("unresolved") & F.col("callee").isNotNull(), F.col("callee"))
    return edges.groupBy("caller").agg(
        F.count("*").alias("n_calls"),
        F.count_distinct(resolved).alias("n_callees"),
        F.min_by(F.when(name.rlike(AUTH), name), F.when(name.rlike(AUTH), F.struct(*order))).alias("first_auth"),
        F.bool_or(name.rlike(VALIDATION)).alias("validates"),
        F.bool_or(name.rlike(ASSERTION)).alias("asserts"),
    )


def verdicts() -> list[tuple[str, str, Column]]:
    """(rule, role, struct (kind, message)) of the rules, on the columns of the summary. Identifiers and messages are fixed values."""
    calls, callees = F.coalesce("n_calls", F.lit(0)), F.coalesce("n_callees", F.lit(0))
    say = lambda kind, message: F.struct(F.lit(kind).alias("kind"), message.cast("string").alias("message"))
    text = F.lit
    return [
        ("builtin:route_handler:auth_check_present", "route_handler",
         F.when(F.col("first_auth").isNotNull(), say("pass", F.concat(text("calls "), "first_auth"))).otherwise(say("skip", text("no in-handler auth call detected")))),
        ("builtin:route_handler:input_validated", "route_handler",
         F.when(F.coalesce("validates", F.lit(False)), say("pass", text("invokes a validate/parse/check call"))).otherwise(say("fail", text("no validate/parse/check call detected in body")))),
        ("builtin:service:single_responsibility", "service",
         F.when(callees > MOST_CALLEES, say("fail", F.concat(callees.cast("string"), text(" distinct callees — split this up?"))))
         .otherwise(say("pass", F.concat(callees.cast("string"), text(" callees, in budget"))))),
        ("builtin:repository:narrow_data_access", "repository",
         F.when(calls == 0, say("skip", text("no calls observed (data access via direct expression?)")))
         .when(calls > MOST_CALLS, say("fail", F.concat(calls.cast("string"), text(" calls — wider than a single query"))))
         .otherwise(say("pass", F.concat(calls.cast("string"), text(" calls, narrow"))))),
        ("builtin:test:has_assertion", "test",
         F.when(F.coalesce("asserts", F.lit(False)), say("pass", text(None))).otherwise(say("skip", text("no obvious assertion call detected")))),
    ]


def evaluate_rules(nodes: DataFrame, roles: DataFrame, edges: DataFrame, order: list[str]) -> DataFrame:
    """A row for each node and rule of its role. Rules are expressions: no join with a table of rules."""
    judged = nodes.select("node_identity").join(roles.select("node_identity", "role"), "node_identity").join(
        call_summary(edges, order).withColumnRenamed("caller", "node_identity"), "node_identity", "left"
    )
    cases = [F.when(F.col("role") == role, F.struct(F.lit(rule).alias("rule_id"), verdict.alias("v"))) for rule, role, verdict in verdicts()]
    rows = judged.select("node_identity", F.explode(F.filter(F.array(*cases), lambda x: x.isNotNull())).alias("r"))
    return rows.select("r.rule_id", "node_identity", F.col("r.v.kind").alias("kind"), F.col("r.v.message").alias("message"))


#: Columns that a later version of a project rule may change.
CHANGEABLE = ("title", "definition", "enabled")


def tier_of(definition: Column) -> Column:
    """What runs a rule: a shell command or a language model if its definition says so, else the library."""
    said = F.get_json_object(definition, "$.tier")
    return F.when(said.isin("shell", "llm"), said).otherwise("builtin")


def project_rules(log: DataFrame) -> DataFrame:
    """The rules that a log of versions (rule_id, op, classification, title, definition, enabled, at, seq) amounts to.

    ``op`` is create, update or remove. A null leaves what stood before; a rule is enabled unless it says otherwise; its
    tier is that of its first definition. Versions of a rule that was not created, or was removed, change nothing.
    """
    said = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    first = log.where(F.col("op") == "create").groupBy("rule_id").agg(F.max("seq").alias("_made"), F.max_by("definition", "seq").alias("_first"), F.max_by("classification", "seq").alias("classification"))
    gone = log.where(F.col("op") == "remove").groupBy("rule_id").agg(F.max("seq").alias("_gone"))
    living = first.join(gone, "rule_id", "left").where(F.col("_gone").isNull() | (F.col("_gone") < F.col("_made")))
    since = log.join(living.select("rule_id", "_made"), "rule_id").where(F.col("seq") >= F.col("_made"))
    now = since.groupBy("rule_id").agg(*[said(c) for c in CHANGEABLE], F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
    return now.join(living, "rule_id").select("rule_id", "classification", "title", tier_of(F.col("_first")).alias("tier"), "definition", F.coalesce("enabled", F.lit(True)).alias("enabled"), "created_at", "updated_at")


def run_shell_rule(rows: DataFrame, command: str, key: str, payload: str, timeout_s: float = 5.0) -> DataFrame:
    """Runs a shell command for each row: JSON to its input, JSON (kind, message) from its output; any failure is ``skip``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, text in zip(pdf[key], pdf[payload], strict=True):
                try:
                    done = subprocess.run(["sh", "-c", command], input=text or "", capture_output=True, text=True, timeout=timeout_s)
                    said = json.loads(done.stdout)
                    kind = said["kind"] if said.get("kind") in ("pass", "fail", "skip") else "skip"
                    out.append((name, kind, said.get("message")))
                except (subprocess.TimeoutExpired, OSError, ValueError, TypeError, KeyError, AttributeError) as e:
                    out.append((name, "skip", type(e).__name__))
            yield pd.DataFrame(out, columns=["key", "kind", "message"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key), F.col(payload)).mapInPandas(run, f"key {kind}, kind string, message string").withColumnRenamed("key", key)


def model_rule(nodes: DataFrame, rule_id: str) -> DataFrame:
    """A rule for a language model; without one every node is skipped."""
    return nodes.select(F.lit(rule_id).alias("rule_id"), "node_identity", F.lit("skip").alias("kind"), F.lit(None).cast("string").alias("message"))
