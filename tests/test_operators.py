"""Operators on small cases worked out by hand."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillstone.functions import ids
from rillstone.functions.state import choose_review, runtime_kind, runtime_state
from rillstone.operators import browse, classify, comments, delta, paths, prep, renames, resolve, review, rules
from rillstone.operators.signals import default_signals
from rillstone.schemas import CALL_EDGES, COMMENTS, EXPORTS, FILES, IMPORTS, NODES, REVIEW_EVENTS


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(
    "path, modules, want",
    [
        ("src/services/orderService.ts", [], ("service", "medium", False)),
        ("src/db/userRepo.ts", [], ("repository", "medium", False)),
        ("src/dao/UserDao.ts", [], ("repository", "medium", False)),
        ("src/orders/OrderRepository.ts", [], ("repository", "medium", False)),
        ("src/services/middleware/x.ts", [], ("service", "low", True)),
        ("src/db/x.ts", ["drizzle-orm"], ("repository", "high", False)),
        ("src/lib/pay.ts", ["stripe/api"], ("client", "low", False)),
        ("src/components/useThing.tsx", [], ("hook", "low", True)),
        ("fixtures/src/db/x.ts", [], ("fixture", "high", False)),
        ("src/x.test.ts", [], ("test", "high", False)),
        ("src/types.d.ts", [], ("type_only", "high", False)),
        ("vite.config.ts", [], ("config", "high", False)),
        ("server.ts", None, ("unclassified", "none", False)),
    ],
)
def test_roles_of_paths(spark, path, modules, want):
    df = spark.createDataFrame([(path, modules)], "path string, modules array<string>")
    got = classify.classify_files(df, default_signals()).first()
    assert (got["role"], got["confidence"], got["conflicting"]) == want


def test_reconcile_takes_the_second_opinion_only_where_unsure(spark):
    first = spark.createDataFrame([("a", "x", "low", False), ("b", "x", "high", False), ("c", "x", "medium", False), ("d", "x", "low", True)], "path string, role string, confidence string, conflicting boolean")
    second = spark.createDataFrame([("a", "x", "high"), ("b", "y", "high"), ("c", "y", "high")], "path string, role string, confidence string")
    got = {r["path"]: (r["role"], r["confidence"], r["conflicting"]) for r in classify.reconcile(first, second).collect()}
    assert got == {"a": ("x", "high", False), "b": ("x", "high", False), "c": ("y", "low", True), "d": ("x", "low", True)}


def test_paths_and_names(spark):
    r = one(
        spark, p=ids.normal_path(F.lit("../src/./a/../b/c")), t=ids.name_tokens(F.lit("getHTTPUser_by-id")), s=ids.name_similarity(F.lit("listOrders"), F.lit("listMyOrders")),
        low=ids.name_similarity(F.lit("listOrders"), F.lit("fetchOrders")), j=ids.canonical_json(b=F.lit(1), a=F.lit("x")), n=ids.identity_parts(F.lit("p:a:b.ts:f")),
        cut=ids.cut_off(F.lit("abcdef"), 4), src=ids.normal_source(F.lit("a  // x\n /* y */ b")), body=ids.body_lines(F.lit("a\nb\nc"), F.lit(2), F.lit(9)),
    )
    assert r["p"] == "src/b/c" and r["s"] == pytest.approx(2 / 3) and r["low"] == pytest.approx(1 / 3)
    assert r["j"] == '{"a":"x","b":1}' and tuple(r["n"]) == ("p", "a:b.ts", "f")
    assert r["cut"] == "abcd\n…[truncated 2 chars]" and r["src"] == "a b" and r["body"] == "b\nc"


def edges(spark, rows):
    made = [("f", 0, i, a, b, 1, 1, False, None) for i, (a, b) in enumerate(rows)]
    return spark.createDataFrame(made, CALL_EDGES)


def walked(spark, calls, entry="a", answers=None, nodes=None):
    nodes = nodes or sorted({x for c in calls for x in c} | {entry})
    table = spark.createDataFrame([(n,) for n in nodes], "node_identity string")
    callees = paths.callees_in_order(edges(spark, calls), table, ["file_ord", "edge_seq"])
    return paths.walk(table.where(F.col("node_identity") == entry), callees, answers).first()


def test_walk_chain_cycle_branch_and_ring(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(9)]
    r = walked(spark, chain, "n0")
    assert (len(r["nodes"]), r["max_depth"], r["cycle_at"]) == (8, 7, None)
    r = walked(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    assert (r["nodes"], r["max_depth"], r["cycle_at"]) == (["a", "b", "c"], 3, 0)
    ring = [(f"n{i}", f"n{(i + 1) % 8}") for i in range(8)]
    r = walked(spark, ring, "n0")
    assert (len(r["nodes"]), r["max_depth"], r["cycle_at"]) == (8, 7, None)
    answers = spark.createDataFrame([("a", "a", "c")], "entry string, caller string, choice string")
    assert walked(spark, [("a", "b"), ("a", "c")])["nodes"] == ["a", "b"]
    assert walked(spark, [("a", "b"), ("a", "c")], answers=answers)["nodes"] == ["a", "c"]


def model_walk(calls, nodes, entry, depth=8):
    """The walk as plain Python, for comparison."""
    order, cursor, cycle, last = [], entry, None, 0
    for position in range(depth):
        if cursor is None:
            break
        last = position
        if cursor in order:
            cycle = order.index(cursor)
            break
        order.append(cursor)
        cursor = next((b for a, b in calls if a == cursor and b in nodes), None)
    return order, cycle, last


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdefz")), min_size=1, max_size=14))
def test_walk_matches_model(spark, calls):
    got = walked(spark, calls, "a", nodes=list("abcdef"))
    assert (got["nodes"], got["cycle_at"], got["max_depth"]) == model_walk(calls, set("abcdef"), "a")


def test_entry_points_need_framework_and_handler(spark):
    rows = [("r.ts", 0, 0, "p:r.ts:h", "p:r.ts:get", 1, 1, True, "handler-attached"), ("r.ts", 0, 1, "p:r.ts:h", "p:r.ts:use", 1, 1, True, "handler-attached"), ("q.ts", 1, 2, "p:q.ts:h", "p:q.ts:post", 1, 1, True, "handler-attached")]
    imports = spark.createDataFrame([("r.ts", 0, "express", "Router")], IMPORTS)
    got = paths.entry_points(spark.createDataFrame(rows, CALL_EDGES), imports).collect()
    assert [(r["node_identity"], r["method"]) for r in got] == [("p:r.ts:h", "GET")]


def test_calls_resolve_across_files(spark):
    files = spark.createDataFrame([(0, "src/routes/u.ts", "", 0), (1, "src/services/userService.ts", "", 0), (2, "src/x.ts", "", 0)], FILES)
    imports = spark.createDataFrame([("src/routes/u.ts", 0, "../services/userService", "findUser"), ("src/routes/u.ts", 1, "../x.js", "other"), ("src/routes/u.ts", 2, "lodash", "map")], IMPORTS)
    exports = spark.createDataFrame([("src/services/userService.ts", 0, "findUser", "p:src/services/userService.ts:findUser"), ("src/x.ts", 0, "other", "p:src/x.ts:other")], EXPORTS)
    mk = lambda i, name, hint: ("src/routes/u.ts", 0, i, "p:src/routes/u.ts:h", f"p:src/routes/u.ts:{name}", 1, 1, True, hint)
    rows = [mk(0, "findUser", "cross-file-or-external"), mk(1, "other", "cross-file-or-external"), mk(2, "map", "cross-file-or-external"), mk(3, "findUser", "indirect")]
    got = {r["edge_seq"]: (r["callee"], r["unresolved"]) for r in resolve.resolve_calls(spark.createDataFrame(rows, CALL_EDGES), imports, exports, files).collect()}
    assert got[0] == ("p:src/services/userService.ts:findUser", False)
    assert got[1] == ("p:src/routes/u.ts:other", True) and got[2][1] and got[3][1]


def node(identity, path, name, exported=True, params=("a",), ret="", ord_=0, kind="function"):
    return (identity, path, 0, ord_, kind, name, 1, 2, exported, "h", (list(params), ret))


def test_renames(spark):
    prior = spark.createDataFrame([node("p:f:listOrders", "f", "listOrders"), node("p:g:listOrders", "g", "listOrders"), node("p:f:same", "f", "same")], NODES)
    now = spark.createDataFrame([node("p:f:listMyOrders", "f", "listMyOrders"), node("p:f:same", "f", "same"), node("p:h:fetchOrders", "h", "fetchOrders")], NODES)
    got = renames.rename_candidates(prior, now).collect()
    assert [(r["old_identity"], r["new_identity"], round(r["similarity"], 3)) for r in got] == [("p:f:listOrders", "p:f:listMyOrders", 0.667)]


def test_contract_changes(spark):
    cols = "node_identity string, exported boolean, params array<string>, return_type string"
    base = spark.createDataFrame([("p:a:f", False, ["a"], ""), ("p:a:g", True, ["a"], "x"), ("p:a:h", True, ["a"], "x"), ("p:a:i", True, ["a"], "x")], cols)
    head = spark.createDataFrame([("p:a:f", True, ["a"], ""), ("p:a:h", True, ["a", "b"], "y"), ("p:a:i", True, ["b"], "x"), ("p:a:n", False, [], "")], cols)
    got = sorted((r["node_identity"][-1], r["change"]) for r in delta.contract_changes(base, head).collect())
    assert got == [("f", "export_added"), ("g", "export_removed"), ("h", "param_added"), ("h", "return_type_changed"), ("i", "param_type_changed")]


def test_rules(spark):
    nodes = spark.createDataFrame([(n,) for n in "rst"], "node_identity string")
    roles = spark.createDataFrame([("r", "route_handler"), ("s", "service"), ("t", "repository")], "node_identity string, role string")
    got = {r["rule_id"].split(":")[-1]: (r["kind"], r["message"]) for r in rules.evaluate_rules(nodes, roles, edges(spark, [("r", "p:f:requireAuth"), *[("s", f"p:f:c{i}") for i in range(9)]]), ["file_ord", "edge_seq"]).collect()}
    assert got["auth_check_present"] == ("pass", "calls requireAuth") and got["input_validated"][0] == "fail"
    assert got["single_responsibility"] == ("fail", "9 distinct callees — split this up?") and got["narrow_data_access"][0] == "skip"


def test_shell_rules_never_fail_the_run(spark):
    rows = spark.createDataFrame([("a", "{}")], "node_identity string, payload string")
    run = lambda command: rules.run_shell_rule(rows, command, "node_identity", "payload", 0.5).first()["kind"]
    assert [run("echo '{\"kind\":\"pass\"}'"), run("true"), run("echo nonsense"), run("sleep 5")] == ["pass", "skip", "skip", "skip"]


def event(seq, node_, scope, op="set", status="approved", reason="replaced", code="h"):
    from datetime import datetime, timedelta

    return (seq, datetime(2024, 1, 1) + timedelta(hours=seq), node_, scope, op, status, None, code, "me", reason)


def test_review_log(spark):
    log = spark.createDataFrame([event(1, "a", "global"), event(2, "a", "global", status="rejected"), event(3, "b", "global"), event(4, "b", "global", op="clear", reason="manual_clear"), event(5, "c", "path:x")], REVIEW_EVENTS)
    current = review.current_reviews(log)
    assert sorted((r["node_identity"], r["status"], r["created_at"].hour, r["updated_at"].hour) for r in current.collect()) == [("a", "rejected", 1, 2), ("c", "approved", 5, 5)]
    assert sorted((r["node_identity"], r["reason"]) for r in review.review_history(log).collect()) == [("a", "replaced"), ("b", "manual_clear")]
    moved = review.append(log, review.promote(current, "x", "you", F.lit("2024-02-01")))
    assert [(r["scope"], r["status"], r["reviewer_id"]) for r in review.current_reviews(moved).where("node_identity = 'c'").collect()] == [("global", "approved", "you")]


def test_states(spark):
    df = spark.createDataFrame([(None, "h", None), ("approved", "h", "h"), ("approved", "h", "x"), ("approved", "h", ""), ("approved", None, "x"), ("info_requested", "h", "x"), ("info_requested", "h", "h"), ("odd", "h", "h")], "s string, c string, r string")
    got = df.select(runtime_state(F.col("s"), F.col("c"), F.col("r")), runtime_kind(F.col("s"), F.col("c"), F.col("r"))).collect()
    assert [r[0] for r in got] == ["never_reviewed", "reviewed_current", "reviewed_stale", "reviewed_current", "reviewed_current", "reviewed_stale", "info_requested", "reviewed_current"]
    assert [r[1] for r in got][1:3] == ["reviewed_current_approved", "reviewed_stale"] and got[-1][1] == "never_reviewed"


def test_scope_precedence(spark):
    rows = spark.createDataFrame([("a", "path:y", "one", 1), ("a", "global", "two", 2), ("a", "path:x", "three", 3), ("b", "path:y", "four", 1)], "node_identity string, scope string, status string, event_seq int")
    pick = lambda path: {r["node_identity"]: r["status"] for r in choose_review(rows, ["node_identity"], "event_seq", path).collect()}
    assert pick(F.lit("x")) == {"a": "three", "b": "four"} and pick(None) == {"a": "two", "b": "four"}


def test_cascade(spark):
    targets = spark.createDataFrame([("f1", "a"), ("f1", "b"), ("f1", "c")], "file string, node_identity string")
    current = spark.createDataFrame([("a", "global", "rejected"), ("b", "global", "approved"), ("c", "path:x", "rejected")], "node_identity string, scope string, status string")
    def counts(how):
        plan = review.cascade_plan(targets, current, F.lit("approved"), F.lit(how).cast("string"), ["file"])
        return tuple(review.cascade_counts(plan, ["file"]).first())[1:]
    assert counts(None) == (False, 0, 0, 0, 1)
    assert counts("preserve") == (True, 2, 1, 0, 0)
    assert counts("override") == (True, 2, 0, 1, 0)


def test_orphans_follow_sql_nulls(spark):
    rows = [(1, "file", "f.ts", None), (2, "function", "f.ts", "a"), (3, "function", "f.ts", "z"), (4, "file", "gone.ts", None)]
    table = spark.createDataFrame([(i, k, p, n, None, None, "x", "me", None, None) for i, k, p, n in rows], COMMENTS)
    functions = spark.createDataFrame([("a",)], "node_identity string")
    files = spark.createDataFrame([("f.ts",)], "path string")
    gone = lambda fn, fl: {r["comment_id"] for r in comments.archive_orphans(table, fn, fl, F.lit("2024-01-01").cast("timestamp")).where("archived_at is not null").collect()}
    assert gone(functions, files) == {3, 4}
    assert gone(functions.limit(0), files) == {4}


def test_answers(spark):
    questions = spark.createDataFrame([("q1", "rename"), ("q2", "classification")], "key string, kind string")
    given = spark.createDataFrame([("q1", '{"kind":"rename"}', None), ("q2", '{"kind":"rename"}', None)], "question_key string, answer string, answered_at timestamp")
    assert [r["question_key"] for r in prep.answer_kind_fits(questions, given).collect()] == ["q1"]


def test_progress_of_empty_scope(spark):
    none = spark.createDataFrame([], "node_identity string, status string, code_hash string, scope string, event_seq int")
    got = browse.progress(spark.createDataFrame([], "node_identity string"), none, spark.createDataFrame([], "node_identity string, content_hash string")).first()
    assert got["total"] == 0 and got["coverage_path"] == 0.0


def test_rename_answers(spark):
    questions = spark.createDataFrame([("q1", "rename", '{"oldIdentity":"p:a:x","newIdentity":"p:a:y"}'), ("q2", "rename", '{"oldIdentity":"p:a:u","newIdentity":"p:a:v"}'), ("q3", "rename", '{"oldIdentity":"p:a:n","newIdentity":"p:a:m"}')], "key string, kind string, context string")
    answers = spark.createDataFrame([("q1", '{"kind":"rename","decision":"carry_forward"}'), ("q2", '{"kind":"rename","decision":"treat_as_new"}')], "question_key string, answer string")
    decisions = prep.rename_decisions(questions, answers)
    assert {tuple(r) for r in decisions.collect()} == {("p:a:x", "p:a:y", "carry_forward"), ("p:a:u", "p:a:v", "treat_as_new")}
    log = review.append(spark.createDataFrame([], REVIEW_EVENTS), review.set_status(spark.createDataFrame([(i, "h") for i in ("p:a:x", "p:a:u", "p:a:z")], "node_identity string, content_hash string"), "approved", None, "me", F.lit("2024-01-01")))
    after = review.append(log, prep.archived_as_new(review.current_reviews(log), decisions, F.lit("2024-02-01")))
    assert {r["node_identity"] for r in prep.carried(review.current_reviews(after), decisions, "node_identity").collect()} == {"p:a:y", "p:a:z"}
    assert [r["reason"] for r in review.review_history(after).collect()] == ["rename_treat_as_new"]
    flagged = prep.needs_analysis(spark.createDataFrame([('{"kind":"path_branch"}',), ('{"kind":"rename"}',)], "answer string")).collect()
    assert [r["requires_reanalysis"] for r in flagged] == [True, False]


def test_project_rules(spark):
    log = spark.createDataFrame(
        [
            ("a", "create", "service", "one", '{"tier":"shell","command":"x"}', None, 1, 1), ("a", "update", None, "two", None, None, 2, 2), ("a", "update", None, None, '{"tier":"llm"}', False, 3, 3),
            ("b", "create", "test", "b", '{"x":1}', None, 1, 4), ("b", "remove", None, None, None, None, 2, 5), ("c", "update", None, "never made", None, None, 1, 6), ("d", "create", "hook", "d", "{}", True, 1, 7),
        ],
        "rule_id string, op string, classification string, title string, definition string, enabled boolean, at int, seq int",
    )
    got = {r["rule_id"]: r for r in rules.project_rules(log).collect()}
    assert set(got) == {"a", "d"} and got["d"]["tier"] == "builtin" and got["d"]["enabled"]
    a = got["a"]
    assert (a["classification"], a["title"], a["tier"], a["definition"], a["enabled"], a["created_at"], a["updated_at"]) == ("service", "two", "shell", '{"tier":"llm"}', False, 1, 3)
    questions, answers = spark.createDataFrame([("q", "x"), ("r", "x")], "key string, kind string"), spark.createDataFrame([("q",)], "question_key string")
    assert tuple(prep.open_totals(questions, answers, rules.project_rules(log)).first()) == (1, 1)


def test_memo_of_responses(spark):
    key = one(spark, a=prep.request_hash(*map(F.lit, ("p", "n", "1", "m", "input"))), b=prep.request_hash(*map(F.lit, ("p", "n", "2", "m", "input"))))
    assert key["a"] != key["b"]
    stored = spark.createDataFrame([("h1", "1", '```json\n{"role": "service"}\n```', 1), ("h2", "1", "not json", 1), ("h3", "0", '{"role": "hook"}', 1), ("h4", "1", '{"other": 1}', 1)], "input_hash string, prompt_version string, response string, last_used_at int")
    asked = spark.createDataFrame([(f"h{i}",) for i in range(1, 6)], "input_hash string")
    found, missing = prep.memo(asked, stored, F.lit("1"), "role string", ["role"])
    assert [r["input_hash"] for r in found.collect()] == ["h1"] and missing.count() == 4
    assert {r["input_hash"]: r["last_used_at"] for r in prep.touched(stored, found, F.lit(9)).collect()} == {"h1": 9, "h2": 1, "h3": 1, "h4": 1}
    got = one(spark, x=ids.parsed_response(F.lit(' {"role": "test"} '), "role string", ["role"])["role"], t=ids.iso_time(F.lit("2024-01-02 03:04:05.678").cast("timestamp")), p=ids.percent(F.lit(0.125)), s=ids.short_id(F.lit("0123456789")))
    assert tuple(got) == ("test", "2024-01-02T03:04:05.678Z", "13%", "01234567")


def test_checklists_show_rule_results(spark):
    roles = spark.createDataFrame([("n", "service"), ("m", "other")], "node_identity string, role string")
    results = spark.createDataFrame([("builtin:service:single_responsibility", "n", "pass", "2 callees, in budget"), ("own", "m", "fail", "x")], "rule_id string, node_identity string, kind string, message string")
    got = {(r["node_identity"], r["item_ord"]): (r["label"], r["state"]) for r in browse.checked_items(browse.checklist(roles), results).collect()}
    assert got[("n", 0)] == ("Single responsibility", "pass") and got[("n", 1)][1] == "unchecked" and len(got) == 7 and got[("m", 2)] == ("Error handling", "unchecked")


def test_names_of_entries_and_what_is_not_drawn(spark):
    found = spark.createDataFrame([("p:a:x",), ("p:b:gone",)], "entry string")
    nodes = spark.createDataFrame([("p:a:x", "x")], "node_identity string, name string")
    assert {r["entry"]: r["entry_name"] for r in browse.entry_names(found, nodes).collect()} == {"p:a:x": "x", "p:b:gone": "b:gone"}
    callees = spark.createDataFrame([("a",), ("b",)], "callee string")
    assert [r["callee"] for r in browse.not_drawn(callees, spark.createDataFrame([("a",)], "node_identity string")).collect()] == ["b"]


def test_languages_and_frameworks(spark):
    from rillstone.plans.adapters import JAVASCRIPT

    imports = lambda module: spark.createDataFrame([("a.ts", 0, module, "default")], IMPORTS)
    assert [f.name for f in JAVASCRIPT.used(imports("express"))] == ["express"] and JAVASCRIPT.used(imports("other")) == []
    assert JAVASCRIPT.applies("typescript", []) and JAVASCRIPT.applies("go", ["node"]) and not JAVASCRIPT.applies("go", ["gin"])


def test_running_sums_need_no_single_task(spark):
    from rillstone.functions.lineage import running

    rows = [(i * 7919 % 1000, i % 5) for i in range(1000)]
    got = {r["k"]: (r["place"], r["total"]) for r in running(spark.createDataFrame(rows, "k int, v int").repartition(6), [F.col("k")], {"place": F.lit(1), "total": F.col("v")}).collect()}
    total = 0
    for place, (k, v) in enumerate(sorted(rows)):
        assert got[k] == (place, total)
        total += v
    assert running(spark.createDataFrame([], "k int, v int"), [F.col("k")], {"place": F.lit(1)}).count() == 0


def test_calls_meet_the_keys_of_changes_last(spark):
    changes = spark.createDataFrame([("c1", "f"), ("c2", "f"), ("c3", "g")], "change_id string, node_identity string")
    edges = spark.createDataFrame([("f", "a"), ("f", "a"), ("g", "b"), ("h", "a"), (None, "a"), ("f", None)], "callee string, caller string")
    members = spark.createDataFrame([("p", "a"), ("q", "b")], "path_id string, node_identity string")
    deltas = spark.createDataFrame([("q", "modified_in_place"), ("p", "unchanged")], "head_path_id string, classification string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = delta.affected_callers(changes, edges, members, deltas)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the join that brings the keys of changes is the uppermost, and nothing is shuffled after it
    assert plan.index("SortMergeJoin [callee") < min(plan.index("SortMergeJoin [caller"), plan.index("Exchange"))
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted([("c1", "a", True, False)] * 2 + [("c2", "a", True, False)] * 2 + [("c3", "b", True, True), ("c1", None, False, False), ("c2", None, False, False)], key=str)


def test_first_step_takes_answers_of_entries_alone(spark):
    callees = spark.createDataFrame([("a", ["b", "c"]), ("c", ["d", "e"])], "caller string, callees array<string>")
    answers = spark.createDataFrame([("a", "a", "c"), ("a", "c", "e"), ("c", "a", "c")], "entry string, caller string, choice string")
    start = spark.createDataFrame([("a",), ("c",)], "entry string")
    plan = paths._stepped(start, callees, answers, 1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"\(entry#\d+ = caller#\d+\)", plan)
    got = {r["entry"]: r["nodes"] for r in paths._stepped(start, callees, answers, 4).collect()}
    assert got == {"a": ["a", "c", "e"], "c": ["c", "d"]}
