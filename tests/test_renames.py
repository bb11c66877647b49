"""Renames by the shape of code: alike functions are found under new names, one to one."""

from rillstone.operators import renames
from rillstone.sources import files as sources
from rillstone.sources.parse import parse

BODY = "(id: string, deep = true): Row {\n  const row = table.find((r) => r.id === id);\n  if (!row) { throw new Missing(`no ${id}`); }\n  return deep ? copy(row, { deep }) : row;\n}\n"
OTHER = "(rows) {\n  for (const r of rows) { send(r, 1); }\n  return rows.length;\n}\n"


def test_functions_are_known_by_their_shape(spark):
    base = {"a.ts": f"export function load{BODY}function sendAll{OTHER}function stays() {{ return 1; }}\n", "b.ts": f"function load{BODY}"}
    head = {
        "a.ts": "export function fetchOne" + BODY.replace("table.find", "list.find") + "function fetchTwo" + BODY.replace("deep ? ", "!deep ? ").replace("row", "found") + "function push" + OTHER.replace("1", "22") + "function stays() { return 2; }\n",
        "b.ts": "function unlike(x) { return x; }\n",
    }
    old, new = (parse(sources.given_files(spark, sorted(f.items())), "p") for f in (base, head))
    got = {(r["old_identity"], r["new_identity"]): r["similarity"] for r in renames.shape_renames(old, new).collect()}
    assert set(got) == {("p:a.ts:load", "p:a.ts:fetchOne"), ("p:a.ts:sendAll", "p:a.ts:push")}
    assert all(0.75 <= s <= 1 for s in got.values())


def test_matching_in_rounds(spark):
    pairs = [("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.85), ("b", "y", 0.76), ("c", "y", 0.8), ("d", "z", 0.8), ("e", "z", 0.8)]
    got = renames.one_to_one(spark.createDataFrame(pairs, "old_key string, new_key string, similarity double")).collect()
    assert {(r["old_key"], r["new_key"]) for r in got} == {("a", "x"), ("c", "y"), ("d", "z")}
    assert renames.one_to_one(spark.createDataFrame([], "old_key string, new_key string, similarity double")).count() == 0


def test_copies_of_a_name_are_compared_once(spark, monkeypatch):
    met, near_pairs = [], renames.near_pairs
    monkeypatch.setattr(renames, "near_pairs", lambda *given: met.append(near_pairs(*given)) or met[-1])
    old = spark.range(60).selectExpr("id", "'a.ts' AS file", "if(id < 50, 'loadOne', 'sendAllRows') AS name")
    new = spark.range(100, 160).selectExpr("id", "'a.ts' AS file", "CASE WHEN id < 102 THEN 'other' WHEN id < 150 THEN 'loadOneRow' ELSE 'sendRows' END AS name")
    for name in (None, "name"):
        got = renames.best_matches(old, new, ["file"], "id", "id", renames.name_tokens(renames.F.col("name")), name).collect()
        assert {(r["old_key"], r["new_key"]) for r in got} == {(i, 102 if i < 50 else 150) for i in range(60)}
        assert met.pop().count() == 2
