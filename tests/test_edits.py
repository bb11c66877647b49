"""Edit scripts against brute force, and comments that move with their lines."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillstone.operators import edits


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=24), st.lists(st.sampled_from("abcde"), max_size=24))
def test_scripts_are_shortest(a, b):
    kept = edits.kept_pairs(a, b)
    assert len(kept) == longest(a, b) and all(a[i] == b[j] for i, j in kept)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(kept, kept[1:], strict=False))


def test_long_files_with_few_changes():
    rng = random.Random(1)
    a = [rng.choice(["}", "", "x", str(rng.randrange(5000))]) for _ in range(20_000)]
    b = [x for k, x in enumerate(a) if k % 400] + ["new"]
    assert len(edits.kept_pairs(a, b)) == len(a) - 50
    assert edits.kept_pairs(list("abc") * 5000, list("xyz") * 5000) == []


def test_positions_added_and_removed(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["b", "x", "c"]), (2, None, ["a"]), (3, [], None), (4, ["a", "a"], ["a"])], "i int, old array<string>, new array<string>")
    got = {r["i"]: ([tuple(p) for p in r["kept"]], r["removed"], r["added"]) for r in edits.sequence_edits(df, "old", "new").collect()}
    assert got[1] == ([(1, 0), (2, 2)], [0], [1]) and got[2] == ([], [], [0]) and got[3] == ([], [], []) and len(got[4][1]) == 1 and got[4][2] == []


def test_comments_move_with_their_lines(spark):
    rng = random.Random(2)
    olds, news, comments = [], [], []
    for f in range(12):
        old = [f"line {rng.randrange(60)}" for _ in range(rng.choice([5, 200]))]
        new = [x for x in old if rng.random() > 0.2]
        for _ in range(10):
            new.insert(rng.randrange(len(new) + 1), f"new {rng.randrange(99)}")
        olds.append((f"f{f}", "\n".join(old)))
        news.append((f"f{f}", "\n".join(new)))
        for c in range(20):
            s = rng.randrange(1, len(old) + 1)
            comments.append((f * 100 + c, f"f{f}", s, min(len(old), s + rng.choice([0, 0, 3, 150]))))
    comments.append((9999, "unchanged", 3, 4))
    base, head = spark.createDataFrame(olds, "path string, content string"), spark.createDataFrame(news, "path string, content string")
    runs = edits.line_runs(base, head)
    got = {r["comment_id"]: (r["new_start"], r["new_end"]) for r in edits.moved_comments(spark.createDataFrame(comments, "comment_id long, file_path string, line_start int, line_end int"), runs, base).collect()}
    assert got.pop(9999) == (3, 4)
    kept = {p: dict(edits.kept_pairs(o.split("\n"), n.split("\n"))) for (p, o), (_, n) in zip(olds, news, strict=True)}
    for i, path, s, e in comments[:-1]:
        there = [kept[path][k - 1] + 1 for k in range(s, e + 1) if k - 1 in kept[path]]
        assert got[i] == ((min(there), max(there)) if there else (None, None))


def test_overlaps_are_found_once(spark):
    rng = random.Random(3)
    make = lambda: [(rng.choice("ab"), s := rng.randrange(400), s + rng.randrange(-1, 150), k) for k in range(60)]
    left, right = make(), make()
    a, b = spark.createDataFrame(left, "path string, s int, e int, i int"), spark.createDataFrame(right, "path string, low int, high int, j int")
    got = sorted((r["i"], r["j"]) for r in edits.overlapping(a, b, (F.col("s"), F.col("low")), (F.col("e"), F.col("high"))).collect())
    assert got == sorted((i, j) for p, s, e, i in left for q, x, y, j in right if p == q and s <= e and x <= y and s <= y and x <= e)
