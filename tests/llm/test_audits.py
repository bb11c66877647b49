"""Manifest, divergence audit and line dedup against brute force, and their behaviour at the edges."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillstone.llm import divergence, line_dedup, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["id", "tag", "leaf", "claim", "run", "place", "tree", "digest", "block", "term", "df", "share", "rank", "value", "high", "low", "kind", "lines", "b_id", "b_tag", "keep", "n_dropped", "kept_text", "N_Lines"]
OUTPUTS = {"keep", "n_dropped", "kept_text", "n_lines"}


def low(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def odd(rng, n=300):
    """Null, empty and long texts, null ids and sources, repeated rows, texts of one line, sources of one row and of many."""
    bodies = [None, "", " \n\t ", "One Line, told often", "One Line, told often\nshort\n\nONE line, TOLD often ", "x" * 30_000, "ünï ÇÖDÉ 漢字 🙂 " * 40, "a\x00b c\x1fd", "l1\r\nl2 is longer than ten\r\n" * 3]
    rows = []
    for i in range(n):
        text = rng.choice([*bodies, "\n".join(f"Line Number {rng.randrange(60)} of {rng.choice('AB')}" for _ in range(rng.randrange(1, 12)))])
        rows.append((rng.choice([i, i, i, None]), text, rng.choice(["en", "fr", "", None]), rng.choice([f"s{rng.randrange(30)}", "hot", "hot", "", None, "é"]), rng.choice([len(text or ""), None])))
    return rows + rows[:5]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in CLASHES})


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest(rows):
    """The audit of all rows, by hand."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    own = lambda i, s, lang, n, t: digest(*map(part, (i, s, lang, n, t)))
    by_source = defaultdict(list)
    for i, t, lang, s, n in rows:
        tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        by_source[s].append((i, own(i, s, lang, n, t), own(i, s, lang, n, low(t) if tampered else t)))

    def levels(leaves):
        found = [leaves]
        while len(found[-1]) > 1:
            found.append([digest(*found[-1][k : k + 16]) for k in range(0, len(found[-1]), 16)])
        return found

    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {s: levels([r[1] for r in by_source[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    root, found = top[-1][0], []
    for nth, s in enumerate(order):
        for k, (i, leaf, fold) in enumerate(by_source[s]):
            proof = ""
            for tree, at in ((trees[s], k), (top, nth)):
                for level in tree[:-1]:
                    run, slot = level[at // 16 * 16 : at // 16 * 16 + 16], at % 16
                    proof += "".join(run[:slot] + run[slot + 1 :])
                    fold, at = digest(*run[:slot], fold, *run[slot + 1 :]), at // 16
            found.append((i, leaf, trees[s][-1][0], root, digest(proof), fold, fold == root))
    return sorted(map(str, found))


def audited(df):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    built = merkle.build(df, claims={"text": merkle.lower_ascii(F.col("text"))}, claimed_by=tampered)
    return sorted(str(tuple(r)) for r in merkle.audit(built).collect())


@pytest.mark.parametrize("case", ["odd", "one row", "one source", "sources of one row", "deep"])
def test_manifest_matches_brute_force(spark, case):
    rows = odd(random.Random(3))
    if case == "one row":
        rows = rows[:1]
    elif case == "one source":
        rows = [(i, t, lang, "s", n) for i, t, lang, _, n in rows[:40]]
    elif case == "sources of one row":
        rows = [(k, t, lang, f"s{k}", n) for k, (_, t, lang, _, n) in enumerate(rows[:18])]
    elif case == "deep":  # more than 256 runs in one source, so that nodes stand in several blocks
        rows = [(k, f"Row {k}", "en", "hot" if k % 3 else f"s{k % 40}", k) for k in range(7_000)]
    assert audited(frame(spark, rows)) == manifest(rows)


def test_manifest_of_no_rows(spark):
    assert audited(frame(spark, [])) == []


def test_manifest_finds_each_kind_of_change(spark):
    rows = [(i, f"Text {i}", "en", "s", 5) for i in range(50)]
    df = spark.createDataFrame(rows, DOCS)
    for column, value in (("source", F.lit("S")), ("lang", F.lit(None).cast("string")), ("n_chars", F.lit(6)), ("text", F.lit(""))):
        built = merkle.build(df, claims={column: value}, claimed_by=F.col("doc_id") == 17)
        assert [r["doc_id"] for r in merkle.audit(built).where(~F.col("verified")).collect()] == [17]
    assert merkle.audit(merkle.build(df)).where("verified").count() == 50


# --- divergence ---------------------------------------------------------------------------------------------------


def terms(text):
    return divergence.term_counts(text or "")


def diverging(rows, least=10):
    docs = [(lang or "", s or "", Counter(x.decode() for x in terms(t).elements())) for _, t, lang, s, _ in rows]
    found = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for x, _, c in docs if x == lang for t in c)
        kept = [t for t, n in df.items() if n >= least]
        groups = defaultdict(Counter)
        for x, s, c in docs:
            if x == lang:
                groups[s].update({t: c[t] for t in kept})
        whole, v = sum(groups.values(), Counter()), len(kept)
        share = lambda g, t: 1 + 1_000_000_000 * (g[t] + 2) // (sum(g[k] for k in kept) + 2 * v)  # noqa: B023, E731
        p = {s: {t: share(g, t) for t in kept} for s, g in groups.items()}
        q = {t: share(whole, t) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, g in groups.items():
            pairs = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            told = [("term", t, f(p[s][t], q[t])) for t in kept if g[t] > 0 and p[s][t] > q[t]]
            for part, most in ((pairs, None), (told, 10)):
                ranked = sorted(part, key=lambda r: (-r[2], r[1].encode()))[:most]
                found += [(lang, s, *r, k) for k, r in enumerate(ranked, 1)]
    return sorted(map(str, found))


def test_terms_are_runs_of_letters():
    import re

    plain = lambda t: Counter(x.lower() if x.isascii() else low(x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t))
    for text in ("", "A b_c{d}e", "ÄÖü İstanbul ß a\x80b", "x" * 3_000_000, "word " * 700_000 + "Last", "é" * 600_000 + " " + "z1y " * 400_000):
        assert Counter({k.decode(): v for k, v in divergence.term_counts(text).items()}) == plain(text)


def test_divergences_match_brute_force(spark):
    rows = odd(random.Random(4), 400)
    got = divergence.divergences(frame(spark, rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == diverging(rows)
    none = [(1, "few words", "en", "a", 1), (2, None, "en", "b", 1), (3, "words", "fr", "c", 1)]
    assert sorted(str(tuple(r)) for r in divergence.divergences(frame(spark, none)).collect()) == diverging(none) == ["('en', 'a', 'pair', 'b', 0, 1)", "('en', 'b', 'pair', 'a', 0, 1)"]
    assert divergence.divergences(frame(spark, [])).collect() == []


def test_tables_put_out_early_merge_to_the_same(monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice(["en", "fr"]), rng.choice("abc"), " ".join(rng.choice("the of and to in that is was for") for _ in range(rng.randrange(20)))) for _ in range(200)]
    batch = pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["lang", "source", "text"])

    def merged(entries, cut_at):
        monkeypatch.setattr(divergence, "ENTRIES", entries)
        out = pa.Table.from_batches(divergence.fold_documents(iter([batch]))).sort_by([("lang", "ascending"), ("term", "ascending")])
        found = pa.Table.from_batches(divergence.merge_stripes(2)(iter(out.combine_chunks().to_batches(max_chunksize=cut_at)))).to_pylist()
        return [(r["lang"], r["term"], r["df"], dict(zip(r["sources"], r["counts"], strict=True))) for r in found]

    plain = defaultdict(lambda: [0, Counter()])
    for lang, source, text in rows:
        for t, n in Counter(text.split()).items():
            plain[lang, t][0] += 1
            plain[lang, t][1][source] += n
    want = sorted((lang, t, df, dict(c)) for (lang, t), (df, c) in plain.items() if df >= 2)
    for entries, cut_at in ((10**9, 10**6), (1, 1), (7, 3), (20, 50)):
        assert sorted(merged(entries, cut_at), key=lambda r: r[:2]) == want


def test_shares_stay_exact_for_large_counts():
    counts = np.array([0, 1, 10**12, 10**15], np.int64)
    total, v = 4 * 10**15, 10**8
    assert divergence.shares(counts, total, v).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 2 * v) for c in counts]


# --- lines --------------------------------------------------------------------------------------------------------


def deduped(rows):
    blank = " \t\n\x0b\x0c\r"
    first = {}
    rank = lambda i: (i is not None, i or 0)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            key = low(line.strip(blank))
            if len(key) >= 10:
                first[key] = min(first.get(key, rank(i)), rank(i))
    found = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(low(x.strip(blank))) < 10 or first[low(x.strip(blank))] == rank(i)]
        found.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(str, found))


@pytest.mark.parametrize("case", ["odd", "one line everywhere", "text ids", "empty"])
def test_lines_match_brute_force(spark, case):
    rows = [] if case == "empty" else odd(random.Random(6))
    if case == "one line everywhere":
        rows = [(i, "the line that all documents have\n" * (1 + i % 3) + f"and one of its own {i}", "en", "s", 1) for i in range(500, 0, -1)]
    df = frame(spark, rows)
    if case == "text ids":
        df, rows = df.withColumn("doc_id", F.col("doc_id").cast("string")), [(None if i is None else str(i), *rest) for i, *rest in rows]
        global_rank = sorted({r[0] for r in rows if r[0] is not None})
        want = deduped([(None if i is None else global_rank.index(i) + 1, *rest) for i, *rest in rows])
        got = [(None if r[0] is None else global_rank.index(r[0]) + 1, *r[1:]) for r in line_dedup.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()]
        assert sorted(map(str, got)) == want
        return
    found = line_dedup.dedup_lines(df)
    assert sorted(str(tuple(r)) for r in found.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()) == deduped(rows)
    assert {c.lower() for c in found.columns} >= {c.lower() for c in df.columns} and all(set(r) == {7} for r in found.select(*[c for c in CLASHES if c.lower() not in OUTPUTS]).distinct().collect())
    slim = line_dedup.keep_bitmaps(df).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"]) for r in slim) == sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"]) for r in found.collect())


def test_prefix_sets_outputs_of_lines_apart(spark):
    rows = [(1, "a line that is shared\nb", "en", "s", 1), (2, "A line that is shared \nc", "en", "s", 1)]
    df = frame(spark, rows)
    found = line_dedup.dedup_lines(df, prefix="_new_")
    assert set(df.columns) < set(found.columns) and {r["doc_id"]: r["_new_kept_text"] for r in found.collect()} == {1: "a line that is shared\nb", 2: "c"}


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_ranges_that_begin_within_a_hash(ranges):
    rng = random.Random(ranges)
    rows = sorted((rng.choice([1, 1, 2, 3]), 0, rng.randrange(-1, 8), k) for k in range(60))  # -1: a null id
    names = ["high", "low", "id", "tag", "n_lines", "lines"]
    make = lambda part: pa.record_batch([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([None if r[2] < 0 else r[2] for r in part], pa.int64()), pa.array([r[3] for r in part], pa.int64()), pa.array([1] * len(part), pa.int64()), pa.array([b"\0\0\0\0"] * len(part), pa.binary())], names=names)
    cuts = sorted(rng.randrange(61) for _ in range(ranges - 1))
    out = []
    for a, b in zip([0, *cuts], [*cuts, 60], strict=True):
        size = rng.choice([1, 3, 60])
        out += [r for t in line_dedup.first_occurrences(make(rows[k : min(b, k + size)]) for k in range(a, b, size)) for r in t.to_pylist()]
    assert sum(r["kind"] == line_dedup.LAST for r in out) == len({(a, b) for a, b in zip([0, *cuts], [*cuts, 60], strict=True) if a < b} or {0})
    known = defaultdict(lambda: 99)
    for r in out:
        if r["kind"] != line_dedup.GOES:
            known[r["high"]] = min(known[r["high"]], -1 if r["id"] is None else r["id"])
    goes = {r["tag"] for r in out if r["kind"] == line_dedup.GOES or r["kind"] == line_dedup.OPEN and (-1 if r["id"] is None else r["id"]) != known[r["high"]]}
    first = {h: min(r[2] for r in rows if r[0] == h) for h in (1, 2, 3)}
    assert goes == {k for h, _, i, k in rows if i != first[h]}
