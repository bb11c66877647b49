"""URL filtering by the ratio of two character language models.

Rules on host and path judge the URLs they fit. From those, one variable-order
Markov model is learned for accepted and one for rejected URLs; every other URL
is judged by the difference of its log-likelihoods under the two, divided by its
length and calibrated to a probability. For the calibration each judged URL is
scored by the counts less its own, of all its rows; the final counts are of all.

A model is a table of exact counts of character runs and of the contexts before them,
for each order. Nothing of it is gathered or sent: what a character adds to the
difference depends on the six characters that end with it, so the distinct sixes of all
URLs get the counts of their ends and of the ends of what is before their last
character, and the URLs' sixes are joined to them. A run shorter than its order begins a URL. Only the histogram of the calibration, of ``2 * BINS`` numbers, passes
the driver. The probability after a context of k characters is
(count + STRENGTH * probability after k-1) / (context count + STRENGTH).

Defined results: host and path of a null URL or one without ``://`` are empty, no
rule fits, and the method judges the whole string (null as empty); an empty string
scores 0 before calibration; without accepted or rejected examples, as in an empty
table, the verdict is allow; URLs of any length are judged whole, in pieces; repeated
rows are judged alike; at a score of exactly 0.5 the verdict is allow. Further columns
pass through; one that has the name of an output is replaced, unless ``prefix`` sets
the outputs apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, ship, unused

ORDERS = 6
#: Characters whose runs are counted at once.
PIECE = 1 << 17
STRENGTH = 2.0
BINS, SPAN = 400, 4.0
#: (verdict, host and path)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: What the outputs of ``judge_urls`` are called.
OUTPUTS = ("host", "path", "rule", "score", "verdict")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or nulls."""
    found = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _pieces(urls: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some ``PIECE`` characters at once: which URL each is of, its place in it, and it with the five before it as numbers, 0 where there is none.

    A longer URL comes in pieces of its own.
    """
    i = 0
    while i < len(urls):
        k, size = i, 0
        while k < len(urls) and (k == i or size + len(urls[k]) <= PIECE):
            size += len(urls[k])
            k += 1
        lengths = np.array([len(u) for u in urls[i:k]], np.int64)
        codes = np.frombuffer("".join(urls[i:k]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        owner = np.repeat(np.arange(i, k), lengths)
        at = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        for start in range(0, len(codes), PIECE):
            here = np.arange(start, min(len(codes), start + PIECE))
            back = np.array([np.where(at[here] >= d, codes[np.maximum(here - d, 0)], 0) for d in range(ORDERS)])
            yield owner[here], at[here], back
        i = k


def _packed(back: np.ndarray, low: int, high: int) -> np.ndarray:
    """Characters ``low`` to ``high`` steps back, exclusive, as two numbers of 63 bits: three characters each."""
    parts = np.zeros((2, back.shape[1]), np.int64)
    for d in range(low, high):
        parts[(d - low) // 3] = (parts[(d - low) // 3] << 21) | back[d]
    return parts


def _text(back: np.ndarray, at: np.ndarray) -> pa.Array:
    """Sixes as text, shorter at the beginning of a URL."""
    codes = (back[::-1].T - 1).astype(np.uint32)
    whole = codes.astype("<u4")
    return pa.array([row[max(0, ORDERS - 1 - a) :].tobytes().decode("utf-32-le", "surrogatepass") for row, a in zip(whole, at.tolist(), strict=True)], pa.string())


def _sixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct sixes of a batch of URLs (url, label, n), and the accepted and rejected rows that they stand in."""
    for batch in batches:
        label = np.array([-1 if x is None else x for x in batch.column(1).to_pylist()], np.int64)
        n = batch.column(2).to_numpy()
        for owner, at, back in _pieces(batch.column(0).to_pylist()):
            first, of, _ = _grouped(_packed(back, 0, ORDERS))
            rows = [np.bincount(of, np.where(label[owner] == x, n[owner], 0), len(first)).astype(np.int64) for x in (0, 1)]
            yield pa.record_batch([_text(back[:, first], at[first]), *map(pa.array, rows)], names=["key", "n0", "n1"])


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of columns of numbers: the first place of each distinct column, the distinct column of each place, and how often each occurs."""
    order = np.lexsort(rows[::-1])
    new = np.ones(len(order), bool)
    new[1:] = (rows[:, order[1:]] != rows[:, order[:-1]]).any(axis=0)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of, np.bincount(of)


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sixes of each URL (uid, url, label, n), with its label and rows: how often each occurs, and how often its runs and contexts do in a judged URL, null if once each."""
    for batch in batches:
        uids, urls, labels, rows = batch.column(0), batch.column(1).to_pylist(), batch.column(2), batch.column(3)
        judged = labels.is_valid().to_numpy(zero_copy_only=False)
        whole: list[tuple[np.ndarray, ...]] = []

        def out(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            owner, at, back = (np.concatenate([p[i] for p in parts], axis=-1) for i in range(3))
            of_url = lambda low, high: _grouped(np.vstack([owner, _packed(back, low, high)]))
            first, _, times = of_url(0, ORDERS)
            known = judged[owner[first]]
            own = np.ones((len(first), 2 * ORDERS), np.int32)
            if known.any():
                for i in range(2 * ORDERS):
                    _, of, n = of_url(0, i + 1) if i < ORDERS else of_url(1, i - ORDERS + 1)
                    own[:, i] = np.where(known, n[of[first]], 1)
            many = (own != 1).any(axis=1)
            ends = np.concatenate([[0], np.cumsum(np.where(many, 2 * ORDERS, 0))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own[many].ravel()), mask=pa.array(~many))
            of = pa.array(owner[first])
            return pa.record_batch([uids.take(of), labels.take(of), rows.take(of), _text(back[:, first], at[first]), pa.array(times), lists], names=["uid", "label", "n", "key", "times", "own"])

        for part in _pieces(urls):
            # pieces of one judged URL stay together: its own counts are of all of it
            if whole and (part[0][0] != whole[-1][0][-1] or not judged[part[0][0]]):
                yield out(whole)
                whole = []
            whole.append(part)
        if whole:
            yield out(whole)


def _with_counts_of_ends(rows: DataFrame, text: Column, longest: int, into: tuple[str, str]) -> DataFrame:
    """Adds, as two arrays, for each end of a text of 0 to ``longest`` characters the sums of n0 and n1 over the rows whose texts have the same end.

    Rows are dealt by their ends of three characters and sorted once; the sums of longer ends are windows within. Those of
    shorter ends come from the table of ends of two characters, of which there are few.
    """
    kinds, far = (0, 1), range(3, longest + 1)
    short = rows.groupBy(F.right(text, F.lit(2)).alias("_e2")).agg(*[F.sum(f"n{x}").alias(f"_s2{x}") for x in kinds])
    by_last = W.partitionBy(F.right("_e2", F.lit(1)))
    short = cut(short.withColumns({f"_s1{x}": F.sum(f"_s2{x}").over(by_last) for x in kinds}))
    every = short.agg(*[F.coalesce(F.sum(f"_s2{x}"), F.lit(0)).alias(f"_s0{x}") for x in kinds])
    ended = rows.withColumns({f"_e{k}": F.right(text, F.lit(k)) for k in range(2, longest + 1)})
    dealt = ended.join(short, "_e2").crossJoin(F.broadcast(every)).repartition("_e3")
    for k in reversed(far):
        same = W.partitionBy(*[f"_e{i}" for i in range(3, k + 1)])
        dealt = dealt.withColumns({f"_s{k}{x}": F.sum(f"n{x}").over(same) for x in kinds})
    return dealt.select(*rows.columns, *[F.array(*[f"_s{k}{x}" for k in range(longest + 1)]).alias(into[x]) for x in kinds])


def likelihood_differences(urls: DataFrame) -> DataFrame:
    """From distinct URLs (url, label: 1 accepted, 0 rejected, null neither; n: their rows), adds ``difference``: log-likelihood as accepted
    less that as rejected, by character, and ``held``: the same by the counts less the URL's own, null where it has no label.

    Of a label with one URL only a fifth of its counts is left out, as nothing else would be known of it. Parts are
    added up as whole numbers of 10^-9, so that reruns agree.
    """
    ship(urls.sparkSession)
    known = cut(urls.withColumn("uid", F.monotonically_increasing_id()))
    kinds = {r["label"]: r["urls"] for r in known.where(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("urls")).collect()}
    share = [0.2 if kinds.get(label) == 1 else 1.0 for label in (0, 1)]
    sixes = known.select("url", "label", "n").mapInArrow(_sixes, "key string, n0 long, n1 long")
    sixes = cut(sixes.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    # the counts of a run of k characters are those of the ends of k characters, of a context those of what is before the last
    before_last = F.left(F.col("key"), F.length("key") - 1)
    counted = _with_counts_of_ends(_with_counts_of_ends(sixes, F.col("key"), ORDERS, ("c0", "c1")), before_last, ORDERS - 1, ("d0", "d1"))
    counted = cut(counted.drop("n0", "n1"))
    used = known.select("uid", "url", "label", "n").mapInArrow(_uses, "uid long, label int, n long, key string, times long, own array<int>")
    rows = used.join(counted, "key")

    def likelihood(label: int, held: bool) -> Column:
        p = F.lit(1 / 256)
        for k in range(ORDERS):
            run, context = F.get(f"c{label}", F.lit(k + 1)).cast("double"), F.get(f"d{label}", F.lit(k)).cast("double")
            if held:
                own = lambda kind: F.when(F.col("label") == label, F.col("n") * share[label] * F.coalesce(F.get("own", F.lit(kind)), F.lit(1))).otherwise(0.0)
                run, context = run - own(k), context - own(k + ORDERS)
            p = (run + STRENGTH * p) / (context + STRENGTH)
        return p

    part = lambda held: F.round(F.log(likelihood(1, held) / likelihood(0, held)) * 1e9).cast("long") * F.col("times")
    summed = rows.groupBy("uid").agg(F.sum(part(False)).alias("all"), F.sum(F.when(F.col("label").isNotNull(), part(True))).alias("rest"))
    by_length = lambda c: F.coalesce(F.col(c), F.lit(0)) / 1e9 / F.greatest(F.length("url"), F.lit(1))
    found = known.join(summed, "uid", "left")
    return found.select("url", "label", "n", by_length("all").alias("difference"), F.when(F.col("label").isNotNull(), by_length("rest")).alias("held"))


def fit_line(x: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through counts of positives and negatives at x, slightly held to (0, 0)."""
    scale = float(np.std(np.repeat(x, 1))) or 1.0
    rows, n, w = np.stack([x / scale, np.ones_like(x)], 1), positive + negative, np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        gradient = rows.T @ (positive - n * p) - 1e-2 * w
        hessian = (rows * (n * p * (1 - p))[:, None]).T @ rows + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 2 / max(1e-9, float(np.abs(step).max())))
        if float(np.abs(step).max()) < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def calibration(scored: DataFrame) -> tuple[float, float]:
    """Slope and offset from the held-out differences of judged URLs, counted in bins; (0, 1) without both kinds."""
    place = F.least(F.greatest(F.floor((F.col("held") / SPAN + 0.5) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    table = np.zeros((2, BINS))
    for r in scored.where(F.col("label").isNotNull()).groupBy(place.alias("bin"), "label").agg(F.sum("n").alias("n")).collect():
        table[r["label"], r["bin"]] = r["n"]
    if not table[0].sum() or not table[1].sum():
        return 0.0, 1.0
    return fit_line((np.arange(BINS) + 0.5) / BINS * SPAN - SPAN / 2, table[1], table[0])


def probability(difference: Column, slope: float, offset: float) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(difference * slope + offset, F.lit(50.0)), F.lit(-50.0))))


def judge_urls(pages: DataFrame, url: str = "url", rules=RULES, prefix: str = "") -> DataFrame:
    """Adds host, path, rule, score (probability of being accepted, by the method alone) and verdict, each after ``prefix``."""
    made = unused(pages, "_host", "_path", "_ruled", "_score", "_url", also=[prefix + x for x in OUTPUTS])
    host, path, rule, score, key = made
    text = F.coalesce(F.col(url), F.lit(""))
    slim = pages.select(text.alias("url")).groupBy("url").agg(F.count("*").alias("n"))
    fits = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"]
    scored = cut(likelihood_differences(slim.withColumn("label", F.when(fits.isNotNull(), (fits == "allow").cast("int")))))
    slope, offset = calibration(scored)
    known = scored.select(F.col("url").alias(key), probability(F.col("difference"), slope, offset).alias(score))
    parts = pages.join(known, text == F.col(key)).withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))})
    judged = parts.withColumn(rule, rule_of(F.col(host), F.col(path), rules))
    outputs = {
        "host": F.col(host),
        "path": F.col(path),
        "rule": F.col(rule)["rule"],
        "score": F.col(score),
        "verdict": F.coalesce(F.col(rule)["verdict"], F.when(F.col(score) >= 0.5, F.lit("allow")).otherwise(F.lit("block"))),
    }
    return judged.withColumns({prefix + name: c for name, c in outputs.items()}).drop(*made)
