"""Quality scores by Bradley-Terry ranking.

Pairs of one better and one worse document are drawn from labelled rows. The
chance that the better one wins is the logistic function of the difference of
their scores; scores are linear in features of style, so the weights come from a
logistic loss on differences of features. A second logistic curve turns scores
into probabilities, and a quantile of all documents' scores is the threshold.

Bounds: at most ``SAMPLE`` labelled documents (first by hash of the id) and
``PAIRS`` pairs. Features read whole texts.

Defined results: null text counts as empty; an empty text has features of 0; a
blank one counts as one without a word repeated; texts of any length are read
whole; without labels of both kinds, as in an empty table, scores are 0.5; repeated
rows score alike; an id with several labels counts as its greatest, one with several
texts as that whose features come first. Further columns pass through; one that has
the name of an output is replaced, unless ``prefix`` sets the outputs apart.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, unused
from .labelled import bounded_sample, in_fold, in_order, logistic

SAMPLE = 20_000
PAIRS = 60_000
FEATURES = (
    "symbols", "exclaims", "bars", "upper", "digits", "spaces", "stops", "word_length", "distinct", "twice", "top_word", "log_words", "dup_lines", "long_words", "lines"
)


def features(text: str) -> list[float]:
    chars = len(text)
    if not chars:
        return [0.0] * len(FEATURES)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    count = text.count
    symbols = sum(map(count, "#*$%&<>{}[]~^=@\\"))
    upper = sum(map(str.isupper, words))
    kinds = len(set(words))
    top = Counter(words).most_common(1)[0][1] if 0 < kinds < n * 0.9 else 1
    return [
        min(1.0, 20 * symbols / chars), min(1.0, 20 * count("!") / chars), min(1.0, 20 * count("|") / chars), upper / n,
        min(1.0, 20 * sum(map(count, "0123456789")) / chars), (len(words) - 1) / chars, min(1.0, count(".") / n * 4), min(2.0, (chars - n + 1) / n / 10),
        kinds / n, sum(map(eq, words, words[1:])) / n, top / n, np.log1p(len(words)) / 10, 1 - len(set(lines)) / m, sum(len(w) > 20 for w in words) / n, min(1.0, m / n * 5),
    ]


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def utility(self, texts: list[str]) -> np.ndarray:
        rows = np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))
        return (rows - self.mean) / self.scale @ self.weights


def learn(rows: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 1) -> QualityModel:
    k = rows.shape[1] if len(rows) else len(FEATURES)
    good, bad = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
    if not len(good) or not len(bad):
        return QualityModel(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 0.0)
    mean, scale = rows.mean(0), rows.std(0) + 1e-6
    z = (rows - mean) / scale
    rng = np.random.default_rng(seed)
    better, worse = rng.choice(good, pairs), rng.choice(bad, pairs)
    turned = np.where(rng.random(pairs) < 0.5, 1.0, -1.0)  # half of the pairs the other way round
    weights = logistic((z[better] - z[worse]) * turned[:, None], (turned > 0).astype(float), 3.0)
    line = logistic(np.stack([z @ weights, np.ones(len(z))], 1), (y > 0).astype(float), 1e-2)
    return QualityModel(mean, scale, weights, float(line[0]), float(line[1]))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, fold: int = 0, sample: int = SAMPLE) -> QualityModel:
    ship(docs.sparkSession)
    docs = docs.select(doc_id, text)
    held = in_fold(F.col(doc_id), folds, fold)
    chosen = bounded_sample(labels, doc_id, label, sample, held)
    rows = docs.where(~held).join(F.broadcast(chosen), F.col(doc_id) == F.col("_id")).select(F.col("_id").cast("string").alias("_id"), "_label", F.coalesce(F.col(text), F.lit("")).alias("body"))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["_id"], "y": pdf["_label"], "x": [features(t) for t in pdf["body"]]})

    # one row an id, in a fixed order: at most ``sample`` rows of a few numbers
    found = rows.mapInPandas(describe, "id string, y int, x array<double>").groupBy("id").agg(F.max("y").alias("y"), F.min("x").alias("x")).toPandas()
    found = in_order(found, docs.schema[doc_id].dataType)
    x = np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES))
    return learn(x, found["y"].to_numpy(int))


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds, after ``prefix``, ``utility`` (the score of the ranking) and ``score`` (the probability that the quality is good)."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def utility(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.utility([t or "" for t in texts]))

    (raw,) = unused(docs, "_utility", also=[f"{prefix}utility", f"{prefix}score"])
    line = F.lit(model.slope) * F.col(raw) + F.lit(model.offset)
    score = 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(40.0)), F.lit(-40.0))))
    return docs.withColumn(raw, utility(F.col(text))).withColumns({f"{prefix}utility": F.col(raw), f"{prefix}score": score}).drop(raw)


def above_quantile(scored: DataFrame, quantile: float, utility: str = "utility", kept: str = "kept") -> DataFrame:
    """Adds ``kept``: is the utility at least this quantile of all documents' utilities? All ties with the limit are kept."""
    limit = scored.agg(F.percentile_approx(utility, quantile, 10_000)).first()[0]
    return scored.withColumn(kept, F.col(utility) >= F.lit(limit if limit is not None else 0.0))
