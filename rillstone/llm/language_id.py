"""Language identification in two levels.

A linear model first picks the family of a text's language; within the family,
linear support vector machines for each pair of languages vote. Features are
hashed runs of one to three letters of the whole text.

Bounds: at most ``SAMPLE`` documents are learned from, shared evenly among the
languages, first by hash of the id within each; so at most as many languages are
learned, the most frequent.

Defined results: a text that is null or has no letter is ``und`` with score 0;
texts of any length are read whole; languages outside the family table are families
of their own; with one language learned every other text is that one; with none, as
in an empty table, ``und``; repeated rows agree; equal votes go to the language that
comes first. Further columns pass through; one that has the name of an output is
replaced, unless ``prefix`` sets the outputs apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, unused
from .labelled import in_fold, in_order, place, place_limits

SAMPLE = 6_000
DIMENSIONS = 2048
#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "semitic": "ar he mt am",
    "turkic": "tr az kk uz tk ky",
    "indic": "hi bn ur pa gu mr ne",
    "sinitic": "zh yue",
    "baltic": "lt lv",
    "celtic": "ga cy gd br",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], f"only {lang}")


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length of hashed letter runs, and whether a text has a letter."""
    rows, lettered = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter(codes)
        lettered[i] = bool(letter.any())
        if not lettered[i]:
            continue
        c = np.where(letter, codes, np.uint32(32))
        c = np.concatenate([np.array([32], np.uint32), c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))], np.array([32], np.uint32)])
        one = c * np.uint32(2654435761)
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + one[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + one[2:]
        at = np.concatenate([one, two * np.uint32(0x9E3779B1), three * np.uint32(0x9E3779B1)]) >> np.uint32(21)
        row = np.sqrt(np.bincount(at, minlength=DIMENSIONS))
        rows[i] = row / np.sqrt((row * row).sum())
    return rows, lettered


_LETTER = np.array([chr(i).isalpha() for i in range(0x3000)])


def _is_letter(codes: np.ndarray) -> np.ndarray:
    """Letters by table below U+3000; above, letters by character."""
    low = _LETTER[np.minimum(codes, len(_LETTER) - 1)] & (codes < len(_LETTER))
    for i in np.flatnonzero(codes >= len(_LETTER)):
        low[i] = chr(codes[i]).isalpha()
    return low


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 50.0, steps: int = 120) -> np.ndarray:
    """Weights (the last an offset) of a squared-hinge support vector machine, by accelerated gradient steps. y: 1 or -1."""
    rows = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    # single precision throughout: mixed types would copy the rows at every step
    y = y.astype(rows.dtype)
    share = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())).astype(rows.dtype)
    w = v = np.zeros(rows.shape[1], rows.dtype)
    rate = rows.dtype.type(1 / (1 + 2 * cost * 2 * 2))
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (rows @ v))
        new = v - rate * (v - rows.dtype.type(2 * cost) * (rows.T @ (share * slack * y)))
        v = new + rows.dtype.type(k / (k + 3)) * (new - w)
        w = new
    return w


@dataclass(frozen=True)
class LanguageModel:
    families: list[str]
    languages: dict[str, list[str]]
    family_weights: np.ndarray  # a row each family
    pair_weights: dict[tuple[str, str], np.ndarray]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        x, lettered = vectors(texts)
        if not self.families:
            return ["und"] * len(texts), np.zeros(len(texts))
        rows = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        margins = rows @ self.family_weights.T
        chosen, odds = margins.argmax(1), np.exp(3 * (margins - margins.max(1, keepdims=True)))
        sure = odds.max(1) / odds.sum(1)
        out, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        for f, family in enumerate(self.families):
            mine = np.flatnonzero((chosen == f) & lettered)
            if not len(mine):
                continue
            langs = self.languages[family]
            votes, won = np.zeros((len(mine), len(langs))), np.zeros((len(mine), len(langs)))
            for a, b in combinations(range(len(langs)), 2):
                m = rows[mine] @ self.pair_weights[langs[a], langs[b]]
                p = 1 / (1 + np.exp(-3 * m))
                votes[:, a] += m > 0
                votes[:, b] += m <= 0
                won[:, a] += p
                won[:, b] += 1 - p
            best = (votes + won / (len(langs) + 1)).argmax(1)
            out[mine] = np.array(langs, object)[best]
            score[mine] = sure[mine] * (won[np.arange(len(mine)), best] / max(1, len(langs) - 1) if len(langs) > 1 else 1.0)
        return list(out), np.clip(score, 0, 1)


def learn(x: np.ndarray, lang: np.ndarray) -> LanguageModel:
    languages: dict[str, list[str]] = {}
    for code in sorted(set(lang)):
        languages.setdefault(family_of(code), []).append(code)
    families = sorted(languages)
    of = np.array([family_of(c) for c in lang], object)
    family_weights = np.array([linear_svm(x, np.where(of == f, 1.0, -1.0)) for f in families]) if len(families) > 1 else np.ones((len(families), x.shape[1] + 1))
    pairs = {}
    for langs in languages.values():
        for a, b in combinations(langs, 2):
            mine = (lang == a) | (lang == b)
            pairs[a, b] = linear_svm(x[mine], np.where(lang[mine] == a, 1.0, -1.0))
    return LanguageModel(families, languages, family_weights, pairs)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, fold: int = 0, sample: int = SAMPLE) -> LanguageModel:
    ship(docs.sparkSession)
    seen = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~in_fold(F.col(doc_id), folds, fold))
    known = seen.select(F.col(lang).alias("group"), F.col(doc_id).alias("id"), F.col(text).alias("body"))
    limits = place_limits(known.select("group", "id"), sample)
    rows = known.join(F.broadcast(limits), "group").where(place(F.col("id")) < F.col("limit")).select(F.col("id").cast("string").alias("id"), F.col("group").alias("lang"), "body")

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 200):
                part = pdf.iloc[i : i + 200]
                x, lettered = vectors(list(part["body"]))
                found = np.flatnonzero(lettered)
                yield pd.DataFrame({"id": part["id"].iloc[found], "lang": part["lang"].iloc[found], "x": [x[j].astype(np.float16).tobytes() for j in found]})

    # one row for an id and language, however often it is repeated: at most ``sample`` rows reach the driver
    found = rows.mapInPandas(describe, "id string, lang string, x binary").groupBy("id", "lang").agg(F.min("x").alias("x")).toPandas()
    found = in_order(found, docs.schema[doc_id].dataType, "lang")
    x = np.frombuffer(b"".join(found["x"]), np.float16).astype(np.float32).reshape(-1, DIMENSIONS)
    return learn(x, found["lang"].to_numpy(object))


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds lang_pred and score, after ``prefix``."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = [], []
        for i in range(0, len(texts), 500):
            a, b = shared.value.predict([t or "" for t in texts.iloc[i : i + 500]])
            langs += a
            scores.append(b)
        return pd.DataFrame({"lang_pred": langs, "score": np.concatenate(scores) if scores else []})

    (found,) = unused(docs, "_found", also=[f"{prefix}lang_pred", f"{prefix}score"])
    return docs.withColumn(found, predict(F.col(text))).withColumns({prefix + x: F.col(found)[x] for x in ("lang_pred", "score")}).drop(found)
