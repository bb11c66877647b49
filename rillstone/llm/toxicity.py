"""Toxicity scoring of text restored through a noisy channel.

Disguised words (digits and signs for letters, stretched or spaced letters) are
read as a lattice: each character stands for itself, for letters it resembles, or
for nothing; a space between spaced letters for nothing or for the end of a word. A character language model of the corpus, with a cost for each
change, picks the likeliest path by the Viterbi algorithm. Words that hold nothing to
restore have one path and are taken as they are. The restored words and their
stems are scored by weights learned from labelled documents.

Bounds: labels are learned from at most ``SAMPLE`` labelled documents (first by
hash of the id), and by all words of theirs that tell enough. The language model
counts every character of every document.

Defined results: null text counts as empty; an empty text scores as one without
telling words; without labels of both kinds, as in an empty table, every score is 0
but for rounding; texts and words of any length are read whole; repeated rows score
alike; an id with several labels counts as its greatest, and each of its texts is
learned from; between readings of equal cost the first in the lattice is taken.
Further columns pass through; one that has the name of the output is replaced,
unless ``prefix`` sets it apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship
from .labelled import bounded_sample, in_fold, logistic, sigmoid

SAMPLE = 30_000
SIZE = 64  # of the model's alphabet: 0 a boundary, 1 to 26 the letters a to z, 27 to 62 other letters by code, 63 the rest
#: The letters that a sign can stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h", "%": "", "&": ""}
#: Signs that only part the letters of a disguised word.
PARTS = ".-_*~/\\,'"
#: Marks that can stand around a word without being part of it.
MARKS = ".,;:?!\"'()[]{}<>*#%&|-_~=/\\"
SWAP, DROP_PART, DROP_REPEAT, DROP_SIGN = 1.0, 0.2, 0.4, 4.0

_CLEAR = "".join(m for m in MARKS if not LOOKS.get(m))  # marks that are like no letter
_RUN = re.compile(r"(\w)\1\1")
_STRETCH = re.compile(r"([^\W\d_])\1{3,}")
_SPACED = re.compile(r"(?:(?<=\s)|\A)(?:[^\W\d_]|[013457@$!])(?:[ \t][^\W_]|[ \t][@$!]){3,}(?=[\s.,;:?]|\Z)")


def alphabet(codes: np.ndarray) -> np.ndarray:
    """Classes of code points of lower-case text."""
    out = np.full(len(codes), 63, np.int64)
    white = (codes == 32) | ((codes >= 9) & (codes <= 13))
    latin = (codes >= 97) & (codes <= 122)
    out[latin] = codes[latin] - 96
    other = (codes >= 0xAA) & (codes != 0xD7) & (codes != 0xF7)
    out[other] = 27 + codes[other] % 36
    out[white] = 0
    return out


def _count_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    table = np.zeros(SIZE**3, np.int64)
    for pdf in batches:
        for body in ("".join(f" {t}" for t in part) for part in _parts(pdf["body"])):
            c = alphabet(np.frombuffer(body.lower().encode("utf-32-le"), np.uint32).astype(np.int64))
            if len(c) > 2:
                table += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
    used = np.flatnonzero(table)
    yield pd.DataFrame({"run": used, "n": table[used]})


def _parts(texts: pd.Series, most: int = 2_000_000) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-probabilities of a character after two others, from all documents; a table of fixed size."""
    ship(docs.sparkSession)
    body = docs.select(F.coalesce(F.col(text), F.lit("")).alias("body"))
    runs = body.mapInPandas(_count_runs, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).toPandas()
    three = np.zeros(SIZE**3)
    three[runs["run"].to_numpy(np.int64)] = runs["n"].to_numpy(float)
    three = three.reshape(SIZE, SIZE, SIZE)
    one = three.sum((0, 1)) + 1
    two = three.sum(0) + 5 * (one / one.sum())
    two /= two.sum(1, keepdims=True)
    three = three + 5 * two[None]
    return np.log(three / three.sum(2, keepdims=True)).astype(np.float32)


def restore(word: str, model: np.ndarray) -> str:
    """The likeliest letters behind a word, by Viterbi search over its lattice; in a run of spaced letters, the likeliest words.

    Marks at the edges are dropped at the price of parts, but for ``!`` before a word, where none is written. Digits
    of a word without letters can also stand for themselves, and are not dropped.
    """
    number = not any(map(str.isalpha, word))
    first, last = len(word) - len(word.lstrip(MARKS)), len(word.rstrip(MARKS))
    states: dict = {(0, 0): (0.0, None)}  # the last two classes written: cost, and the letters so far as a chain from the last to the first
    for i, ch in enumerate(word):
        options = []
        if ch.isalpha():
            options.append((ch, 0.0, _class(ch)))
        else:
            options += [(x, SWAP, _class(x)) for x in LOOKS.get(ch, "")]
            if number and ch.isalnum():
                options.append((ch, 0.0, _class(ch)))
            else:
                at_edge = i >= last or i < first and ch != "!"
                options.append(("", DROP_PART if at_edge or ch in PARTS or ch.isspace() else DROP_SIGN, 0))
            if ch.isspace():
                options.append((" ", DROP_PART, 0))
        after: dict = {}
        for (a, b), (cost, done) in states.items():
            for letter, price, c in options:
                if letter:
                    new, total, key = (done, letter), cost + price - float(model[a, b, c]), (b, c)
                else:
                    new, total, key = done, cost + price, (a, b)
                if key not in after or total < after[key][0]:
                    after[key] = (total, new)
                if letter.isalpha() and done and done[1] == letter and not (number and ch.isalnum()) and cost + price + DROP_REPEAT < after.get((a, b), (np.inf,))[0]:
                    after[(a, b)] = (cost + price + DROP_REPEAT, done)
        states = after
    _, done = min(((cost - float(model[a, b, 0]), done) for (a, b), (cost, done) in states.items()), key=lambda s: s[0])
    letters = []
    while done:
        done, letter = done
        letters.append(letter)
    return "".join(reversed(letters))


def _class(letter: str) -> int:
    o = ord(letter)
    return o - 96 if 97 <= o <= 122 else 27 + o % 36 if o >= 0xAA else 63


@dataclass
class Restorer:
    """Restores the words of texts."""

    model: np.ndarray

    def word(self, raw: str) -> str:
        core = raw.strip(_CLEAR)
        if core.isalpha() and not _RUN.search(core):
            return core
        start, end = 0, len(core)
        while start < end and not (core[start].isalnum() or LOOKS.get(core[start])):
            start += 1
        while start < end and not (core[end - 1].isalnum() or LOOKS.get(core[end - 1])):
            end -= 1
        core = core[start:end]
        if not core or core.isalpha() and not _RUN.search(core):
            return core
        return restore(_STRETCH.sub(r"\1\1\1", core), self.model)

    def spaced(self, text: str, found: list[str]) -> Iterator[str]:
        """Words whose letters stand apart, looked for where four single characters follow each other.

        A space in a run is nothing or the end of a word, so a run can hold many words. For words that the corpus
        doesn't hold and that look like two, neighbours are also read as one word, and so is the whole run.
        """
        if b"\1\1\1\1" in bytes([n == 1 for n in map(len, found)]):
            for m in _SPACED.finditer(text):
                parts = restore(m.group(0), self.model).split()
                yield from parts
                yield from map("".join, zip(parts, parts[1:]))
                yield restore("".join(m.group(0).split()), self.model)


def tells(word: str) -> list[str]:
    """What a restored word can tell by: itself, and the stems that it begins with."""
    return [word, *(f"{word[:n]}-" for n in (4, 5) if len(word) > n)] if word else []


def restored_words(text: str, restorer: Restorer) -> set[str]:
    lower = text.lower()
    found = lower.split()
    return {x for w in {*map(restorer.word, set(found)), *restorer.spaced(lower, found)} for x in tells(w)}


@dataclass(frozen=True)
class ToxicityModel:
    letters: np.ndarray
    weights: dict[str, float]
    slope: float
    offset: float


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 4, fold: int = 2, sample: int = SAMPLE) -> ToxicityModel:
    docs = docs.select(doc_id, text)
    spark = docs.sparkSession
    letters = character_model(docs, text)
    shared = spark.sparkContext.broadcast(letters)
    chosen = bounded_sample(labels, doc_id, label, sample, in_fold(F.col(doc_id), folds, fold))
    held = in_fold(F.col(doc_id), folds, fold)
    rows = docs.where(~held).join(F.broadcast(chosen), F.col(doc_id) == F.col("_id")).select("_label", F.coalesce(F.col(text), F.lit("")).alias("body"))

    def restored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(shared.value)
        for pdf in batches:
            for i in range(0, len(pdf), 100):
                part = pdf.iloc[i : i + 100]
                yield pd.DataFrame({"y": part["_label"], "words": [list(restored_words(body, restorer)) for body in part["body"]]})

    # the words of the sample, restored once and written
    read = cut(rows.mapInPandas(restored, "y int, words array<string>"))
    total = read.agg(F.count_if(F.col("y") > 0).alias("yes"), F.count("*").alias("all")).first()
    yes, no = total["yes"], total["all"] - total["yes"]
    if not yes or not no:
        return ToxicityModel(letters, {}, 0.0, -40.0)
    counts = read.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("y") <= 0).alias("no"), F.count_if(F.col("y") > 0).alias("yes"))
    p, q = F.col("yes") / yes, F.col("no") / no
    pooled = (F.col("yes") + F.col("no")) / (yes + no)
    told = (p - q) / F.sqrt(pooled * (1 - pooled + 1e-9) * (1 / yes + 1 / no))
    kept = counts.where((F.col("yes") + F.col("no") >= 3) & (F.abs(told) >= 5)).toPandas().sort_values("word")
    weight = np.log((kept["yes"] + 0.5) / (yes + 1)) - np.log((kept["no"] + 0.5) / (no + 1))
    weights = dict(zip(kept["word"], weight.astype(float), strict=True))
    model = spark.sparkContext.broadcast(weights)

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = model.value.get
        for pdf in batches:
            best = [max([0.0, *(get(w, 0.0) for w in found)]) for found in pdf["words"]]
            yield pd.DataFrame({"bin": [round(x * 8) for x in best], "y": pdf["y"]})

    curve = read.mapInPandas(bins, "bin int, y int").groupBy("bin").agg(F.count_if(F.col("y") > 0).alias("yes"), F.count("*").alias("n")).toPandas()
    x = np.stack([curve["bin"] / 8, np.ones(len(curve))], 1)
    x, y, n = np.repeat(x, 2, 0), np.tile([1.0, 0.0], len(curve)), np.stack([curve["yes"], curve["n"] - curve["yes"]], 1).ravel().astype(float)
    w = logistic(x, y, 1e-2, n)
    return ToxicityModel(letters, weights, float(w[0]), float(w[1]))


class Scorer(dict):
    """Scores texts with one model. Itself the store, of bounded size, of the weights of words it has met."""

    STORE = 400_000

    def __init__(self, model: ToxicityModel):
        self.weights, self.restorer = model.weights, Restorer(model.letters)

    def __missing__(self, raw: str) -> float:
        found = self[raw] = self.weight(self.restorer.word(raw))
        return found

    def weight(self, word: str) -> float:
        get = self.weights.get
        return max(get(word, 0.0), get(f"{word[:4]}-", 0.0) if len(word) > 4 else 0.0, get(f"{word[:5]}-", 0.0) if len(word) > 5 else 0.0)

    def raw(self, text: str) -> float:
        """The weight of the most telling word: sums of weak signs would grow with the length of a text and with its language."""
        lower = text.lower()
        found = lower.split()
        best = max(map(self.__getitem__, set(found)), default=0.0)
        if len(self) > self.STORE:
            self.clear()
        return max([best, *map(self.weight, self.restorer.spaced(lower, found))])


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds ``score``, after ``prefix``: the probability that a document is toxic."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            raw = np.array([scorer.raw(t or "") for t in texts], float)
            yield pd.Series(sigmoid(shared.value.slope * raw + shared.value.offset))

    return docs.withColumn(f"{prefix}score", toxic(F.col(text)))
