"""Which labelled rows a model may learn from, and small fitting helpers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Is crc32 of the id as text, modulo ``folds``, equal to ``fold``? False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def in_order(rows: pd.DataFrame, kind: T.DataType, *then: str) -> pd.DataFrame:
    """Rows by their ``id``, which travels as text whatever its type is: whole numbers by value, all else as text."""
    number = isinstance(kind, T.IntegralType)
    return rows.sort_values(["id", *then], key=lambda c: c.map(int) if number and c.name == "id" else c, ignore_index=True)


def place(doc_id: Column) -> Column:
    """A number from 0 to 1 for an id, by hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(11), doc_id), 11) / F.lit(float(1 << 53))


def _limit(counts: list[tuple[int, int]], near: float, most: int, bins: int) -> float:
    """The place up to which counts by bin, of places from 0 to ``near``, are at most ``most``."""
    total = 0
    for at, n in sorted(counts):
        if total and total + n > most:
            return near * at / bins
        total += n
    return near


def place_limits(ids: DataFrame, most: int, bins: int = 4096) -> DataFrame:
    """Columns group and limit for rows (group, id): ids whose place is below their group's limit are at most ``most``, shared evenly.

    There are at most ``most`` groups, the largest first. What passes the driver is a number a group and counts of
    ids by place, of about twice ``most`` ids; no task gathers the ids themselves.
    """
    sizes = ids.groupBy("group").agg(F.approx_count_distinct("id").alias("n")).orderBy(F.desc("n"), "group").limit(most).collect()
    each = max(1, most // max(1, len(sizes)))
    near = {r["group"]: min(1.0, 2 * each / max(1, r["n"])) for r in sizes}
    kind, spark = ids.schema["group"].dataType.simpleString(), ids.sparkSession
    reach = spark.createDataFrame(list(near.items()), f"group {kind}, near double")
    there = ids.select("group", place(F.col("id")).alias("at")).join(F.broadcast(reach), "group").where(F.col("at") < F.col("near")).select("group", "near", "at").distinct()
    counted: dict = {}
    for r in there.groupBy("group", F.floor(F.col("at") / F.col("near") * bins).alias("bin")).agg(F.count("*").alias("n")).collect():
        counted.setdefault(r["group"], []).append((r["bin"], r["n"]))
    return spark.createDataFrame([(g, _limit(found, near[g], each, bins)) for g, found in counted.items()], f"group {kind}, limit double")


def bounded_sample(labels: DataFrame, doc_id: str, label: str, most: int, held: Column, bins: int = 4096) -> DataFrame:
    """Id and label of at most ``most`` labelled rows outside the held-out fold, first by hash of the id.

    Its size is bounded by ``most``, so it can be broadcast. An id with several labels counts as its greatest. What
    passes the driver is a number, and counts of about twice ``most`` ids by place.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label"))
    n = known.agg(F.approx_count_distinct("_id").alias("n")).first()["n"]
    near = min(1.0, 2 * most / max(1, n))
    there = known.select(place(F.col("_id")).alias("at")).where(F.col("at") < near).distinct()
    counts = there.groupBy(F.floor(F.col("at") / near * bins).alias("bin")).agg(F.count("*").alias("n")).collect()
    limit = _limit([tuple(r) for r in counts], near, most, bins)
    return known.where(place(F.col("_id")) < limit).groupBy("_id").agg(F.max("_label").alias("_label"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(rows: np.ndarray, y: np.ndarray, ridge: float, weight: np.ndarray | None = None, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression with an L2 penalty, by Newton's method with shortened steps."""
    w = np.zeros(rows.shape[1])
    n = np.ones(len(y)) if weight is None else weight
    for _ in range(steps):
        p = sigmoid(rows @ w)
        step = np.linalg.solve((rows * (n * p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(w)), rows.T @ (n * (y - p)) - ridge * w)
        w += step * min(1.0, 3 / max(1e-9, float(np.abs(step).max())))
        if float(np.abs(step).max()) < 1e-7:
            break
    return w
