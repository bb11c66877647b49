"""Where long plans are cut, and sums along an order of a whole table that need no task to hold it."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Sets a checkpoint folder of our own only where the session names none: in a shared warehouse, or on one machine in a temporary folder.

    A cluster without a shared folder is refused: what executors write to their own disks is lost with them. Sessions that
    set ``spark.cleaner.referenceTracking.cleanCheckpoints`` have files deleted once nothing refers to them.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir", "")
        if not named and re.fullmatch(r"local(\[.*\])?", context.master):
            named = tempfile.mkdtemp(prefix="checkpoint-")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not named and re.match(r"(file:|/)", warehouse):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        context.setCheckpointDir(named or f"{warehouse}/_checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: they are written to the shared checkpoint folder and read back."""
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each row, the sums over all rows before it in ``order``; ``F.lit(1)`` gives its place from 0.

    Rows are dealt to ranges of the order. Each range sums along itself and adds the totals of the ranges before it, of
    which there are as many as shuffle partitions. Rows equal in ``order`` may stand in any sequence.
    """
    part, *names = [f"__{x}" for x in ("part", *sums)]
    dealt = cut(df.repartitionByRange(*order).withColumns({part: F.spark_partition_id(), **dict(zip(names, sums.values(), strict=True))}))
    totals = dealt.groupBy(part).agg(*[F.sum(n).alias(n) for n in names])
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(part, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_start") for n in names])
    within = W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = dealt.withColumns({n: F.coalesce(F.sum(n).over(within), F.lit(0)) for n in names})
    found = inside.join(F.broadcast(starts), part)  # a row for each range
    return found.withColumns({name: F.col(n) + F.col(f"{n}_start") for name, n in zip(sums, names, strict=True)}).drop(part, *names, *[f"{n}_start" for n in names])
