"""A corpus pipeline: each stage judges all that its predecessor kept, and is written before the next reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm import decontaminate, minhash, mixing, quality_rules, toxicity
from rillstone.llm.common import table, unused, unused_prefix, with_checkpoint_dir
from rillstone.llm.queries import PREDICTED_FROM


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, with the lines that fail them taken out."""
    p = unused_prefix(docs)
    kept = quality_rules.apply_quality_rules(docs, prefix=p).where(f"{p}kept")
    clean = F.col(f"{p}clean_text")
    return kept.withColumns({"text": clean, "n_chars": F.length(clean).cast("long")}).select(docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored words don't make them likely to be toxic."""
    p = unused_prefix(docs)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, prefix=p).where(F.col(f"{p}score") < PREDICTED_FROM).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return minhash.one_of_each_class(docs).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document: its columns, its size, and a number from 1.

    Where a column of the documents is called ``size`` or ``copy``, the new one gets an underscore before its name.
    """
    p, (size, copy) = unused_prefix(docs), unused(docs, "size", "copy")
    sized = docs.withColumn(size, mixing.word_count(F.col("text")))
    mixed = mixing.mix(sized, size=size, slim=mixing.sized_documents(docs), prefix=p)
    copies = F.col(f"{p}copies").cast("int")
    return mixed.where(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns, size, copy)


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]

#: Trained scores and hashed fingerprints have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. Each stage's rows are written to the shared folder and read again.

    A stage's rows are deleted once its successor has written its own; those of the last stay, as the result is read from them.
    """
    with_checkpoint_dir(spark)
    context = spark.sparkContext
    folder = f"{context._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = context._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs
