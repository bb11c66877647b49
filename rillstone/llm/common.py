"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, running, with_checkpoint_dir  # noqa: F401

#: A word is a longest run of characters other than these (regular expression class body).
SPACE = r"\x20\x09-\x0D"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """All words of the text, in order; an empty array for null or blank text.

    White space becomes blanks first: Java splits at one literal character without its regular expressions.
    """
    blanks = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        blanks = F.replace(blanks, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(blanks, " "), "")


def word_hashes(text: Column) -> Column:
    """A 64-bit hash for each word of the text."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingles(hashes: Column, width: int) -> Column:
    """64-bit hashes of all runs of ``width`` words, in order of position, from the hashes of the words."""
    run = lambda h, i: F.xxhash64(*[F.get(h, i + k if k else i) for k in range(width)])
    return let(
        hashes,
        lambda h: F.when(F.size(h) < width, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: run(h, i))
        ),
    )


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that stand for the id and the text of a row, with nulls told apart from values."""
    parts = [doc_id.isNull(), doc_id, text.isNull(), text]
    return F.struct(F.xxhash64(*parts).alias("high"), F.xxhash64(F.lit(1), *parts[::-1]).alias("low"))


def unused(df: DataFrame, *names: str, also: Iterable[str] = ()) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of ``df`` and none of ``also``, in either case."""
    taken, found = {c.lower() for c in [*df.columns, *also]}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def unused_prefix(df: DataFrame) -> str:
    """As many underscores as it takes for no column of ``df`` to begin with them."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Gives the executors this package, as ``--py-files`` would, once for an application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark
