"""Mixing sources to target weights by systematic sampling.

Sources share a budget of words by weight; no target passes a multiple of its
source's size, and what is cut off goes to the other sources by weight. Within a
source each document is expected target/size times; the running sum of these
expectations, moved by one random offset of the source, crosses whole numbers,
and a document is taken once for each number it crosses.

Offsets and the order of equal sizes come from MD5 of the source and of the id, so
any engine can repeat them.

Defined results: null text has size 0; documents of size 0 take part like any
other and add nothing; null source is a source of its own, last in order; texts of
any length count whole; repeated rows are documents of their own, which of them is
taken once more is a tie that changes no column; an empty table gives an empty
result. Further columns pass through; one that has the name of an output is
replaced, unless ``prefix`` sets the outputs apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, cut, running, unused

#: Parts into which equal sizes of one source are dealt, so that no source or size is one task's work.
SALTS = 256
#: What the outputs of ``mix`` are called.
OUTPUTS = ("source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, source: str, size: str, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Columns ``src``, ``source_size`` and ``target``: by weight, none above ``most`` times its size, the excess reshared by weight.

    Let sources fill up in the order of size by weight. If the first k were full, the rest would get ``unit`` words for
    each weight. This grows with k as long as the next source can't hold its part, and falls from there: so the
    greatest unit of all is the right one, and a source gets its weight times that, or all it may.
    """
    of = sized.groupBy(F.col(source).alias("src")).agg(F.sum(size).alias("source_size"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("nth", F.lit(len(weights))).cast("int"))
    ranked = running(of, [F.col("src").asc_nulls_last()], {"nth": F.lit(1)}).withColumn("weight", weight)
    fills = [(F.col("source_size") / F.col("weight")).asc(), F.col("nth").asc()]
    filled = cut(running(ranked, fills, {"size_before": F.col("source_size"), "weight_before": F.when(F.col("source_size") > 0, F.col("weight")).otherwise(F.lit(0.0))}))
    some = filled.where(F.col("source_size") > 0)
    total = some.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    left = F.lit(float(share)) * F.lit(total["size"] or 0) - F.lit(float(most)) * F.col("size_before")
    unit = some.agg(F.max(left / (F.lit(total["weight"] or 1.0) - F.col("weight_before"))).alias("unit")).first()["unit"]
    target = F.when(F.col("source_size") > 0, F.least(F.col("weight") * F.lit(unit or 0.0), F.lit(float(most)) * F.col("source_size"))).otherwise(F.lit(0.0))
    return filled.select("src", "source_size", target.alias("target"))


def mix(
    sized: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    size: str = "size",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    slim: DataFrame | None = None,
    prefix: str = "",
) -> DataFrame:
    """Adds source_size, target, copies and taken (words), each after ``prefix``, to documents with a column of their size.

    Places within a source come from two levels of counts: documents are dealt to
    cells of (source, class of size, salt), counts of cells are summed along the
    source, and places within a cell are numbered by size. Cells bound what one
    task sorts, and the classes of size spread the taken copies evenly over sizes.
    ``slim``: the same documents with columns doc_id, source and size only, where reading them
    again from ``sized`` would be dear.
    """
    made = unused(sized, "_src", "_class", "_salt", "_order", "_row", "_place", "_size", "_target", "_copies", "_start", also=[prefix + x for x in OUTPUTS])
    src, kind, salt, order, row, place, source_size, target, copies, start = made
    cell = [src, kind, salt]

    def celled(df: DataFrame, doc_id: str, source: str, size: str) -> DataFrame:
        digits = F.bin(F.col(size))
        return df.withColumns(
            {
                src: F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")),
                kind: F.struct(F.length(digits).alias("n"), F.substring(digits, 1, 4).alias("first")),
                order: F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")),
            }
        ).withColumn(salt, F.conv(F.substring(order, 1, 2), 16, 10).cast("int") % SALTS)

    slim = sized.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(size).alias("size")) if slim is None else slim
    goals = source_targets(slim, "source", "size", weights, share, most).select(
        F.coalesce(F.concat(F.lit("="), "src"), F.lit("")).alias(src), F.col("source_size").alias(source_size), F.col("target").alias(target)
    )
    counts = celled(slim, "doc_id", "source", "size").groupBy(*cell).agg(F.count("*").alias(start))
    before = W.partitionBy(src).orderBy(kind, salt).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn(start, F.coalesce(F.sum(start).over(before), F.lit(0))).join(goals, src)
    within = W.partitionBy(*cell).orderBy(size, order)
    # an offset in steps of 2**-20, so that sums with whole expectations stay exact
    offset = F.conv(F.substring(F.md5(F.col(src).cast("binary")), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))
    expected = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(0.0))
    crossed = lambda at: F.floor(offset + at * expected)
    placed = celled(sized, doc_id, source, size).withColumn(row, F.row_number().over(within)).join(starts, cell).withColumn(place, F.col(start) + F.col(row))
    found = placed.withColumn(copies, (crossed(F.col(place)) - crossed(F.col(place) - 1)).cast("long"))
    outputs = {"source_size": F.col(source_size), "target": F.col(target), "copies": F.col(copies), "taken": F.col(size) * F.col(copies)}
    return found.withColumns({prefix + name: c for name, c in outputs.items()}).drop(*made)


def sized_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source and size of each document, cut off from the texts they were counted in."""
    return cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
