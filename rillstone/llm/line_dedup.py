"""Lines that several documents share stay only in the first of them.

Each line's key is hashed to 128 bits, once for each document that holds it. The hashes are dealt to ranges and sorted
by hash, document and row, and stream by: the first document of a hash keeps its lines, all later ones lose them. What
comes back is no text but a bitmap for each document, a bit for each line, compressed.

Ranges are cut by hash and document together, so a line that very many documents share is spread over many tasks. A
range that begins within a hash can't know its first document. It marks the rows that its own first document has, and
the first and last hash of every range, two rows each, tell afterwards which of the marked rows go.

Defined results: a document is known by its id; a null id is one id, before all others; rows of one id are one document,
so they keep the same lines; a null or empty text is one empty line; lines of any number and length are read whole; ties
can't be, as the least id decides; an empty table gives an empty result. Keys shorter than ``SHORTEST`` code points are
never dropped. Further columns pass through ``dedup_lines`` untouched; one that has the name of an output is replaced,
unless ``prefix`` sets the outputs apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, ship, unused

#: Code points of a key that may be dropped, at least.
SHORTEST = 10
_BLANKS = " \t\n\x0b\x0c\r"
#: What a line is stripped of, as a class body, is the library's white space: ``SPACE``.
assert SPACE == r"\x20\x09-\x0D"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lines put out at once.
_ROWS = 100_000


def line_keys(text: str, shortest: int = SHORTEST) -> Iterator[tuple[int, bytes]]:
    """Place and hash of each line whose key is long enough."""
    for i, line in enumerate(text.split("\n")):
        key = line.strip(_BLANKS)
        if len(key) >= shortest:
            yield i, xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").translate(_LOWER))


def _hash_lines(shortest: int):
    def hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0), batch.column(1)
            rows: list[int] = []
            sizes: list[int] = []
            digests: list[bytes] = []
            places: list[bytes] = []

            def out() -> pa.RecordBatch:
                at, h = pa.array(rows, pa.int64()), np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)  # noqa: B023
                return pa.record_batch([pa.array(h[:, 0]), pa.array(h[:, 1]), ids.take(at), tags.take(at), pa.array(sizes, pa.int64()), pa.array(places, pa.binary())], names=["high", "low", "id", "tag", "n_lines", "lines"])  # noqa: B023

            for k in range(batch.num_rows):
                own: dict[bytes, list[int]] = {}
                text = batch.column(2)[k].as_py()
                for i, digest in line_keys(text, shortest):
                    own.setdefault(digest, []).append(i)
                rows += [k] * len(own)
                sizes += [text.count("\n") + 1] * len(own)
                digests += own
                places += [np.array(x, "<i4").tobytes() for x in own.values()]
                if len(rows) >= _ROWS:
                    yield out()
                    rows, sizes, digests, places = [], [], [], []
            if rows:
                yield out()

    return hash_lines


#: Kinds of rows that a range puts out: lines that go, lines that go if an earlier range has an earlier document, and the last hash with its first document here.
GOES, OPEN, LAST = 0, 1, 2


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two arrays are equal, null being equal to null."""
    equal = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
    return equal | (pc.is_null(a).to_numpy(zero_copy_only=False) & pc.is_null(b).to_numpy(zero_copy_only=False))


def first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range, sorted by hash and document, to the rows whose lines go or may go."""
    opening = before = None  # the range's first hash; the hash that the batch before ended with, and its first row
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if before is not None:
            table = pa.concat_tables([before, table])
        table = table.combine_chunks()
        high, low, ids = table["high"].to_numpy(), table["low"].to_numpy(), table["id"].combine_chunks()
        new = np.ones(len(high), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(high)), 0))
        goes = ~_same(ids, ids.take(pa.array(start)))
        if opening is None:
            opening = high[0], low[0]
        kind = np.where(goes, GOES, np.where((high == opening[0]) & (low == opening[1]), OPEN, -1)).astype(np.int32)
        if before is not None:
            kind[0] = -1  # put out with the batch before
        at = np.flatnonzero(kind >= 0)
        before = table.slice(start[-1], 1)
        yield from table.take(pa.array(at)).append_column("kind", pa.array(kind[at])).combine_chunks().to_batches()
    if before is not None:
        yield from before.append_column("kind", pa.array([LAST], pa.int32())).combine_chunks().to_batches()


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, dropped = [], []
        for n, lines in zip(batch.column("n_lines").to_pylist(), batch.column("lines").to_pylist(), strict=True):
            bits = np.ones(n, bool)
            bits[np.frombuffer(b"".join(lines), "<i4")] = False
            keep.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
            dropped.append(int(n - bits.sum()))
        yield pa.record_batch([batch.column("id"), batch.column("tag"), pa.array(dropped, pa.int64()), pa.array(keep, pa.binary())], names=["id", "tag", "n_dropped", "keep"])


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    # rows of one id that differ in text have bitmaps of their own
    return docs.select(F.col(doc_id).alias("id"), F.xxhash64(body).alias("tag"), body.alias("body"))


def _n_lines(body: Column) -> Column:
    return F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1


def dropping_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """A row for each id and text (by hash, ``tag``) that loses lines: n_dropped, and ``keep``, a compressed bitmap of the lines that stay."""
    spark = ship(docs.sparkSession)
    rows = _rows(docs, doc_id, text)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"high long, low long, id {kind}, tag long, n_lines long, lines binary"
    hashed = rows.mapInArrow(_hash_lines(shortest), schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("high"), F.col("low"), F.col("id").asc_nulls_first(), F.col("tag")]
    ranged = hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = cut(ranged.mapInArrow(first_occurrences, f"{schema}, kind int"))
    # at most two hashes a range
    known = F.struct(F.col("id").isNotNull().alias("known"), "id")
    firsts = found.where(F.col("kind") != GOES).groupBy("high", "low").agg(F.min(known).alias("first"))
    opened = found.where(F.col("kind") == OPEN).join(F.broadcast(firsts), ["high", "low"]).where(~F.col("id").eqNullSafe(F.col("first.id")))
    gone = found.where(F.col("kind") == GOES).unionByName(opened.select(found.columns))
    per_row = gone.groupBy("id", "tag").agg(F.max("n_lines").alias("n_lines"), F.collect_list("lines").alias("lines"))
    return per_row.mapInArrow(_bitmaps, f"id {kind}, tag long, n_dropped long, keep binary")


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """A row for each document: its id, n_lines, n_dropped, and ``keep``, null where all lines stay."""
    rows = _rows(docs, doc_id, text).select("id", "tag", _n_lines(F.col("body")).cast("long").alias("n_lines")).alias("r")
    found = rows.join(dropping_bitmaps(docs, doc_id, text, shortest).alias("b"), F.col("r.id").eqNullSafe(F.col("b.id")) & (F.col("r.tag") == F.col("b.tag")), "left")
    return found.select(F.col("r.id").alias(doc_id), "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep")


def kept_lines(text: str, keep: bytes | None) -> str:
    """The text without the lines whose bit is not set."""
    if keep is None:
        return text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines), bitorder="little")
    return "\n".join([x for x, b in zip(lines, bits.tolist(), strict=True) if b])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, prefix: str = "") -> DataFrame:
    """The documents with n_lines, n_dropped, keep (null where all lines stay) and kept_text, each after ``prefix``."""
    outputs = [f"{prefix}{c}" for c in ("n_lines", "n_dropped", "keep", "kept_text")]
    found = dropping_bitmaps(docs, doc_id, text, shortest)
    rest = [c for c in docs.columns if c.lower() not in {o.lower() for o in outputs} or c in (doc_id, text)]
    b_id, b_tag, b_dropped, b_keep = unused(docs, "b_id", "b_tag", "b_dropped", "b_keep", also=outputs)
    body = F.coalesce(F.col(text), F.lit(""))
    bitmaps = found.select(F.col("id").alias(b_id), F.col("tag").alias(b_tag), F.col("n_dropped").alias(b_dropped), F.col("keep").alias(b_keep))
    joined = docs.join(bitmaps, F.col(doc_id).eqNullSafe(F.col(b_id)) & (F.xxhash64(body) == F.col(b_tag)), "left")

    @F.pandas_udf("string")
    def apply(texts: pd.Series, keep: pd.Series) -> pd.Series:
        return pd.Series([None if k is None else kept_lines(t, k) for t, k in zip(texts, keep, strict=True)], dtype=object)

    # only texts that lose lines are sent
    kept = F.coalesce(apply(F.when(F.col(b_keep).isNotNull(), body), F.col(b_keep)), body)
    values = [_n_lines(body).cast("long"), F.coalesce(b_dropped, F.lit(0)).cast("long"), F.col(b_keep), kept]
    return joined.select(*rest, *[v.alias(o) for o, v in zip(outputs, values, strict=True)])
