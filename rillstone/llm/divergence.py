"""How far the sources of each language differ in their words.

Counting follows the pattern of in-mapper stripes. A task folds whole documents into a hash table from a language's
term to its stripe: the documents that hold it, and its occurrences by source. A table that has grown to ``ENTRIES``
entries is put out and begun anew. Stripes are dealt by term and sorted, and merged as they stream by, so a term takes
as many rows as tables were put out, not as it has occurrences, and no task holds more than one merged stripe and a
batch. Terms in enough documents of their language stay.

Merged stripes emit the divergences directly: a task reads the totals of a language and then its share of the stripes,
adds each stripe's part to all pairs of sources, and keeps the ten terms that tell each source best. The shares are
added up and ranked.

The divergence of two groups at a term, with smoothed shares p and q in parts of 10^9, is floor((p-q)^2 / (p+q)).
All arithmetic is on whole numbers: shares are divided out three digits at a time, so counts up to 9*10^15 stay exact.

Defined results: null text, language and source are read as empty; an empty language or source is one like any other;
texts of any length are read whole, cut between terms into pieces for memory's sake; a repeated row is a document of
its own; equal values rank by their item's UTF-8 bytes; a language without a kept term has pairs of value 0 and no
terms; an empty table gives an empty result. Only the three named columns are read, so further columns have no part in
the result, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, ship

#: Documents of its language that hold a kept term at least, and the ranks of terms that are returned.
LEAST, BEST = 10, 10
#: Entries (term and source) of a table that is put out; bytes of text that are cut into terms at once.
ENTRIES, PIECE = 400_000, 1 << 20
#: Kept terms of a language in one of its shares, or so: each share puts out a row for each pair of sources.
TERMS = 20_000
#: Numbers in a block of stripes spread over all sources.
CELLS = 1 << 20
#: What is no letter of A-Z or a-z and below 128 parts terms; A-Z become a-z. Bytes of longer characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"
_STRIPE = pa.schema([("lang", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def term_counts(text: str) -> Counter:
    """How often each term is in the text, as UTF-8 bytes."""
    data, found, at = text.encode("utf-8", "surrogatepass").translate(_FOLD), Counter(), 0
    while len(data) - at > PIECE:
        end = data.rfind(b" ", at, at + PIECE)
        if end < 0:  # a term longer than a piece
            end = data.find(b" ", at + PIECE)
            if end < 0:
                break
        found.update(data[at:end].split(b" "))
        at = end
    found.update(data[at:].split(b" "))
    del found[b""]
    return found


def _lists(values: list, sizes: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


class Stripes:
    """A hash table of stripes by language and term."""

    def __init__(self) -> None:
        self.by_lang: dict[str, dict[bytes, dict[str | None, int]]] = {}
        self.entries = 0

    def fold(self, lang: str, source: str, text: str) -> None:
        stripes, fresh = self.by_lang.setdefault(lang, {}), 0
        for term, n in term_counts(text).items():
            stripe = stripes.get(term)
            if stripe is None:
                stripes[term] = {None: 1, source: n}  # at None: documents
                fresh += 1
            elif source in stripe:
                stripe[None] += 1
                stripe[source] += n
            else:
                stripe[None] += 1
                stripe[source] = n
                fresh += 1
        self.entries += fresh

    def put_out(self, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
        for lang, stripes in self.by_lang.items():
            every = list(stripes.items())
            for i in range(0, len(every), rows):
                some = every[i : i + rows]
                dfs = [s.pop(None) for _, s in some]
                sizes = [len(s) for _, s in some]
                terms = pa.array([t for t, _ in some], pa.binary()).cast(pa.string())
                yield pa.record_batch([
                    pa.array([lang] * len(some), pa.string()), terms, pa.array(dfs, pa.int64()),
                    _lists([x for _, s in some for x in s], sizes, pa.string()), _lists([x for _, s in some for x in s.values()], sizes, pa.int64()),
                ], schema=_STRIPE)
        self.by_lang, self.entries = {}, 0


def fold_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stripes = Stripes()
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(batch.num_rows):
            stripes.fold(langs[i], sources[i], batch.column(2)[i].as_py())
            if stripes.entries >= ENTRIES:
                yield from stripes.put_out()
    yield from stripes.put_out()


def _changes(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """Whether a row differs from the row before it in some of the columns; the first does."""
    new = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        new[1:] = False
        for name in names:
            c = table[name].combine_chunks() if table[name].num_chunks != 1 else table[name].chunk(0)
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return new


def _merge(table: pa.Table) -> pa.Table:
    """Stripes of one term, which follow each other, as one."""
    starts = np.flatnonzero(_changes(table, ("lang", "term")))
    sizes = pc.list_value_length(table["sources"]).to_numpy()
    group = np.repeat(np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows))), sizes)
    coded = pc.list_flatten(table["sources"]).combine_chunks().dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy()
    counts = pc.list_flatten(table["counts"]).to_numpy()
    key = group * max(1, len(names)) + code
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    summed, keys = (np.add.reduceat(counts[order], first) if len(first) else counts), key[order][first]
    held = np.bincount(keys // max(1, len(names)), minlength=len(starts))
    offsets = pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32())
    return pa.table({
        "lang": table["lang"].take(starts), "term": table["term"].take(starts), "df": np.add.reduceat(table["df"].to_numpy(), starts),
        "sources": pa.ListArray.from_arrays(offsets, names.take(pa.array(keys % max(1, len(names))))), "counts": pa.ListArray.from_arrays(offsets, pa.array(summed, pa.int64())),
    }).cast(_STRIPE)


def merge_stripes(least: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the stripe that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch]).cast(_STRIPE)
            merged = _merge(pa.concat_tables([last, now]).combine_chunks() if last is not None else now)
            last, done = merged.slice(merged.num_rows - 1), merged.slice(0, merged.num_rows - 1)
            yield from done.filter(pc.greater_equal(done["df"], least)).combine_chunks().to_batches()
        if last is not None:
            yield from last.filter(pc.greater_equal(last["df"], least)).combine_chunks().to_batches()

    return merge


def merged_stripes(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST) -> DataFrame:
    """A row for each language and term in at least ``least`` of its documents: df, and its sources with their counts."""
    ship(docs.sparkSession)
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    folded = plain.mapInArrow(fold_documents, STRIPE)
    return folded.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(merge_stripes(least), STRIPE)


def shares(counts: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)), three digits at a time."""
    rest, found = counts + 2, np.zeros(counts.shape, np.int64)
    of = np.asarray(total, np.int64) + 2 * terms
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // of
        rest = rest % of
    return found + 1


class Emitter:
    """The divergences of one language's stripes: sums for all pairs of its sources, and the terms that tell each best."""

    def __init__(self, lang: str, sources: list[str], totals: np.ndarray, terms: int, best: int = BEST):
        self.lang, self.sources, self.totals, self.terms, self.most = lang, sources, totals, terms, best
        self.code = {s: i for i, s in enumerate(sources)}
        self.pairs = np.zeros((len(sources), len(sources)), np.int64)
        self.best: list[list[tuple[int, str]]] = [[] for _ in sources]

    def add(self, stripes: pa.Table) -> None:
        rows = max(1, CELLS // len(self.sources))
        for i in range(0, stripes.num_rows, rows):
            self._block(stripes.slice(i, rows).combine_chunks())

    def _block(self, stripes: pa.Table) -> None:
        sizes = pc.list_value_length(stripes["sources"]).to_numpy()
        counts = np.zeros((stripes.num_rows, len(self.sources)), np.int64)
        coded = pc.list_flatten(stripes["sources"]).combine_chunks().dictionary_encode()
        codes = np.array([self.code[s] for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        counts[np.repeat(np.arange(stripes.num_rows), sizes), codes] = pc.list_flatten(stripes["counts"]).to_numpy()
        p = shares(counts, self.totals, self.terms)
        for a in range(1, len(self.sources)):
            own, other = p[:, a : a + 1], p[:, :a]
            self.pairs[a, :a] += ((own - other) ** 2 // (own + other)).sum(axis=0)
        q = shares(counts.sum(axis=1), self.totals.sum(), self.terms)[:, None]
        value = np.where((counts > 0) & (p > q), (p - q) ** 2 // (p + q), -1)
        for a in range(len(self.sources)):
            column = value[:, a]
            least = max(0, np.partition(column, -self.most)[-self.most]) if len(column) > self.most else 0
            if len(self.best[a]) == self.most:
                least = max(least, -self.best[a][-1][0])
            at = np.flatnonzero(column >= least)
            if len(at):
                names = stripes["term"].take(pa.array(at)).to_pylist()
                # code points and UTF-8 bytes order alike
                self.best[a] = sorted(self.best[a] + [(-int(v), t) for v, t in zip(column[at], names, strict=True)])[: self.most]

    def rows(self) -> Iterator[tuple[str, str, str, str, int]]:
        for a, source in enumerate(self.sources):
            for b, other in enumerate(self.sources):
                if a != b:
                    yield self.lang, source, "pair", other, int(self.pairs[max(a, b), min(a, b)])
            for value, term in self.best[a]:
                yield self.lang, source, "term", term, -value


EMITTED = "lang string, source string, part string, item string, value long"


def _as_batches(rows: Iterator[tuple], many: int = 20_000) -> Iterator[pa.RecordBatch]:
    columns = [[], [], [], [], []]
    make = lambda: pa.record_batch([pa.array(c, pa.int64() if i == 4 else pa.string()) for i, c in enumerate(columns)], names=["lang", "source", "part", "item", "value"])
    for row in rows:
        for c, v in zip(columns, row, strict=True):
            c.append(v)
        if len(columns[0]) >= many:
            yield make()
            columns = [[], [], [], [], []]
    if columns[0]:
        yield make()


def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of a language (without a term) come before its stripes."""
    now = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        is_total = pc.is_null(table["term"]).to_numpy()
        cuts = [*np.flatnonzero(is_total).tolist(), table.num_rows]
        if now is not None and cuts[0]:
            now.add(table.slice(0, cuts[0]))
        for start, end in zip(cuts, cuts[1:], strict=False):
            if now is not None:
                yield from _as_batches(now.rows())
            row = table.slice(start, 1).to_pylist()[0]
            now = Emitter(row["lang"], row["sources"], np.array(row["counts"], np.int64), row["df"])
            if end > start + 1:
                now.add(table.slice(start + 1, end - start - 1))
    if now is not None:
        yield from _as_batches(now.rows())


def divergences(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, best: int = BEST) -> DataFrame:
    """Rows (lang, source, part, item, value, rank). Part ``pair``: all other sources of the language; ``term``: the ``best`` terms
    that the source has more of than its language."""
    if best > BEST:
        raise ValueError(f"at most {BEST} terms a source")
    stripes = cut(merged_stripes(docs, lang, source, text, least))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]).distinct()
    counted = stripes.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    of_lang = groups.join(counted, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("of"))
    kept = stripes.groupBy("lang").agg(F.count("*").alias("df")).withColumn("shares", F.ceil(F.col("df") / TERMS).cast("int"))
    # every share of a language's stripes begins with a row of its totals: the number of kept terms, the sources, their counts
    shares_of = F.coalesce("shares", F.lit(1))
    totals = of_lang.join(kept, "lang", "left").select(
        "lang", F.lit(None).cast("string").alias("term"), F.coalesce("df", F.lit(0)).alias("df"), F.col("of.source").alias("sources"), F.col("of.n").alias("counts"),
        F.explode(F.sequence(F.lit(0), shares_of - 1)).alias("share"),
    )
    dealt = stripes.join(kept.select("lang", "shares"), "lang").withColumn("share", F.pmod(F.xxhash64("term"), F.col("shares")).cast("int"))
    every = dealt.select(totals.columns).unionByName(totals)
    emitted = every.repartition("share", "lang").sortWithinPartitions("share", "lang", F.col("term").isNotNull()).drop("share").mapInArrow(emit, EMITTED)
    summed = emitted.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= best)).select("lang", "source", "part", "item", "value", "rank")
