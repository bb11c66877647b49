"""Benchmark decontamination with SimHash fingerprints of item-sized windows.

Windows of a document that are as long as a benchmark item get a SimHash of their
word shingles, ``BLOCKS`` blocks of ``BLOCK_BITS`` bits. Windows and items are
candidates where one of the blocks is equal: two fingerprints that differ in fewer
bits than there are blocks must agree in one, so no pair within that radius is
missed. Candidates are then held to the exact weighted similarity: the sum of the
lesser over the sum of the greater weights of their shingles, a shingle weighing as
often as it occurs.

Beyond the guaranteed radius of 47 of 480 bits, a pair of similarity 0.8 differs in a
bit with a probability of 0.152 (its cosine is 8/9), so it agrees in a block of 10
with 0.19, and in none of 48 with 3e-5; a random pair agrees in one with 0.046.

A window can reach similarity t with an item of as many shingles only if
2t/(1+t) of its shingles occur in items of that size. To fingerprint every window of
every size would take each word as often as there are sizes times their lengths, so
documents are joined first with the shingles of the items, and windows are cut only
where enough of them met; this loses no window that the similarity would accept.
Windows with equal shingles are kept once a document and size, and fingerprinted and
compared once; windows are found block of places by block, so time and memory grow with
the length of a text, not with its square, also where it repeats a passage throughout.

Defined results: words are compared in lower case; a document or item without
words takes no part; texts of fewer than five words count as one shingle; a
document shorter than an item is one window; texts of any length are read whole;
repeated items or documents are reported each under its id, rows of one id
together; null ids are kept as null. Texts are compared row by row, also where an id
is null or repeated, and only the rows that hold a passage are not clean. Of windows
of equal similarity the first is reported. An empty table of either kind gives no
finding. Only ids and texts are read, so further columns pass through
``clean_documents`` whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, row_key, shingles, unused, word_hashes

WIDTH = 5
THRESHOLD = 0.8
BLOCKS, BLOCK_BITS = 48, 10
#: Bytes up to which the tables of the items are broadcast; beyond, both sides are shuffled.
BROADCAST_BYTES = 64 << 20
#: Places of a document whose windows are found together, or as many as a window has if those are more.
PLACES = 256
#: Blocks read from one 64-bit hash. Two bits times the first, under the mask of the second, stand 32 bits apart.
_PER_HASH, _SPREAD, _LANES = 6, 1 + (1 << 31), 1 + (1 << 32)


def fingerprints(bags: DataFrame, keys: list[str], bag: str) -> DataFrame:
    """The SimHash of each row's bag of shingles, a row for each of its blocks: keys, ``block``, and ``bits``, a number of ``BLOCK_BITS`` bits.

    A shingle is hashed anew for every 60 bits. Counts of set bits are kept in sums with two lanes of 32
    bits each, more than an array can have elements.
    """
    hashes = F.explode(F.array(*[F.struct(F.lit(w).alias("_w"), F.xxhash64(F.lit(w), "_h").alias("_x")) for w in range(BLOCKS // _PER_HASH)]))
    hashed = bags.select(*keys, F.explode(bag).alias("_h")).select(*keys, hashes.alias("_hash")).select(*keys, "_hash._w", "_hash._x")
    spread = lambda j: (F.shiftrightunsigned("_x", 2 * j).bitwiseAND(F.lit(3)) * F.lit(_SPREAD)).bitwiseAND(F.lit(_LANES))
    counted = hashed.groupBy(*keys, "_w").agg(F.count("*").alias("_n"), *[F.sum(spread(j)).alias(f"_s{j}") for j in range(_PER_HASH * BLOCK_BITS // 2)])
    ones = lambda b: F.shiftrightunsigned(F.col(f"_s{b // 2}"), 32 * (b % 2)).bitwiseAND(F.lit((1 << 32) - 1))
    bit = lambda b: F.when(ones(b) * 2 > F.col("_n"), F.lit(1 << b % BLOCK_BITS)).otherwise(F.lit(0))
    blocks = [reduce(lambda x, y: x + y, [bit(i * BLOCK_BITS + k) for k in range(BLOCK_BITS)]) for i in range(_PER_HASH)]
    return counted.select(*keys, "_w", F.posexplode(F.array(*blocks)).alias("_i", "bits")).select(*keys, (F.col("_w") * _PER_HASH + F.col("_i")).alias("block"), "bits")


def near_fingerprints(left: DataFrame, right: DataFrame, same: list[str], small: bool = False) -> DataFrame:
    """Different pairs of fingerprints that agree in ``same`` and in a block, so all that differ in fewer bits than there are blocks.

    ``small``: the right side has been found to be small enough to be broadcast.
    """
    return left.join(F.broadcast(right) if small else right, [*same, "block", "bits"]).drop("block", "bits").distinct()


def shared_weight(a: Column, b: Column) -> Column:
    """The size of what two bags have in common."""
    distinct = lambda x: F.size(F.array_distinct(x)) == F.size(x)
    count = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    return F.when(distinct(a) & distinct(b), F.size(F.array_intersect(a, b))).otherwise(
        F.aggregate(F.array_distinct(a), F.lit(0), lambda s, h: s + F.least(count(a, h), count(b, h)))
    )


def benchmark_items(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Items with words: id, words in the item, words of a shingle, and the bag of shingles."""
    counted = items.select(F.col(item_id).alias("item_id"), word_hashes(F.lower(F.col(text))).alias("w")).where(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(WIDTH))
    by_width = reduce(lambda later, k: F.when(width == k, shingles(F.col("w"), k)).otherwise(later), range(1, WIDTH), shingles(F.col("w"), WIDTH))
    return counted.select("item_id", F.size("w").alias("length"), width.alias("width"), by_width.alias("bag"))


def _places(length: Column) -> Column:
    return F.greatest(length, F.lit(PLACES))


def _hits(docs: DataFrame, wanted: DataFrame, width: int, t: float, small: bool) -> DataFrame:
    """Places where a document has a shingle of some item of a size, with the shingles around."""
    placed = docs.select("key", "doc_id", shingles(F.col("w"), width).alias("bag"))
    table = wanted.where(F.col("width") == width).select("h", "sizes")
    if small:
        met = placed.select("key", "doc_id", "bag", F.posexplode("bag").alias("pos", "h")).join(F.broadcast(table), "h")
    else:  # the bags stay behind while places are shuffled, and come back for the documents that met
        bags = placed.dropDuplicates(["key"])
        met = placed.select("key", F.posexplode("bag").alias("pos", "h")).join(table, "h").drop("h").join(bags, "key")
    each = met.select("key", "doc_id", "bag", "pos", F.explode("sizes").alias("n"))
    length = F.least(F.size("bag"), F.col("n"))
    need = F.ceil(F.lit(t) * (F.col("n") + length) / F.lit(1 + t) - 1e-9).cast("int")
    reach = F.greatest(length - need, F.lit(0))
    start = F.greatest(F.col("pos") - reach, F.lit(0))
    # a place counts for the windows that begin in its block of places, or in the one before if they reach it
    block = F.explode(F.sequence(F.floor(F.greatest(F.col("pos") - length + 1, F.lit(0)) / _places(length)), F.floor(F.col("pos") / _places(length))))
    return each.where(need <= length).select(
        "key", "doc_id", F.lit(width).alias("width"), "n", length.alias("m"), need.alias("need"), F.size("bag").alias("total"), "pos", block.alias("block"),
        start.alias("start"), F.slice("bag", start + 1, F.col("pos") - start + 1 + reach).alias("around"),
    )


def _windows(hits: DataFrame) -> DataFrame:
    """Windows in which enough shingles met: keys, start of the window and its bag. What is held together is a block of places, however long the document."""
    keys = ["key", "doc_id", "width", "n", "m", "need", "total", "block"]
    placed = lambda e: F.transform(e["around"], lambda h, i: F.struct((e["start"] + i).alias("p"), h.alias("h")))
    grouped = hits.groupBy(*keys).agg(F.array_sort(F.collect_set("pos")).alias("at"), F.collect_list(F.struct("start", "around")).alias("parts"))
    grouped = grouped.where(F.size("at") >= F.col("need")).withColumn("near", F.sort_array(F.array_distinct(F.flatten(F.transform("parts", placed)))))
    # a window whose first meeting place is at[i] starts there or up to m - need places before, yet after at[i - 1]
    enough = lambda p, i: F.coalesce(F.get("at", i + F.col("need") - 1) <= p + F.col("m") - 1, F.lit(False))
    low = lambda p, i: F.greatest(
        (F.col("block") * _places(F.col("m"))).cast("int"), F.coalesce(F.get("at", i - 1) + 1, F.lit(0)), F.coalesce(F.get("at", i + F.col("need") - 1) - F.col("m") + 1, p)
    )
    high = lambda p: F.least(p, F.col("total") - F.col("m"), ((F.col("block") + 1) * _places(F.col("m")) - 1).cast("int"))
    starts = F.flatten(
        F.transform(
            "at",
            lambda p, i: F.when(enough(p, i) & (low(p, i) <= high(p)), F.sequence(low(p, i), high(p))).otherwise(F.array().cast("array<int>")),
        )
    )
    return (
        grouped.withColumn("start", F.explode(F.array_distinct(starts)))
        .withColumn("_first", F.array_position(F.transform("near", lambda x: x["p"]), F.col("start")).cast("int"))
        .where(F.col("_first") > 0)
        .select(*keys, "start", F.transform(F.slice("near", F.col("_first"), F.col("m")), lambda x: x["h"]).alias("window"))
    )


def _leaks(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, threshold: float) -> DataFrame:
    """Key and id of rows, items, and the windows that reach the threshold."""
    bag_key = lambda *parts: F.struct(F.xxhash64(*parts).alias("high"), F.xxhash64(F.lit(1), *parts).alias("low"))
    read = benchmark_items(items, item_id, item_text).withColumn("bag", F.sort_array("bag"))
    keyed = read.withColumns({"n": F.size("bag"), "item": bag_key(F.col("item_id").isNull(), F.col("item_id"), F.col("width"), F.col("bag"))}).dropDuplicates(["item"])
    wanted = keyed.select("width", "n", F.explode("bag").alias("h")).groupBy("width", "h").agg(F.collect_set("n").alias("sizes"))
    # the widths that occur (at most five), and what the tables of the items would take when broadcast
    facts = keyed.groupBy("width").agg(F.count("*").alias("items"), F.sum("n").alias("shingles")).collect()
    small = sum(64 * BLOCKS * r["items"] + 64 * r["shingles"] for r in facts) <= BROADCAST_BYTES
    source = docs.select(row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(doc_id).alias("doc_id"), word_hashes(F.lower(F.col(text))).alias("w"))
    widths = sorted(r["width"] for r in facts) or [WIDTH]
    found = _windows(reduce(DataFrame.unionByName, [_hits(source, wanted, k, threshold, small) for k in widths])).withColumn("window", F.sort_array("window"))
    named = found.select("key", "doc_id", "width", "n", "start", "window", bag_key("width", "window").alias("bag_key"))
    # a passage told over and over has few different windows
    same = named.groupBy("key", "doc_id", "width", "n", "bag_key").agg(F.min("start").alias("start"), F.count("*").alias("times"), F.any_value("window").alias("window"))
    windows = cut(same)
    bags = windows.select("width", "n", "bag_key", "window").dropDuplicates(["width", "n", "bag_key"])
    of_items = fingerprints(keyed, ["item", "width", "n"], "bag")
    pairs = near_fingerprints(fingerprints(bags, ["bag_key", "width", "n"], "window"), of_items, ["width", "n"], small)
    full = keyed.select("item", "item_id", "bag")
    both = let(shared_weight(F.col("window"), F.col("bag")), lambda s: s / (F.size("window") + F.size("bag") - s))
    alike = pairs.join(bags, ["bag_key", "width", "n"]).join(F.broadcast(full) if small else full, "item").withColumn("similarity", both)
    reached = alike.where(F.col("similarity") >= threshold - 1e-12).select("bag_key", "width", "n", "item_id", "similarity")
    return windows.drop("window").join(reached, ["bag_key", "width", "n"])


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Document, item, the first word of the best window, its similarity, and how many windows reach the threshold."""
    found = _leaks(docs, items, doc_id, text, item_id, item_text, threshold)
    return (
        found.groupBy("doc_id", "item_id")
        .agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("start").alias("at"))).alias("_best"), F.sum("times").alias("n_windows"))
        .select("doc_id", "item_id", F.col("_best.at").cast("long").alias("start_word"), (-F.col("_best.s")).alias("similarity"), "n_windows")
    )


def clean_documents(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows that hold no passage of an item."""
    (key,) = unused(docs, "_key")
    leaks = _leaks(docs, items, doc_id, text, item_id, item_text, threshold).select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, row_key(F.col(doc_id), F.col(text))).join(leaks, key, "left_anti").drop(key)
