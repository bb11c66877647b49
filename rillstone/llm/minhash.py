"""Near-duplicate documents by DartMinHash.

A document is a weighted set: its five-word shingles, each weighing as often as
it occurs. Darts are thrown by hash onto the region of every element, one unit of
weight wide, along a rank axis; a dart also names one of ``COORDINATES``. The
earliest dart of each coordinate is its signature: two documents agree in a
coordinate with the probability of their weighted Jaccard similarity. Ranks are
searched only as far as about k ln k + 2k darts, then further for coordinates that
are still empty, so the cost is that of the elements plus that of the darts.

Bands of signatures group documents into buckets. Links are sought, and each is
held to the exact similarity:

1. exact copies become one text;
2. every text against the leader of each of its buckets, the one met in the most
   buckets first, further ones only where components still differ;
3. what is left, exactly, in buckets whose members still belong to several
   components: every member of all but the largest component against every member
   of the others, in one block of bounded size;
4. a bucket too large for a block is dealt anew, and exactly: two texts as alike as
   wanted share one of the rarest elements of each, so those that do are grouped by
   them. What is common to a crowd, such as a template, groups nothing. Leaders and
   blocks then do their work there, block against block where a group needs several.

Classes are the connected components of the links. A pair of similarity 0.8
shares no bucket with a probability of 5e-8.

Defined results: words are compared as written; a text of one to four words is
one shingle; texts without words are alike only if equal; null texts are alike only
if they have the same id; texts of any length are compared whole; the class id is
the least document id of the class, null if it has none; rows that repeat a document
id get the class of their own text; of rows equal in id and text, that stays whose
other columns come first as JSON; an empty table gives an empty result. Further
columns pass through ``one_of_each_class``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, unused, word_hashes
from .components import components

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: Elements of the texts that one task compares with each other, and pairs that one copy of a leader's elements is for.
BLOCK, LED = 1 << 18, 2_000
#: Bits of the map of wanted keys that goes to every task, and those that a row of it holds, as Spark's bitmaps do.
SLOTS, _MAP = 1 << 24, 1 << 15
_U = np.uint64


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of 64-bit numbers."""
    x = (x ^ _U(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(32)
    return x


def weighted_elements(word_hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of consecutive documents as (document, element), one for each unit of weight.

    The n-th occurrence of a shingle in a document is an element of its own, so the
    weighted similarity of two documents is the plain one of their elements.
    """
    n = len(word_hashes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # words from here to the end of the document
    w = word_hashes.view(np.uint64)
    value = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        if k < n:
            inside = left[: n - k] > k
            value[: n - k] = np.where(inside, mix(value[: n - k] ^ w[k:], k + 1), value[: n - k])
    start = left == np.repeat(sizes, sizes)
    keep = (left >= WIDTH) | (start & (np.repeat(sizes, sizes) < WIDTH))
    owner, value = owner[keep], value[keep]
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(value)), 0))
    nth = (np.arange(len(value)) - first).astype(np.uint64)
    return owner, np.where(nth == 0, value, mix(value + nth * _U(0xD6E8FEB86659FD93), 99))


def _exponential(h: np.ndarray) -> np.ndarray:
    return -np.log(((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)


def signatures(owner: np.ndarray, element: np.ndarray, documents: int, k: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each coordinate, a row for each document; zeros for a document without elements."""
    out, best = np.zeros((documents, k), np.uint64), np.full((documents, k), np.inf)
    weight = np.bincount(owner, minlength=documents)
    limit = (k * np.log(k) + 2 * k) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        mine = todo[owner]
        who, what = owner[mine], element[mine]
        rank, nth = np.zeros(len(what)), 0
        slots, ranks, darts = [], [], []
        while len(what):  # the next dart of every element whose last one lay within the limit
            nth += 1
            dart = mix(what, 1000 + nth)
            rank = rank + _exponential(mix(dart, 7))
            near = rank <= limit[who]
            who, what, rank, dart = who[near], what[near], rank[near], dart[near]
            slots.append(who * k + (mix(dart, 8) % _U(k)).astype(np.int64))
            ranks.append(rank)
            darts.append(dart)
        slot, rank, dart = np.concatenate(slots), np.concatenate(ranks), np.concatenate(darts)
        order = np.lexsort((rank, slot))
        slot = slot[order]
        head = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
        out.reshape(-1)[slot[head]] = dart[order][head]
        best.reshape(-1)[slot[head]] = rank[order][head]
        limit = limit * 2
        todo = (weight > 0) & ~np.isfinite(best).all(1)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.zeros(parts.shape[:2], np.uint64)
    for r in range(ROWS):
        key = mix(key ^ parts[:, :, r], 31 + r)
    return mix(key + np.arange(BANDS, dtype=np.uint64)[None, :], 77).view(np.int64)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat, np.diff(column.offsets.to_numpy())


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``most`` words together, or one row."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def _over_batches(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """For columns (key, words): ``make(word hashes, sizes)`` over runs of rows, with the key before it."""
    for batch in batches:
        flat, sizes = _lists(batch.column(1))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for a, b in _slices(sizes, 400_000):
            rows = make(flat[ends[a] : ends[b]], sizes[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), rows], names=["key", "found"])


def _as_lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat.view(np.int64)))


def _band_column(word_hashes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    owner, element = weighted_elements(word_hashes, sizes)
    keys = band_keys(signatures(owner, element, len(sizes)))
    some = np.bincount(owner, minlength=len(sizes)) > 0
    return _as_lists(keys[some].ravel(), np.where(some, BANDS, 0))


def _element_column(word_hashes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    owner, element = weighted_elements(word_hashes, sizes)
    order = np.lexsort((element, owner))
    return _as_lists(element[order], np.bincount(owner, minlength=len(sizes)))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _plain(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Columns id, body and key: the text's and the id together."""
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"), F.struct(text_key(F.col(text)).alias("text"), F.col(doc_id).alias("id")).alias("key"))


def distinct_texts(plain: DataFrame) -> DataFrame:
    """Each different non-null text: ``node``, its key, ``first`` (its least id), its number of elements and the keys of its bands."""
    ship(plain.sparkSession)
    kind = plain.schema["id"].dataType.simpleString()
    hashed = plain.where(F.col("body").isNotNull()).select("key", word_hashes(F.col("body")).alias("words"))
    size = F.when(F.size("words") > 0, F.greatest(F.size("words") - (WIDTH - 1), F.lit(1))).otherwise(F.lit(0))
    sized = hashed.select(F.struct("key.text", "key.id", size.alias("size")).alias("key"), "words")
    banded = sized.mapInArrow(lambda it: _over_batches(it, _band_column), f"key struct<text binary, id {kind}, size int>, found array<bigint>")
    # equal texts have equal bands; one row of each task's copies is shuffled
    merged = banded.groupBy(F.col("key.text").alias("text")).agg(F.min("key.id").alias("first"), F.max(F.struct("key.size", "found")).alias("f"))
    return cut(merged.select(F.monotonically_increasing_id().alias("node"), "text", "first", F.col("f.size").alias("size"), F.col("f.found").alias("bands")))


def among(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key may be one of those wanted (a table of that column), told without a shuffle of them.

    None that is wanted is missing. Keys are hashed to ``SLOTS`` bits, 2 MB however many there are; a key that is not wanted
    passes if it shares a bit with one that is, so a join has to follow.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    place = (F.col("_slot") % _MAP).cast("int")
    maps = wanted.select(slot.alias("_slot")).groupBy(F.expr(f"_slot div {_MAP}").alias("_map")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    byte = F.conv(F.hex(F.substr(F.col("_bits"), F.expr(f"CAST(_slot % {_MAP} AS INT) div 8").cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = df.withColumn("_slot", slot).withColumn("_map", F.expr(f"_slot div {_MAP}")).join(F.broadcast(maps), "_map")
    return found.where(F.getbit(byte, place % 8) == 1).select(*df.columns)


def elements_of(plain: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sorted elements of the texts that are wanted (node, text, first), read from a row that has the least id. Other texts are not shuffled."""
    named = wanted.select(F.struct("text", F.col("first").alias("id")).alias("key"), "node")
    rows = among(plain.where(F.col("body").isNotNull()), "key", named.select("key"))
    hashed = rows.join(named.hint("shuffle_hash"), "key").select(F.col("node").alias("key"), word_hashes(F.col("body")).alias("words"))
    made = hashed.mapInArrow(lambda it: _over_batches(it, _element_column), "key bigint, found array<bigint>")
    return made.dropDuplicates(["key"]).select(F.col("key").alias("node"), F.col("found").alias("elements"))


def similarity(a: Column, b: Column) -> Column:
    """Exact weighted Jaccard similarity from two element sets."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def _verified(pairs: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that are as alike as wanted. A text in very many pairs as ``b`` is copied for each ``LED`` of them."""
    copies = pairs.groupBy("b").agg(F.ceil(F.count("*") / LED).cast("int").alias("copies"))
    left = elements.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    right = elements.select(F.col("node").alias("b"), F.col("elements").alias("eb")).join(copies, "b").select("b", "eb", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    dealt = pairs.join(copies, "b").withColumn("copy", F.pmod(F.xxhash64("a"), "copies").cast("int"))
    return dealt.join(left, "a").join(right, ["b", "copy"]).where(similarity(F.col("ea"), F.col("eb")) >= threshold - 1e-12).select(*pairs.columns)


def _rooted(df: DataFrame, roots: DataFrame, node: str, name: str) -> DataFrame:
    """Adds the root of a node; a node without links is its own."""
    named = roots.select(F.col("node").alias(node), F.col("root").alias("_root"))
    return df.join(named, node, "left").withColumn(name, F.coalesce("_root", node)).drop("_root")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots after further links between nodes whose roots are ``ra`` and ``rb``: only roots are linked, so the graph is small."""
    above = components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    moved = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("_above")), "root", "left")
    return cut(moved.select("node", F.coalesce("_above", "root").alias("root")).unionByName(above).distinct())


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (bucket, node, size) but for leaders of buckets that still hold several components.

    With their root, whether it is another one than the bucket's largest, and the elements of the bucket and of such others.
    """
    placed = _rooted(members.where(F.col("node") != F.col("leader")), roots, "node", "root")
    groups = placed.groupBy("bucket", "root").agg(F.sum("size").alias("weight"))
    largest = F.max(F.struct("weight", "root")).alias("largest")
    buckets = groups.groupBy("bucket").agg(F.count("*").alias("kinds"), F.sum("weight").alias("weight"), largest).where(F.col("kinds") > 1)
    facts = buckets.select("bucket", "weight", (F.col("weight") - F.col("largest.weight")).alias("other"), F.col("largest.root").alias("main"))
    return cut(placed.join(facts, "bucket").select("bucket", "node", "size", "root", (F.col("root") != F.col("main")).alias("asks"), "weight", "other"))


def _compared(open_: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b, and their roots ra, rb) within buckets: those that ask against all, block against block, one link for a component."""
    blocks = lambda weight: F.greatest(F.lit(1), F.ceil(F.col(weight) / BLOCK)).cast("int")
    part = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), F.col("node")), n).cast("int")
    cell = lambda p, t: F.struct(p.alias("p"), t.alias("t"))
    dealt = open_.withColumns({"ask": part(blocks("other"), 1), "own": part(blocks("weight"), 2)})
    to_all = F.transform(F.sequence(F.lit(0), blocks("weight") - 1), lambda t: cell(F.col("ask"), t))
    from_all = F.transform(F.sequence(F.lit(0), blocks("other") - 1), lambda p: cell(p, F.col("own")))
    cells = dealt.withColumn("cell", F.explode(F.when(F.col("asks"), F.array_union(to_all, from_all)).otherwise(from_all)))
    asks, asked = F.col("asks") & (F.col("cell.p") == F.col("ask")), F.col("cell.t") == F.col("own")
    rows = cells.select("bucket", "cell.p", "cell.t", asks.alias("asks"), asked.alias("asked"), "node", "root").join(among(elements, "node", open_.select("node")), "node")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["asks"]], pdf[pdf["asked"]]
        found: list[tuple[int, int, int, int]] = []
        if len(a) and len(b):
            sizes_b = b["elements"].str.len().to_numpy()
            flat = np.concatenate(list(b["elements"])) if sizes_b.sum() else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(b)), sizes_b)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            roots_b, nodes_b = b["root"].to_numpy(), b["node"].to_numpy()
            for node, root, mine in zip(a["node"], a["root"], a["elements"], strict=True):
                low, high = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
                hits = np.concatenate([owner[x:y] for x, y in zip(low, high, strict=True)]) if len(mine) else owner[:0]
                shared = np.bincount(hits, minlength=len(b))
                alike = shared / np.maximum(1, len(mine) + sizes_b - shared)
                near = np.flatnonzero((alike >= threshold - 1e-12) & (roots_b != root) & (shared > 0))
                _, one = np.unique(roots_b[near], return_index=True)
                found += [(node, nodes_b[j], root, roots_b[j]) for j in near[one]]
        return pd.DataFrame(found, columns=["a", "b", "ra", "rb"], dtype="int64")

    return rows.groupBy("bucket", "p", "t").applyInPandas(link, "a long, b long, ra long, rb long").distinct()


def _by_rare_elements(nodes: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """Members (bucket, node, size, leader) of groups that share one of the rarest elements of each: nodes come with their root.

    Of texts with n elements in one order, two as alike as wanted share one of the first n - ceil(t n) + 1 of each. The
    order is: elements that only one component holds, which lead nowhere, then the rest by how many hold them.
    """
    full = nodes.join(elements, "node")
    each = full.select("node", "root", F.explode("elements").alias("e"))
    held = each.groupBy("e").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") < F.col("high"))
    shared = each.join(held.select("e", "n"), "e").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("es"))
    sized = full.select("node", "root", F.size("elements").alias("size")).join(shared, "node")
    first = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9).cast("int") + 1 - (F.col("size") - F.size("es"))
    dealt = cut(sized.where(first > 0).select("node", "root", "size", F.explode(F.slice("es", 1, first)).alias("x")).select("node", "root", "size", F.col("x.e").alias("bucket")))
    leader = F.min(F.struct(F.xxhash64("bucket", "node").alias("h"), F.col("node").alias("node"))).alias("leader")
    same = F.bit_xor(F.xxhash64("node")).alias("same")
    groups = dealt.groupBy("bucket").agg(leader, same, F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") < F.col("high"))
    # elements that the same texts share, as those of one passage, make one group
    kept = groups.groupBy("same", "n").agg(F.min(F.struct("bucket", "leader.node")).alias("g")).select("g.bucket", F.col("g.node").alias("leader"))
    return cut(dealt.join(kept, "bucket").select("bucket", "node", "size", "leader"))


def near_duplicate_links(plain: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Components of near-duplicate texts: node and root, for texts that have a link."""
    banded = texts.select("node", "size", F.explode("bands").alias("bucket"))
    leader = F.min(F.struct(F.xxhash64("bucket", "node").alias("h"), F.col("node").alias("node"))).alias("lead")
    crowded = banded.groupBy("bucket").agg(leader, F.count("*").alias("n")).where(F.col("n") > 1)
    members = cut(banded.join(crowded.select("bucket", F.col("lead.node").alias("leader")), "bucket"))
    wanted = cut(texts.select("node", "text", "first").join(members.select("node").distinct(), "node"))
    elements = cut(elements_of(plain, wanted))
    led = cut(members.where(F.col("node") != F.col("leader")).groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("met")))
    first = led.groupBy("a").agg(F.max(F.struct("met", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    roots = cut(components(_verified(first, elements, threshold)))
    apart = lambda pairs, roots: _rooted(_rooted(pairs, roots, "a", "ra"), roots, "b", "rb").where(F.col("ra") != F.col("rb"))
    further = cut(apart(led.join(first, ["a", "b"], "left_anti"), roots))
    roots = _merged(roots, _verified(further, among(elements, "node", _ends(further)), threshold))
    open_ = _open(members, roots)
    large = open_.where(F.col("weight") > BLOCK)
    roots = _merged(roots, _compared(open_.where(F.col("weight") <= BLOCK), elements, threshold))
    if large.isEmpty():
        return roots
    few = cut(among(elements, "node", large.select("node")))
    groups = _by_rare_elements(_rooted(large.select("node").distinct(), roots, "node", "root"), few, threshold)
    pairs = groups.where(F.col("node") != F.col("leader")).select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    roots = _merged(roots, _verified(apart(pairs, roots), few, threshold))
    return _merged(roots, _compared(_open(groups, roots), few, threshold))


def classes_of_texts(plain: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each different non-null text: its key, its least id, and the root that stands for its class."""
    texts = distinct_texts(plain)
    return _rooted(texts.select("node", "text", "first"), near_duplicate_links(plain, texts, threshold), "node", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of ``docs``: its id, ``class_id``, and ``is_first``: does it stand for the class?"""
    plain = _plain(docs, doc_id, text)
    found = cut(classes_of_texts(plain, threshold))
    classes = found.join(found.groupBy("root").agg(F.min("first").alias("class_id")), "root").select("text", "class_id")
    rows = plain.select("id", F.col("key.text").alias("text"), F.col("body").isNull().alias("lone")).join(classes, "text", "left")
    class_id = F.when(F.col("lone"), F.col("id")).otherwise(F.col("class_id"))
    return rows.select(F.col("id").alias(doc_id), class_id.alias("class_id"), class_id.eqNullSafe(F.col("id")).alias("is_first"))


def one_of_each_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, that with the least id, null ids last. Rows are told apart by id and text, so null and repeated ids take part like others."""
    plain = _plain(docs, doc_id, text)
    least = F.min(F.struct(F.col("first").isNull().alias("last"), "first", "text")).alias("least")
    kept = classes_of_texts(plain, threshold).groupBy("root").agg(least).select(F.struct("least.text", F.col("least.first").alias("id")).alias("key"))
    keys = kept.unionByName(plain.where(F.col("body").isNull()).select("key").distinct())
    key, row = unused(docs, "_key", "_row")
    keyed = docs.withColumn(key, F.struct(text_key(F.col(text)).alias("text"), F.col(doc_id).alias("id")))
    rows = keyed.join(keys.withColumnRenamed("key", key), key, "left_semi")
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]))
    return rows.groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), others).alias(row)).select(f"{row}.*")
