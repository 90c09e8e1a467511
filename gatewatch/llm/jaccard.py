"""N-gram Jaccard self-join with signature trees.

A document is the set of its word shingles.  Equal sets form one class.  Two classes with Jaccard similarity
``num / den`` or more are linked; documents that links connect are one component.  No link is lost:

1. Routing.  Hash space is cut into parts, more than two linked sets can differ in, so that linked sets agree on
   all shingles of at least one part that is not empty.  Sizes fall into bands that fix the number of parts.
   Each class sends one key per part; the smallest class of a key is its centre, and classes that share a key
   meet in the group of that centre.  Keys flow through sorted, one row at a time in memory.
2. Trees.  A group lies in blocks of bounded size, the centre in each.  Per block a tree is built over the sets in
   order of size; nodes hold OR-combined shingle bitmaps and size ranges.  The dual traversal drops node pairs whose
   largest possible overlap is too small, skips pairs that links already connect, and compares the rest exactly.
3. Groups of several blocks that are not yet one component: what lies outside the largest one meets every block.

Hot groups of near copies cost one comparison or so per member, as the centre links them at once.
Classes are named by a 64-bit digest of the set: two different sets share one with odds of n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORDS, components, free_name, mixed, query, saved, table, words_of

_STEP = 0x9E3779B97F4A7C15
LEAF, FAN = 4, 4


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's ``k``-word shingles; of fewer words, the whole sequence as one."""
    w = WORDS.of(words_of(text))
    if not len(w):
        return w
    n = len(w) - k + 1
    if n <= 0:
        h = np.full(1, len(w), np.uint64)
        for j in range(len(w)):
            h += mixed(w[j:j + 1] + np.uint64(_STEP * (j + 1) % 2**64))
        return mixed(h)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += mixed(w[j:j + n] + np.uint64(_STEP * (j + 1) % 2**64))
    return np.unique(mixed(h))


def digest(s: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    m = mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    both = np.array([m.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(m + np.uint64(len(s))))], np.uint64)
    return int(mixed(both[:1] + mixed(both[1:])).view(np.int64)[0])


@cache
def bands(num: int, den: int) -> list[tuple[int, int, int, int]]:
    """``(from, to, differences, parts)``: sizes that send keys to the band, and in how many shingles a linked pair
    whose smaller set begins there can differ."""
    out, lo = [], 1
    while lo < 2**31:
        nxt = max(lo + 1, lo * 3 // 2)
        h = (nxt - 1) * (den - num) // num
        m = h + 1
        out.append((lo, (nxt - 1) * den // num, h, m if m == 1 else m + 2 + int(np.ceil(2 * m * np.exp(-lo / m)))))
        lo = nxt
    return out


def routing_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """One key per part that is not empty; per empty part too in the rare case that so many are empty that they could
    be all that two linked sets agree on.  Bands that allow no difference need no key: equal sets are one class."""
    n, out = len(s), []
    if not n:
        return s
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s), dtype=np.uint64)])
    for i, (lo, hi, h, m) in enumerate(bands(num, den)):
        if lo > n:
            break
        if n > hi or h == 0:
            continue
        edges = (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(np.uint64)
        at = np.concatenate([[0], np.searchsorted(s, edges), [n]])
        size = np.diff(at)
        key = mixed(total[at[1:]] - total[at[:-1]] + mixed(np.arange(m, dtype=np.uint64) + np.uint64(i << 40) + (size.astype(np.uint64) << np.uint64(20))))
        out.append(key if (size == 0).sum() >= m - h else key[size > 0])
    return np.concatenate(out) if out else s[:0]


class Node:
    __slots__ = ("bits", "low", "high", "extra", "below")

    def __init__(self, bits, low, high, extra, below):
        self.bits, self.low, self.high, self.extra, self.below = bits, low, high, extra, below


def signature_tree(sets: list[np.ndarray], members: list[int], width: int) -> Node | None:
    """A tree over ``members``; a leaf's ``below`` is a member's number, an inner node's a list of nodes."""
    level = []
    for i in members:
        s = sets[i]
        on = np.zeros(width, np.uint8)
        on[(s & np.uint64(width - 1)).astype(np.int64)] = 1
        bits = int.from_bytes(np.packbits(on).tobytes(), "big")
        level.append(Node(bits, len(s), len(s), len(s) - bits.bit_count(), i))
    level.sort(key=lambda x: (x.low, x.bits))
    fan = LEAF
    while len(level) > 1:
        up = []
        for a in range(0, len(level), fan):
            part = level[a:a + fan]
            bits = 0
            for x in part:
                bits |= x.bits
            up.append(Node(bits, part[0].low, max(x.high for x in part), max(x.extra for x in part), part))
        level, fan = up, FAN
    return level[0] if level else None


def may_link(a: Node, b: Node, num: int, den: int) -> bool:
    """False only if no set below ``a`` and set below ``b`` can be linked, by size or by largest overlap."""
    if min(a.high, b.high) * den < max(a.low, b.low) * num:
        return False
    most = min(a.high, b.high, (a.bits & b.bits).bit_count() + min(a.extra, b.extra))
    return most * (num + den) >= num * (a.low + b.low)


def tree_links(ids: list[int], sets: list[np.ndarray], num: int, den: int, sides: tuple[list[int], list[int]] | None = None,
               known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links would: among all sets, or between two ``sides``.  ``known`` names the
    component of each set where it has one already; pairs inside one are skipped."""
    if not ids:
        return []
    width = 64
    while width < 2 * max(map(len, sets)):
        width *= 2
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first: dict[int, int] = {}
    for i, c in enumerate(known or []):
        root[i] = first.setdefault(c, i)
    out = []

    def compare(i: int, j: int) -> None:
        if (x := find(i)) != (y := find(j)):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[y] = x
                out.append((ids[i], ids[j]))

    a = signature_tree(sets, sides[0] if sides else list(range(len(ids))), width)
    b = signature_tree(sets, sides[1], width) if sides else a
    stack = [(a, b)] if a and b else []
    while stack:
        a, b = stack.pop()
        if a is b:
            if isinstance(a.below, list):
                stack += [(x, y) for k, x in enumerate(a.below) for y in a.below[k:]]
        elif may_link(a, b, num, den):
            if not isinstance(a.below, list) and not isinstance(b.below, list):
                compare(a.below, b.below)
            elif isinstance(b.below, list) and (not isinstance(a.below, list) or b.high >= a.high):
                stack += [(a, y) for y in b.below]
            else:
                stack += [(x, b) for x in a.below]
    return out


def sized(docs: DataFrame, k: int) -> DataFrame:
    """``(r, k, n, u)`` per row of ``(r, k, t)``: row number, key, set size, class (null for the empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, u = [], []
            for t in b.column("t").to_pylist():
                s = shingles(t, k)
                n.append(len(s))
                u.append(digest(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("r"), b.column("k"), pa.array(n, pa.int64()), pa.array(u, pa.int64())], ["r", "k", "n", "u"])

    return docs.select("r", "k", "t").mapInArrow(run, f"r long, k {dict(docs.dtypes)['k']}, n long, u long")


def meetings(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Distinct ``(c, u)``: class ``u`` shares a key with centre ``c``, the key's smallest class."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen, ks, us = set(), [], []
            for t in b.column("t").to_pylist():
                s = shingles(t, k)
                if len(s) and (u := digest(s)) not in seen:
                    seen.add(u)
                    ks.append(routing_keys(s, num, den))
                    us.append(np.full(len(ks[-1]), u, np.int64))
            if ks:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ks).view(np.int64)), pa.array(np.concatenate(us))], ["key", "u"])

    def centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, centre and class of the row before
        for b in batches:
            key, u = b.column("key").to_numpy(), b.column("u").to_numpy()
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            starts = np.flatnonzero(new)
            centre = np.repeat(u[starts], np.diff(np.append(starts, len(key))))
            again = np.zeros(len(key), bool)
            again[1:] = ~new[1:] & (u[1:] == u[:-1])
            if last and last[0] == key[0]:
                centre[:starts[1] if len(starts) > 1 else len(key)] = last[1]
                again[0] = last[2] == u[0]
            last = (key[-1], centre[-1], u[-1])
            pick = (u != centre) & ~again
            pairs = np.unique(np.stack([centre[pick], u[pick]], 1), axis=0) if pick.any() else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["c", "u"])

    routed = docs.select("t").mapInArrow(keys, "key long, u long")
    return (routed.repartition("key").sortWithinPartitions("key", "u").mapInArrow(centres, "c long, u long").distinct())


def class_links(docs: DataFrame, rows: DataFrame, k: int, num: int, den: int, block_shingles: int) -> DataFrame:
    """``(a, b)``: links that connect the same classes as all links do."""
    meet = saved(meetings(docs, k, num, den))
    classes = rows.filter("n > 0").groupBy("u").agg(F.min("r").alias("r"), F.max("n").alias("n"))
    need = meet.select("u").union(meet.select("c")).distinct().join(classes, "u")
    texts = saved(docs.select("r", "t").join(need, "r").select("u", "n", "t"))
    sizes = texts.select("u", "n")
    members = meet.join(sizes, "u")
    groups = (members.groupBy("c").agg(F.sum("n").alias("all"))
              .select("c", F.ceil(F.col("all") / block_shingles).cast("int").alias("blocks")))
    members = saved(members.join(groups, "c").withColumn("block", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int")).select("c", "u", "block", "blocks"))
    centres = groups.select("c", F.col("c").alias("u"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t, k) for t in pdf["t"]]
        return pd.DataFrame(tree_links(pdf["u"].tolist(), sets, num, den), columns=["a", "b"], dtype="int64")

    first = saved(members.select("c", "u", "block").unionByName(centres).join(texts.select("u", "t"), "u")
                  .groupBy("c", "block").applyInPandas(inside, "a long, b long"))
    large = saved(members.filter("blocks > 1"))
    if large.isEmpty():
        return first
    # groups of several blocks: whatever is outside the largest component of the group meets every block
    label = components(first)
    large = saved(large.join(label.withColumnRenamed("id", "u"), "u", "left").withColumn("component", F.coalesce("component", "u")))
    parts = large.groupBy("c", "component").agg(F.count("*").alias("rows"))
    main = parts.groupBy("c").agg(F.max(F.struct("rows", "component")).alias("m"), F.count("*").alias("parts")).filter("parts > 1")
    open_ = large.join(main.select("c", F.col("m.component").alias("main")), "c")
    few = open_.filter("component <> main").join(sizes, "u")
    few_blocks = few.groupBy("c").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("q"))
    left = (few.join(few_blocks, "c").withColumn("i", F.pmod(F.xxhash64("u", F.lit(7)), F.col("q")).cast("int"))
            .select("c", "u", "component", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side")))
    right = (open_.join(few_blocks, "c")
             .select("c", "u", "component", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("i"), "block", F.lit(1).alias("side")))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t, k) for t in pdf["t"]]
        sides = tuple(np.flatnonzero(pdf["side"].to_numpy() == s).tolist() for s in (0, 1))
        return pd.DataFrame(tree_links(pdf["u"].tolist(), sets, num, den, sides, pdf["component"].tolist()), columns=["a", "b"], dtype="int64")

    second = (left.unionByName(right.select(*left.columns)).join(texts.select("u", "t"), "u")
              .groupBy("c", "i", "block").applyInPandas(across, "a long, b long"))
    return saved(first.unionByName(second))


def linked(docs: DataFrame, shingle: int, num: int, den: int, block_shingles: int) -> DataFrame:
    """``(r, k, n, component, keep)`` per row of ``(r, k, t)``, a saved table: every step reads it and joins by ``r``."""
    rows = saved(sized(docs, shingle))
    label = components(class_links(docs, rows, shingle, num, den, block_shingles)).withColumnRenamed("id", "u")
    named = rows.join(label, "u", "left").withColumn("l", F.coalesce("component", "u"))
    ends = named.filter(F.col("l").isNotNull()).groupBy("l").agg(
        F.min("k").alias("least"), F.min(F.struct(F.col("k").isNull().alias("z"), "k", "r")).alias("first"))
    out = named.join(ends, "l", "left")
    return out.select("r", "k", "n", F.when(F.col("l").isNull(), F.col("k")).otherwise(F.col("least")).alias("component"),
                      (F.col("l").isNull() | (F.col("r") == F.col("first.r"))).alias("keep"))


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, block_shingles: int = 500_000,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(r, key, n_shingles, component_id, keep)`` per row of ``docs``.

    ``component_id`` is the smallest key reachable by links, the row's own included; ``keep`` holds for one row of
    each component, that with the smallest key (null keys last), then row number.  Null and empty texts have no shingles, link
    with nothing and are kept.  Rows may share a key.  Rows are numbered once, as they are read and saved: ``r``
    tells the result's rows apart and numbers no other scan of ``docs``.
    """
    rows = saved(docs.select(F.monotonically_increasing_id().alias("r"), F.col(key).alias("k"), F.col(text).alias("t")))
    return linked(rows, shingle, num, den, block_shingles).select(
        "r", F.col("k").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "keep")


def one_of_each(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, block_shingles: int = 500_000,
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` without those that repeat another's text nearly, in the columns of ``docs``."""
    r = free_name(docs, "r_")
    rows = saved(docs.withColumn(r, F.monotonically_increasing_id()))
    found = linked(rows.select(F.col(r).alias("r"), F.col(key).alias("k"), F.col(text).alias("t")), shingle, num, den, block_shingles)
    gone = saved(found.filter("not keep").select(F.col("r").alias(r)))
    return rows.join(gone, r, "left_anti").drop(r)


@query("op8_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 90, 100).select("doc_id", "n_shingles", "component_id")
