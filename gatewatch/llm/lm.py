"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised to levels; a count of level ``l`` is in the filter once for each of
``1..l``.  A probe asks for level after level until one is absent, so the filter answers with the level and never
with less than it.  Pair probabilities are smoothed towards word probabilities:
``P(w | h) = (c(h, w) + mu * P(w)) / (c(h) + mu)`` with ``P(w) = (c(w) + 1) / (N + V + 1)``, all counts read from
the filter but the totals ``N`` and ``V``.

The filter grows with the n-grams, so no worker can be sent all of it.  It is cut into segments by n-gram hash, as
many as the tokens ask for, and probes go to the segment instead: a chunk of texts sends each segment the distinct
n-grams of the chunk that lie there, with their counts in training text, and gets back one level for each.  The task
of a segment sums the counts, builds the segment's filter and answers from it.  A segment sees an n-gram at most once
a chunk, however often it occurs, and works on one segment at a time.

The base score uses exact counts: the ``common`` most frequent words are broadcast, all others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORDS, mixed, query, saved, table
from .quality import fold

END, START = b" ", b"\n"  # no word holds white space
CHUNK = 8_000_000
#: Low bits of a hash that only choose the segment.
DROPPED = np.uint64(24)
STEP = np.uint64(0x9E3779B97F4A7C15)

#: Lowest count of each level, growing by an eighth.
EDGES = [1]
while EDGES[-1] < 2**40:
    EDGES.append(max(EDGES[-1] + 1, EDGES[-1] * 9 // 8))
EDGES = np.array(EDGES, np.int64)
#: The count that a level is read as.
VALUES = np.concatenate([[0.0], np.sqrt(EDGES[:-1] * (EDGES[1:] - 1.0)), [float(EDGES[-1])]])


def tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """The texts in chunks of some 8 MB: number of texts, for each START, words, END as places in the chunk's distinct
    words, the tokens of each text, and the distinct words, of which START and END are the first two."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(ends // CHUNK, append=-1)) + 1
    for lo, hi in zip(np.append(0, cuts[:-1]), cuts):
        part = pc.fill_null(column.slice(lo, hi - lo), "")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(part))
        coded = lists.flatten().dictionary_encode()
        ids, distinct = coded.indices.to_numpy().astype(np.int64) + 2, coded.dictionary.cast(pa.binary())
        doc = np.repeat(np.arange(len(part)), pc.list_value_length(lists).to_numpy())
        empty = pc.index(distinct, pa.scalar(b"", pa.binary())).as_py()  # white space at an end of a text
        if empty >= 0:
            ids, doc = ids[ids != empty + 2], doc[ids != empty + 2]
        size = np.bincount(doc, minlength=len(part)) + 2
        at = np.zeros(size.sum(), np.int64)
        at[np.arange(len(ids)) + 2 * doc + 1] = ids
        at[size.cumsum() - 1] = 1
        yield len(part), at, size, pa.concat_arrays([pa.array([START, END], pa.binary()), distinct])


def pair_hashes(h: np.ndarray) -> np.ndarray:
    return mixed(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:] + np.uint64(1))


class LogFrequencyFilter:
    """Levels of n-gram hashes in ``bits_per_item`` bits for each n-gram and level."""

    def __init__(self, h: np.ndarray, count: np.ndarray, bits_per_item: int):
        level = np.searchsorted(EDGES, count, "right")
        self.bits = max(64, int(level.sum()) * bits_per_item)
        on = np.zeros(self.bits, bool)
        for n in range(1, int(level.max(initial=0)) + 1):
            h, level = h[level >= n], level[level >= n]
            for b in self.places(h, n):
                on[b] = True
        self.map = np.packbits(on, bitorder="little")

    def places(self, h: np.ndarray, level: int) -> Iterator[np.ndarray]:
        """Three bit numbers for each ``(h, level)``."""
        low = np.uint64(0xFFFFFFFF)
        g = mixed(h + np.array([level], np.uint64) * STEP)
        for i in range(3):
            yield (((g + np.uint64(i) * (g >> np.uint64(32))) & low) * np.uint64(self.bits)) >> np.uint64(32)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The level of each n-gram hash, by probes for rising levels while all bits are set."""
        out = np.zeros(len(h), np.uint8)
        alive = np.arange(len(h))
        for level in range(1, len(EDGES) + 1):
            hit = np.ones(len(alive), bool)
            for b in self.places(h[alive], level):
                hit &= (self.map[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            alive = alive[hit]
            if not len(alive):
                break
            out[alive] = level
        return out


def ngrams(at: np.ndarray, size: np.ndarray, hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct n-gram hashes by segment, how many lie in each segment, and the place among them of each
    distinct word and then of each pair.  No pair spans two texts."""
    pairs = np.delete(pair_hashes(hashes[at]), size.cumsum()[:-1] - 1)
    h, place = np.unique(np.concatenate([hashes, pairs]), return_inverse=True)
    segment = (h % np.uint64(segments)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    return h[order], np.bincount(segment, minlength=segments), rank[place]


def squeezed(x: np.ndarray) -> bytes:
    """``x`` compressed, the lowest bytes of all numbers first, then the next."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def restored(data: bytes, kind: type) -> np.ndarray:
    """What ``squeezed`` was given."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def sent_ngrams(chunks: DataFrame, segments: int) -> DataFrame:
    """``(segment, chunk, h, c)``: for each segment and chunk the upper 40 bits of the hashes of the chunk's distinct
    n-grams, as ascending differences, and their counts in its training texts.  In one segment of some million n-grams 40 bits tell them apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                at, size, hashes, learns = unpacked(r)
                h, lens, place = ngrams(at, size, hashes, segments)
                taken = np.repeat(learns, size)
                within = np.ones(len(at), bool)
                within[size.cumsum() - 1] = False  # a pair belongs to its first token, and the last has none
                c = (np.bincount(place[:len(hashes)], np.bincount(at[taken], minlength=len(hashes)), len(h))
                     + np.bincount(place[len(hashes):][taken[within]], minlength=len(h))).astype(np.uint32)
                some = np.flatnonzero(lens)
                cuts = lens[some].cumsum()[:-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), r["chunk"])),
                     pa.array([squeezed(np.diff(x, prepend=x[:1] * 0)) for x in np.split(h >> DROPPED, cuts)], pa.binary()),
                     pa.array(list(map(squeezed, np.split(c, cuts))), pa.binary())], ["segment", "chunk", "h", "c"])

    return chunks.select("chunk", "at", "size", "hashes", "learns").mapInArrow(run, "segment int, chunk long, h binary, c binary")


def unpacked(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (restored(r["at"], np.uint32).astype(np.int64), np.frombuffer(r["size"], np.int64), np.frombuffer(r["hashes"], np.uint64),
            np.frombuffer(r["learns"], bool))


def answered(sent: DataFrame, segments: int, bits_per_item: int) -> DataFrame:
    """``(chunk, segment, levels)``: the level of each n-gram that a chunk sent, from the segment's filter."""
    def answers(segment: int, rows: list[tuple]) -> pa.RecordBatch:
        sent = [np.cumsum(restored(h, np.uint64)) for _, h, _ in rows]
        lens = np.array([len(h) for h in sent])
        h, place = np.unique(np.concatenate(sent) << DROPPED, return_inverse=True)
        count = np.bincount(place, np.concatenate([restored(c, np.uint32) for _, _, c in rows]), len(h)).astype(np.int64)
        seen = count > 0
        levels = LogFrequencyFilter(h[seen], count[seen], bits_per_item).levels(h)[place]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in rows], pa.int64()), pa.array([segment] * len(rows), pa.int32()),
                                           pa.array(list(map(squeezed, np.split(levels, lens.cumsum()[:-1]))), pa.binary())],
                                          ["chunk", "segment", "levels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["segment"] != now and rows:
                    yield answers(now, rows)
                    rows = []
                now = r["segment"]
                rows.append((r["chunk"], r["h"], r["c"]))
        if rows:
            yield answers(now, rows)

    return (sent.repartition(segments, "segment").sortWithinPartitions("segment")
            .mapInArrow(run, "chunk long, segment int, levels binary"))


def model_scores(chunks: DataFrame, n: int, v: int, mu: float, segments: int, bits_per_item: int) -> DataFrame:
    """``(r, score)``: log10 probability of each text of the chunks."""
    def scores(r: dict, levels: list[bytes]) -> pa.RecordBatch:
        at, size, hashes, _ = unpacked(r)
        place = ngrams(at, size, hashes, segments)[2]
        read = VALUES[np.concatenate([restored(x, np.uint8) for x in levels])[place]]
        c1, c2 = read[:len(hashes)], read[len(hashes):]
        starts = size.cumsum() - size
        here = np.delete(at, starts)
        before = np.delete(at, size.cumsum() - 1)
        p1 = (c1 + 1) / (n + v + 1)
        p = (np.minimum(c2, np.minimum(c1[here], c1[before])) + mu * p1[here]) / (c1[before] + mu)
        logs = np.log10(np.minimum(p, 1.0))
        return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["rows"], np.int64)), pa.array(np.add.reduceat(logs, starts - np.arange(len(size))))],
                                          ["r", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["levels"] is not None:
                    got.append(r["levels"])
                    continue
                if now is not None:
                    yield scores(now, got)
                now, got = r, []
        if now is not None:
            yield scores(now, got)

    levels = answered(sent_ngrams(chunks, segments), segments, bits_per_item)
    texts = chunks.select("chunk", F.lit(-1).alias("segment"), "rows", "at", "size", "hashes", "learns")
    return (texts.unionByName(levels, allowMissingColumns=True).repartition(segments, "chunk").sortWithinPartitions("chunk", "segment")
            .mapInArrow(run, "r long, score double"))


def word_counts(train: DataFrame, text: str) -> DataFrame:
    """``(w, c)``: exact counts of words and text ends, summed per chunk first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, at, _, words in tokens(b.column("t")):
                n = np.bincount(at, minlength=len(words))
                n[0] = 0
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(some)), pa.array(n[some].astype(np.int64))], ["w", "c"])

    return train.select(F.col(text).alias("t")).mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def score(docs: DataFrame, train: Column, mu: float = 2000.0, common: int = 2**17, segment_tokens: int = 2**21,
          bits_per_item: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key, n_tokens, n_known, train_tokens, base_score, score`` (log10).

    The model learns from rows that pass ``train``.  Null texts count as empty: one end token.  Repeated rows are
    scored, and learned from, each.  With nothing to learn from, counts are 0.  The filter has a segment for every
    ``segment_tokens`` tokens; their number does not change what is counted.
    """
    sc = docs.sparkSession.sparkContext
    counts = saved(word_counts(docs.filter(train), text))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"], total["v"]
    most = {bytes(r["w"]): r["c"] for r in counts.orderBy(F.desc("c"), "w").limit(common).collect()}
    top = sc.broadcast({START: 0, **most})
    kind = dict(docs.dtypes)[key]
    of_row = f"r long, k {kind}, n_tokens long, known long, logs double, rest array<binary>, times array<long>"
    of_chunk = "chunk long, rows binary, size binary, learns binary, at binary, hashes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(top.value)}
        # of the common words, and last for all others: hash, exact count
        hashes = np.append(WORDS.of(list(number)), np.uint64(0))
        exact = np.append(np.fromiter(top.value.values(), np.float64, len(number)), 0.0)
        for b in batches:
            done = 0
            for texts, at, size, words in tokens(b.column("t")):
                rows = b.slice(done, texts)
                done += texts
                # once for each distinct word
                spelt = words.to_pylist()
                place = np.fromiter(map(number.get, spelt, repeat(-1)), np.int64, len(spelt))
                h, c = hashes[place], exact[place]
                rare = np.flatnonzero(place < 0)
                h[rare] = WORDS.of([spelt[i] for i in rare])
                # and for each token
                starts = size.cumsum() - size
                base, known = np.log10(c + 1)[at], (c > 0).astype(np.int64)[at]
                lacks = np.flatnonzero(place[at] < 0)
                owner = np.repeat(np.arange(texts), size)[lacks]
                pairs, times = np.unique(owner * len(words) + at[lacks], return_counts=True)
                offsets = pa.array(np.searchsorted(pairs, np.arange(texts + 1) * len(words)).astype(np.int32))
                ids = rows.column("r").to_numpy()
                per_row = [rows.column("r"), rows.column("k"), pa.array(size - 1, pa.int64()), pa.array(np.add.reduceat(known, starts), pa.int64()),
                           pa.array(np.add.reduceat(base, starts)), pa.ListArray.from_arrays(offsets, words.take(pa.array(pairs % len(words)))),
                           pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))]
                learns = rows.column("l").to_numpy(zero_copy_only=False).astype(bool)
                per_chunk = [pa.array([ids[0]], pa.int64()),
                             *(pa.array([x.tobytes()], pa.binary()) for x in (ids, size, learns)),
                             pa.array([squeezed(at.astype(np.uint32))], pa.binary()), pa.array([h.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(per_row + [pa.nulls(texts, x.type) for x in per_chunk], names)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, x.type) for x in per_row] + per_chunk, names)

    names = [x.split()[0] for x in f"{of_row}, {of_chunk}".split(", ")]
    read = saved(docs.select(F.monotonically_increasing_id().alias("r"), F.col(key).alias("k"), F.col(text).alias("t"),
                             F.coalesce(train, F.lit(False)).alias("l")).mapInArrow(run, f"{of_row}, {of_chunk}"))
    rows, chunks = read.filter("chunk is null").select(names[:7]), read.filter("chunk is not null").select(names[7:])
    size = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    scores = model_scores(chunks, n, v, mu, size // segment_tokens + 1, bits_per_item)
    rare = rows.select("r", F.explode(F.arrays_zip("rest", "times")).alias("z")).select("r", F.col("z.rest").alias("w"), F.col("z.times").alias("t"))
    # words without a row in counts add log10(0 + 1) = 0
    sums = rare.join(counts, "w").groupBy("r").agg(F.sum("t").alias("t"), F.sum(F.col("t") * F.log10(F.col("c") + 1)).alias("l"))
    zero = F.lit(0)
    return (rows.drop("rest", "times").join(scores, "r").join(sums, "r", "left")
            .select(F.col("k").alias(key), "n_tokens", (F.col("known") + F.coalesce("t", zero)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                    (F.col("logs") + F.coalesce("l", zero) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score"))


@query("op9_lm_score")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 7) == 2
    out = score(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
