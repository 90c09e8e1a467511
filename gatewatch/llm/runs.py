"""Periodic runs: stretches of words that repeat with a period, and texts without the repeats.

A run is a maximal stretch of ``length >= max(6, 4 * q)`` words with smallest period ``q``.  Documents of a task are
taken in groups of bounded size, and three steps find all runs of a group at once:

1. Harmonic grid.  A run of period ``q`` holds four neighbouring multiples of ``q``, so the words there are equal.
   For each ``q`` only every ``q``-th word is looked at, which costs ``n/1 + n/2 + n/3 ...`` in all; neighbouring
   places that pass make a chain.
2. Longest common extension.  The places of a chain are extended to both sides by comparing the text with
   itself ``q`` words on.  ``Extension`` answers that in constant time: suffixes are sorted only at places of
   a difference cover modulo 21, any two places reach a pair of such places after at most 20 equal words, and from
   there on the least common prefix between the two ranks counts (a sparse table).
3. Stretches found with several periods have the smallest of them; the others are its multiples.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import query, table

#: A perfect difference set; every residue modulo 21 is a difference of two of these.
MODULUS, COVER = 21, (0, 1, 4, 14, 16)
LEAST_LENGTH, LEAST_POWER = 6, 4
#: Words that are worked on at once; a longer document makes a group of its own.
GROUP_WORDS = 200_000

SCHEMA = ("n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


class Extension:
    """Longest common extensions of ``ids`` (positive numbers) to the right."""

    def __init__(self, ids: np.ndarray):
        v, k, n = MODULUS, len(COVER), len(ids)
        self.n = n
        self.ids = np.concatenate([ids, np.zeros(2 * v, ids.dtype)])
        self.slot = np.full(v, -1)
        self.slot[list(COVER)] = np.arange(k)
        #: difference of two places -> residue of the first at which both lie in the cover
        self.meet = np.zeros(v, np.int64)
        for a in COVER:
            for b in COVER:
                self.meet[(b - a) % v] = a
        at = (np.arange(0, n + v, v)[:, None] + np.array(COVER)).ravel()
        at = at[at < n]
        m = len(at)
        levels = [self._block_ranks(at)]
        lag = k
        while m and levels[-1].max() < m:
            r = levels[-1]
            ahead = np.zeros(m, np.int64)
            ahead[:max(m - lag, 0)] = r[lag:]
            levels.append(np.unique(r * (m + 1) + ahead, return_inverse=True)[1] + 1)
            lag *= 2
        order = np.argsort(levels[-1]) if m else np.empty(0, np.int64)
        self.rank = np.empty(m, np.int64)
        self.rank[order] = np.arange(m)
        self.minima = [self._neighbours(order[:-1], order[1:], levels, at)]
        while len(self.minima[-1]) > (width := 1 << (len(self.minima) - 1)):
            low = self.minima[-1]
            self.minima.append(np.minimum(low[:-width], low[width:]))

    def _block_ranks(self, at: np.ndarray) -> np.ndarray:
        """Ranks (from 1) of the 21 words from each sampled place, several words to a sort key."""
        bits = max(int(self.ids.max(initial=1)).bit_length(), 1)
        per = max(63 // bits, 1)
        keys = []
        for a in range(0, MODULUS, per):
            key = np.zeros(len(at), np.int64)
            for j in range(a, min(a + per, MODULUS)):
                key = (key << bits) | self.ids[at + j]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(at), bool)
        new[:1] = True
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        ranks = np.empty(len(at), np.int64)
        ranks[order] = np.cumsum(new)
        return ranks

    def _first_difference(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from ``i`` and ``j`` on, at most 21."""
        out = np.empty(len(i), np.int64)
        step = np.arange(MODULUS)
        for a in range(0, len(i), 20_000):
            same = self.ids[i[a:a + 20_000, None] + step] == self.ids[j[a:a + 20_000, None] + step]
            out[a:a + 20_000] = np.where(same.all(1), MODULUS, (~same).argmax(1))
        return out

    def _neighbours(self, x: np.ndarray, y: np.ndarray, levels: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes that follow each other in order."""
        k, m = len(COVER), len(at)
        x, y, words = x.copy(), y.copy(), np.zeros(len(x), np.int64)
        for d in range(len(levels) - 1, -1, -1):
            r = np.concatenate([levels[d], [0, -1]])
            same = r[np.minimum(x, m)] == r[np.where(y < m, y, m + 1)]
            x[same] += k << d
            y[same] += k << d
            words[same] += MODULUS << d
        place = np.concatenate([at, np.full(1, self.n)])
        inside = (x < m) & (y < m)
        words[inside] += self._first_difference(place[x[inside]], place[y[inside]])
        return words

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and from ``j`` on are equal (``i`` and ``j`` differ)."""
        shift = (self.meet[(j - i) % MODULUS] - i) % MODULUS
        out = self._first_difference(i, j)
        far = np.flatnonzero(out >= shift)
        far = far[(i[far] + shift[far] < self.n) & (j[far] + shift[far] < self.n)]
        a, b = i[far] + shift[far], j[far] + shift[far]
        ra, rb = (self.rank[(p // MODULUS) * len(COVER) + self.slot[p % MODULUS]] for p in (a, b))
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        level = np.frexp(hi - lo)[1] - 1
        found = np.empty(len(far), np.int64)
        for d in np.unique(level):
            at = level == d
            found[at] = np.minimum(self.minima[d][lo[at]], self.minima[d][hi[at] - (1 << d)])
        out[far] = shift[far] + found
        return out


def _grid(ids: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first, last, period)`` of the chains of places where words at four neighbouring multiples of the period
    are equal.  Documents lie from the longest to the shortest, so those long enough for a period are a prefix."""
    chains = [np.empty((3, 0), np.int64)]
    longest = int(lengths[0]) if len(lengths) else 0
    for q in range(1, longest // LEAST_POWER + 1):
        docs = int(np.searchsorted(-lengths, -max(LEAST_LENGTH, LEAST_POWER * q), side="right"))
        if not docs:
            break
        x = ids[:ends[docs - 1]:q]
        same = x[:-1] == x[1:]
        hit = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(hit):
            gap = np.flatnonzero((np.diff(hit) > 1) | (np.diff(np.searchsorted(ends, hit * q, side="right")) > 0))
            first, last = hit[np.concatenate([[0], gap + 1])], hit[np.concatenate([gap, [len(hit) - 1]])]
            chains.append(np.stack([first * q, last * q, np.full(len(first), q)]))
    return tuple(np.concatenate(chains, 1))


def _stretches(ids: np.ndarray, first: np.ndarray, last: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows ``start, end, period`` of the maximal stretches in the chains: one extension for each, then the chain
    goes on at the next multiple that the stretch does not hold together with its follower."""
    n, found = len(ids), [np.empty((0, 3), np.int64)]
    right, left = Extension(ids), Extension(ids[::-1])
    while len(first):
        end = first + q + right(first, first + q)
        start = first - left(n - first, n - first - q)
        long = end - start >= np.maximum(LEAST_LENGTH, LEAST_POWER * q)
        found.append(np.stack([start, end, q], 1)[long])
        first = np.maximum(first + q, -(-(end - q) // q) * q)
        more = first <= last
        first, last, q = first[more], last[more], q[more]
    return np.concatenate(found)


def _runs(docs: list[np.ndarray]) -> list[np.ndarray]:
    """Rows ``start, length, period`` by start, then period, for each array of word numbers."""
    out = [np.empty((0, 3), np.int64)] * len(docs)
    by_length = sorted(range(len(docs)), key=lambda d: -len(docs[d]))
    word = max((int(x.max(initial=0)) for x in docs), default=0) + 1

    def laid_out(which):
        parts = [p for c, d in enumerate(which) for p in (docs[d], np.array([word + c]))]
        return np.concatenate(parts), np.cumsum([len(docs[d]) + 1 for d in which])

    if not docs:
        return out
    ids, ends = laid_out(by_length)
    first, last, q = _grid(ids, ends, np.array([len(docs[d]) for d in by_length]))
    if not len(first):
        return out
    # extensions are prepared for the documents alone that passed the grid
    owner = np.searchsorted(ends, first, side="right")
    hit = np.unique(owner)
    which = [by_length[d] for d in hit]
    ids, new_ends = laid_out(which)
    starts = np.concatenate([[0], ends])
    new_starts = np.concatenate([[0], new_ends])
    moved = (new_starts[:-1] - starts[hit])[np.searchsorted(hit, owner)]
    start, end, q = _stretches(ids, first + moved, last + moved, q).T
    owner = np.searchsorted(new_ends, start, side="right")
    order = np.lexsort((q, end, start))
    owner, start, end, q = owner[order], start[order], end[order], q[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    owner, start, end, q = owner[first], start[first], end[first], q[first]
    order = np.lexsort((q, start, owner))
    owner, start, end, q = owner[order], start[order], end[order], q[order]
    rows = np.stack([start - new_starts[owner], end - start, q], 1)
    present, begin = np.unique(owner, return_index=True)
    for d, part in zip(present, np.split(rows, begin[1:])):
        out[which[d]] = part
    return out


def _report(words: list[bytes], runs: np.ndarray) -> tuple:
    """The result row of one document."""
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
    best = (None,) * 4
    if len(runs):
        s, n, q = (int(x) for x in min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2])))
        best = (s, n, q, 1000 * n // q)
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [words[w] for w in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return (len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())


def planted(words: list[bytes], key: int | None) -> list[bytes]:
    """The text of the test contract: for one key in ten, the words from some place on repeat a stretch.
    A null key leaves the text as it is."""
    if key is None or not words:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a:a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[:n - a]


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", change=None) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_words``, ``n_runs``, the longest run (ties: smallest start, then
    period) as ``start, length, period, exponent_milli``, the digest of all runs and that of the text without
    repeats.  ``change(words, key)`` may replace a text's words beforehand.

    Null, empty and blank texts have no words and no runs (four nulls, digests of the empty text); null keys and
    repeated rows are rows like others; other columns are not read.  A text is the largest group in a task.
    """
    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()

    def batch_rows(keys: list, texts: list) -> Iterator[tuple]:
        group, size = [], 0

        def flush():
            codes: dict[bytes, int] = {}
            arrays = [np.fromiter((codes.setdefault(w, len(codes) + 1) for w in words), np.int64, len(words))
                      for _, words in group]
            for (k, words), runs in zip(group, _runs(arrays)):
                yield (k, len(words), *_report(words, runs))

        for k, t in zip(keys, texts):
            words = t.encode("utf-8", "surrogatepass").split() if t else []
            words = change(words, k) if change else words
            if group and size + len(words) > GROUP_WORDS:
                yield from flush()
                group, size = [], 0
            group.append((k, words))
            size += len(words)
        yield from flush()

    def work(batches):
        for b in batches:
            out = list(zip(*batch_rows(b.column(0).to_pylist(), b.column(1).to_pylist())))
            if not out:
                continue
            types = [b.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            names = [key, "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return rows.mapInArrow(work, f"`{key}` {kind}, {SCHEMA}")


@query("op13_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(table(spark, sf_dir, "documents"), change=planted)
