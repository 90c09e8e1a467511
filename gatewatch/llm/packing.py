"""Packing along a space-filling curve.

A document's token counts are hashed to ``buckets``, projected to four dimensions and quantised; the Hilbert key
of that point orders documents so that neighbours on the curve have similar words.  Documents are laid end to end
in that order and cut every ``length`` tokens, so sequences are full and hold neighbours.  The last, shorter run
is cut into powers of two, which need no padding.

Tokens are computed once and saved as 16-bit ids.  Range bounds come from the saved keys; token totals per range
give every range its first position, so no step sees more than one range's documents, as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from zlib import crc32

from .common import query, saved, table

DIMS, DEPTH, BUCKETS = 4, 10, 1024
#: Texts that are encoded as a whole: white space other than single spaces and line breaks between words, or a
#: possible special token.  The 0 byte separates words below.
_ODD = (r"[\t\r\x00\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
        r"|^[ \n]|[ \n]$|[ \n][ \n]|<\|")
#: Bytes of text that are encoded at once; a longer text makes a slice of its own.
SLICE_BYTES = 8 << 20


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Token bytes of a byte-level vocabulary, which writes bytes that do not print as characters from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in prints}
    byte.update({chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in set(prints))})
    return {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if all(c in byte for c in t)}


class Encoder:
    """Ids of the byte-level BPE that ``path`` describes for the tokenizers library, as 16-bit bytes.

    tiktoken merges the same vocabulary by the same ranks, several times faster; tests hold its ids against those of
    tokenizers.  The vocabulary never joins text across a space before a word, so texts with single spaces and line
    breaks only are cut into words, the distinct words of a slice are encoded in one call and the ids are copied to
    wherever the word stands; any other text is encoded as a whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        self.special = {a.content: i for i, a in t.get_added_tokens_decoder().items()}
        ranks = {k: v for k, v in byte_ranks(t.get_vocab(with_added_tokens=False)).items() if v not in self.special.values()}
        self.bpe = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.bytes_of = np.zeros(1 << 16, np.int64)
        self.bytes_of[list(ranks.values())] = [len(t) for t in ranks]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all the words one after another, and where each word's begin and how many they are."""
        led = pc.match_substring_regex(words, "^[ \n]").to_numpy(zero_copy_only=False)
        # words that begin with a space or line break stay apart when joined; token lengths show where each ends
        one = "".join(words.filter(pa.array(led)).to_pylist())
        store = np.array(self.bpe.encode_ordinary(one), np.uint16)
        upto = np.concatenate([[0], np.cumsum(self.bytes_of[store])])
        wide = pc.binary_length(words).to_numpy().astype(np.int64)
        size, begin = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        edge = np.concatenate([[0], np.searchsorted(upto, np.cumsum(wide[led]))])
        begin[led], size[led] = edge[:-1], np.diff(edge)
        bare = [self.bpe.encode_ordinary(w) for w in words.filter(pa.array(~led)).to_pylist()]
        size[~led] = [len(x) for x in bare]
        begin[~led] = len(store) + np.cumsum(size[~led]) - size[~led]
        return np.concatenate([store, np.array([i for x in bare for i in x], np.uint16)]), begin, size

    def ids(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, those of null being none."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        cut = pc.replace_substring(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", "\0\n"), " ", "\0 ")
        words = pc.split_pattern(cut.cast(pa.large_string()), "\0")
        coded = words.flatten().dictionary_encode()
        store, begin, size = self.words(coded.dictionary)
        code = coded.indices.to_numpy()
        lens = size[code]
        ends = np.concatenate([[0], np.cumsum(lens)])
        flat = store[np.arange(ends[-1]) + np.repeat(begin[code] - ends[:-1], lens)]
        bounds = ends[words.offsets.to_numpy() - words.offsets[0].as_py()] if len(words) else np.zeros(1, np.int64)
        plain = iter(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        out = []
        for i, o in enumerate(odd):
            if o:
                out.append(np.array(self.bpe.encode(texts[i].as_py(), allowed_special="all"), "<u2").tobytes())
            else:
                a, b = next(plain)
                out.append(flat[a:b].tobytes())
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@cache
def _projection(vocabulary: int = 65536) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, BUCKETS, vocabulary), rng.standard_normal((BUCKETS, DIMS))


def point(ids: np.ndarray) -> np.ndarray:
    """The document's place in ``[0, 2**DEPTH)**DIMS``: hashed log counts, unit length, projected, squashed."""
    bucket, axes = _projection()
    v = np.log1p(np.bincount(bucket[ids], minlength=BUCKETS)) if len(ids) else np.zeros(BUCKETS)
    norm = np.sqrt(v @ v)
    p = (v / norm) @ axes if norm else np.zeros(DIMS)
    return np.clip(((np.tanh(p / 2) + 1) / 2 * 2**DEPTH).astype(np.int64), 0, 2**DEPTH - 1)


def hilbert(x: np.ndarray) -> np.ndarray:
    """Hilbert key of each row of ``x`` (``n x DIMS`` integers of ``DEPTH`` bits): Gray-code rotations from the
    highest bit down, then the bits of all axes interleaved."""
    x = x.T.copy()
    q = 1 << (DEPTH - 1)
    while q > 1:
        p = q - 1
        for i in range(DIMS):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, DIMS):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (DEPTH - 1)
    while q > 1:
        t ^= np.where((x[DIMS - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(DEPTH - 1, -1, -1):
        for i in range(DIMS):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with ``t`` of at most ``SLICE_BYTES``, or one row."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(b.column("t")), 0).to_numpy())
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, SLICE_BYTES + (upto[lo - 1] if lo else 0), "right")))
        yield b.slice(lo, hi - lo)
        lo = hi


def tokenised(docs: DataFrame, path: str, key: str, text: str) -> DataFrame:
    """``(k, curve, n, ids)``: the key, curve position with a tie-breaking text hash, token count with the
    closing 0, and 16-bit ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for part in slices(b):
                ids = [x + b"\0\0" for x in enc.ids(part.column("t"))]
                at = hilbert(np.stack([point(np.frombuffer(x, "<u2")[:-1]) for x in ids]))
                tie = part.column("salt").to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(41)
                curve = (at << 23) | tie.astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(curve), pa.array([len(x) // 2 for x in ids], pa.int64()),
                                                  pa.array(ids, pa.binary())], ["k", "curve", "n", "ids"])

    kind = dict(docs.dtypes)[key]
    salt = F.xxhash64(F.col(key), F.col(text), F.monotonically_increasing_id())
    return (docs.select(F.col(key).alias("k"), F.col(text).alias("t"), salt.alias("salt"))
            .mapInArrow(run, f"k {kind}, curve long, n long, ids binary"))


def pack(docs: DataFrame, path: str, length: int = 1024, ranges: int | None = None, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """One row per piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Null and empty texts are the closing 0 alone.  Rows may share keys; each is a document.  ``ranges`` bounds
    how much one task lays out (default: four times the shuffle partitions).
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = saved(tokenised(docs, path, key, text))
    bounds = np.array(tokens.approxQuantile("curve", np.linspace(0, 1, ranges + 1)[1:-1].tolist(), 0.2 / ranges) or [], float).astype(np.int64)
    bounds = np.unique(bounds)

    @F.pandas_udf(T.IntegerType())
    def in_range(c):
        import pandas as pd
        return pd.Series(np.searchsorted(bounds, c.to_numpy(), "right").astype(np.int32))

    totals = tokens.select(in_range("curve").alias("range"), "n").groupBy("range").agg(F.sum("n").alias("n")).collect()
    base, at = {}, 0
    for r in sorted(totals):  # one row a range
        base[r["range"]] = at
        at += r["n"]
    total, full = at, at // length
    tail, cuts = full * length, []  # where the sequences behind the full ones begin
    while tail < total:
        cuts.append(tail)
        tail += 1 << ((total - tail).bit_length() - 1)
    edges = np.array([*cuts, total], np.int64)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, where = None, 0
        for b in batches:
            k_at, cols = [], [[] for _ in range(6)]
            for i, (rng, n, ids) in enumerate(zip(b.column("range").to_pylist(), b.column("n").to_pylist(), b.column("ids"))):
                if rng != now:
                    now, where = rng, base[rng]
                wide = np.frombuffer(ids.as_buffer(), "<u2").astype("<u4")
                a = where
                while a < where + n:
                    if a < full * length:
                        seq, first, end = a // length, a // length * length, (a // length + 1) * length
                    else:
                        j = int(np.searchsorted(edges, a, "right")) - 1
                        seq, first, end = full + j, int(edges[j]), int(edges[j + 1])
                    e = min(end, where + n)
                    k_at.append(i)
                    for c, v in zip(cols, (a - where, e - a, crc32(wide[a - where:e - where].tobytes()), n, seq, a - first)):
                        c.append(v)
                    a = e
                where += n
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(k_at, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)],
                                             ["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = dict(docs.dtypes)[key]
    ordered = (tokens.withColumn("range", in_range("curve")).repartition("range")
               .sortWithinPartitions("range", "curve", "k", "n", "ids"))
    out = ordered.mapInArrow(lay, f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("k", key)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
