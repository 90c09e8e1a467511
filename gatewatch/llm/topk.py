"""Exact top-k inner products from an impact-ordered, score-at-a-time index.

Every dimension of a block of vectors has its postings quantised by value and cut into segments of equal impact range.  A
query reads segments of all dimensions by descending impact ``|q_d| * level`` and keeps, per vector, a lower and an upper
bound of its score; what is unread in a dimension counts at most the level reached there.  Reading stops only when few
vectors can still be members: those whose upper bound reaches the k-th lower bound.  All of these, however many, are
rescored exactly.  The queries of a group read together: a segment's postings are a column of a matrix, and what each
query reads of it is its weight, or nothing.

Vectors lie in blocks of bounded size by hashed id, queries likewise; each pair of blocks is one task group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import query, saved, table

#: Levels of a dimension, and segments that they are read in.
LEVELS, SEGMENTS = 256, 4
#: Shares of all postings after which the bounds are looked at.
ROUNDS = (0.5, 1.0)


class Index:
    """Impact-ordered postings of one block (``n x d`` integers), for positive and for negative query weights."""

    def __init__(self, v: np.ndarray):
        self.v = v
        if not v.shape[1]:
            return  # vectors without components: all scores are 0
        low, high = v.min(0), v.max(0)
        self.step = (high - low + 1) / LEVELS
        self.postings, self.size = {}, {}
        for sign in (1, -1):
            up = (v - low) if sign > 0 else (high - v)
            level = np.minimum((up / self.step).astype(np.int64), LEVELS - 1)
            segment = SEGMENTS - 1 - level // (LEVELS // SEGMENTS)  # 0 has the highest impact
            inside = [segment == s for s in range(SEGMENTS)]
            self.size[sign] = np.stack([x.sum(0) for x in inside], 1)
            self.postings[sign] = [(np.where(x, level, 0).astype(np.float32).T.copy(), x.astype(np.float32).T.copy()) for x in inside]

    def possible(self, q: np.ndarray, k: int, self_at: int, enough: int) -> np.ndarray:
        """Rows that may be among the ``k`` best of one query."""
        return self.possible_each(q[None], k, np.array([self_at]), enough)[0]

    def possible_each(self, q: np.ndarray, k: int, self_at: np.ndarray, enough: int) -> list[np.ndarray]:
        """For each query (a row of ``q``) the rows that may be among its ``k`` best; proven for all others that they are not."""
        n, d = self.v.shape
        if n <= enough or not d:
            return [np.arange(n)] * len(q)
        weight = np.abs(q) * self.step  # what a level adds
        sign = np.where(q >= 0, 1, -1)
        impact = weight[:, :, None] * np.arange(SEGMENTS, 0, -1)
        size = np.where((sign > 0)[:, :, None], self.size[1], self.size[-1]).reshape(len(q), -1)
        by = np.argsort(-impact.reshape(len(q), -1), 1, kind="stable")
        mass = np.empty(size.shape)
        np.put_along_axis(mass, by, np.cumsum(np.take_along_axis(size, by, 1), 1) - np.take_along_axis(size, by, 1), 1)
        mass = (mass / (n * d)).reshape(impact.shape)  # share of the postings read before this segment
        # sums of d products in single precision are off by less than this
        slack = (d + 8) * 2e-7 * LEVELS * weight.sum(1)
        out, open_, low = [None] * len(q), np.arange(len(q)), np.zeros((len(q), n), np.float32)
        before = 0.0
        for share in ROUNDS:
            w, m = weight[open_], mass[open_]
            read, fresh = m < share, (m < share) & (m >= before)
            done = LEVELS - (LEVELS // SEGMENTS) * read.sum(2)  # the level reached in each dimension
            spread = np.zeros((len(open_), n), np.float32) + (w * np.maximum(done, 1)).sum(1)[:, None].astype(np.float32)
            for s in range(SEGMENTS):
                for side, (levels, inside) in ((x, self.postings[x][s]) for x in (1, -1)):
                    mine = sign[open_] == side
                    low += np.where(mine & fresh[:, :, s], w, 0).astype(np.float32) @ levels
                    if done.any():
                        spread -= np.where(mine & read[:, :, s], w * (np.maximum(done, 1) - 1), 0).astype(np.float32) @ inside
            left = []
            for i, x in enumerate(open_):
                mine = low[i].copy()
                if self_at[x] >= 0:
                    mine[self_at[x]] = -np.inf
                kth = np.partition(mine, n - k)[n - k]
                out[x] = np.flatnonzero(low[i] + spread[i] >= kth - 3 * slack[x])
                if len(out[x]) > enough:
                    left.append(i)
            open_, low, before = open_[left], low[left], share
            if not left:
                break
        return out

    def top(self, q: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query ids and exact scores of the ``k`` best rows other than its ``own``, ties to the smaller id.  ``ids`` ascend."""
        at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        at = np.where(ids[at] == own, at, -1)
        out = []
        for x, able in enumerate(self.possible_each(q, min(k, len(ids)), at, 32 * k)):
            able = able[able != at[x]]
            s = self.v[able] @ q[x]
            best = np.lexsort((ids[able], -s))[:k]
            out.append((ids[able][best], s[best]))
        return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 8192, query_rows: int = 512) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every query the ``k`` best of ``vectors`` (both ``id, v array<long>``).

    A vector is never its own query's answer.  Equal ids count once, with the smallest vector.  Vectors meet
    queries of the same length only.  Scores are 64-bit sums: components must be small enough for them.
    """
    vectors = saved(vectors.groupBy("id").agg(F.min("v").alias("v")))
    queries = saved(queries.groupBy("id").agg(F.min("v").alias("v")))
    nb = max(1, -(-vectors.count() // block_rows))
    nq = max(1, -(-queries.count() // query_rows))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("id", "v", F.size("v").alias("d"), place(nb).alias("b")).withColumn("q", numbers(nq))
    right = queries.select("id", "v", F.size("v").alias("d"), place(nq).alias("q")).withColumn("b", numbers(nb))

    def best(key, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            rows = rows.sort_values("id")
            index, ids = Index(np.stack(rows["v"].to_numpy()).astype(np.int64).reshape(len(rows), -1)), rows["id"].to_numpy()
            for a in range(0, len(asked), 128):  # bounds of 128 queries at a time
                own = asked["id"].to_numpy()[a:a + 128]
                qs = np.stack(asked["v"].to_numpy()[a:a + 128]).astype(np.int64).reshape(len(own), -1)
                for x, (found, s) in zip(own, index.top(qs, ids, own, k)):
                    out.append(pd.DataFrame({"query_id": x, "vec_id": found, "score": s}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    keys = ["d", "b", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """``(id, v)`` with ``floor(scale * x)``; null ids and vectors with null or non-finite components are left out."""
    x = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(~bad)
            .select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v")))


_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10"""


@query("op6_topk", _SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = saved(integer_vectors(table(spark, sf_dir, "embeddings")))
    return search(v, v.filter("id % 100 = 0"))
