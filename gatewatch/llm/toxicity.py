"""Toxicity: cumulative-link ordinal regression over sparse word features.

``P(grade >= k) = sigmoid(w . x - t_k)`` for ``t_1 < t_2 < t_3``: one weight vector serves all thresholds.
``severity`` is the expected grade, the sum of the three probabilities.

Labels say toxic or not.  Toxic rows are graded by evidence: grade 1 with at most one occurrence of a marker
word, 2 with two, 3 with more; a marker is a word far likelier in toxic rows.  The model is fitted on at most
``sample_rows`` labelled rows (keys with the smallest MD5, and of their rows those with the smallest hash of key and
text; rows equal in both count once); word counts, candidate words and the fit cover that whole sample, scoring
covers every whole text of all rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, query, saved, table

_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
GRADES = 3


def terms(text: str | None) -> list[bytes]:
    """Lower-cased words; every ASCII character but letters parts them."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []


@dataclass
class OrdinalModel:
    weights: dict[bytes, float]
    thresholds: np.ndarray

    def probabilities(self, text: str | None) -> np.ndarray:
        """``P(grade >= 1..3)``; a null or empty text has no words and so the base rate."""
        words = terms(text)
        hit = self.weights.keys() & set(words)
        x = 0.0
        if hit:
            n = Counter(w for w in words if w in hit)
            x = sum(self.weights[w] * np.log1p(n[w]) for w in sorted(hit))
        return 1 / (1 + np.exp(np.clip(self.thresholds - x, -60, 60)))


def fit_ordinal(rows: list[list[tuple[int, float]]], grade: np.ndarray, n_terms: int, l2: float = 2e-5,
                steps: int = 1000, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch Adam on the cumulative-link likelihood."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([j for r in rows for j, _ in r], int)
    val = np.array([v for r in rows for _, v in r], float)
    reached = (grade[:, None] >= np.arange(1, GRADES + 1)).astype(float)
    p = np.zeros(n_terms + GRADES)
    p[n_terms] = 2.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        gaps = np.exp(p[n_terms + 1:])
        t = p[n_terms] + np.concatenate([[0.0], np.cumsum(gaps)])
        x = np.bincount(doc, val * p[col], len(rows)) if len(col) else np.zeros(len(rows))
        q = 1 / (1 + np.exp(np.clip(t - x[:, None], -60, 60)))
        q = np.concatenate([np.ones((len(rows), 1)), q, np.zeros((len(rows), 1))], 1)
        i = np.arange(len(rows))
        like = np.maximum(q[i, grade] - q[i, grade + 1], 1e-9)  # P(grade) = P(>= g) - P(>= g + 1)
        slope = q * (1 - q)
        up, down = slope[i, grade] / like, slope[i, grade + 1] / like
        dx = -(up - down) / len(rows)
        dt = np.zeros((len(rows), GRADES + 2))
        dt[i, grade] += up / len(rows)
        dt[i, grade + 1] -= down / len(rows)
        dt = dt[:, 1:-1].sum(0)
        g = np.concatenate([np.bincount(col, val * dx[doc], n_terms) if len(col) else np.zeros(n_terms),
                            [dt.sum()], [dt[k + 1:].sum() * gaps[k] for k in range(GRADES - 1)]])
        g[:n_terms] += l2 * p[:n_terms]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(p[n_terms + 1:])
    return p[:n_terms], p[n_terms] + np.concatenate([[0.0], np.cumsum(gaps)])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int, key: str, text: str) -> DataFrame:
    """``(k, y, t)`` of at most ``sample_rows`` different rows of as many labelled keys at most.

    A key labelled twice takes the larger label.  Rows equal in key and text count once; of more rows those with the
    smallest hash of key and text stay.
    """
    chosen = (labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
              .groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
              .orderBy(F.md5(F.col("k").cast("string")), "k").limit(sample_rows))
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    light = (rows.join(F.broadcast(chosen), "k").select("k", "y", "th").distinct()
             .orderBy(F.xxhash64("k", "th"), "k", "th").limit(sample_rows))
    return saved(rows.join(F.broadcast(saved(light)), ["k", "th"]).select("k", "y", "t").distinct())


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, max_terms: int = 4096, min_chi2: float = 20.0,
        marker_ratio: float = 20.0, key: str = "doc_id", text: str = "text") -> OrdinalModel:
    """Fit on the bounded sample.  Words enter by the chi-square of their row counts, at most ``max_terms``.

    Without a labelled row of either kind nothing is toxic.
    """
    sample = labelled_sample(docs, labels, "toxic", sample_rows, key, text)
    n = {int(r["y"] > 0): r["n"] for r in sample.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return OrdinalModel({}, np.array([20.0, 21.0, 22.0]))

    def rows_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [Counter(), Counter()]
            for y, t in zip(b.column("y").to_pylist(), b.column("t").to_pylist()):
                seen[y > 0].update(set(terms(t)))
            words = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([seen[0][w] for w in words], pa.int64()),
                                              pa.array([seen[1][w] for w in words], pa.int64())], ["w", "a0", "a1"])

    a0, a1 = F.col("a0").cast("double"), F.col("a1").cast("double")
    total = float(n0 + n1)
    chi2 = (total * F.pow(a1 * (n0 - a0) - a0 * (n1 - a1), 2) / ((a0 + a1) * (total - a0 - a1) * n0 * n1 + 1e-9))
    ratio = ((a1 + 0.5) / (n1 + 1)) / ((a0 + 0.5) / (n0 + 1))
    stats = (sample.mapInArrow(rows_with, "w binary, a0 long, a1 long").groupBy("w").agg(F.sum("a0").alias("a0"), F.sum("a1").alias("a1"))
             .filter("a0 + a1 >= 3").select("w", chi2.alias("chi2"), ratio.alias("ratio")).filter(F.col("chi2") >= min_chi2)
             .orderBy(F.desc("chi2"), "w").limit(max_terms).collect())
    index = {bytes(r["w"]): j for j, r in enumerate(stats)}
    markers = {bytes(r["w"]) for r in stats if r["ratio"] >= marker_ratio}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grade, cols, vals = [], [], []
            for y, t in zip(b.column("y").to_pylist(), b.column("t").to_pylist()):
                c = Counter(w for w in terms(t) if w in index)
                hits = sum(c[w] for w in markers)
                grade.append(0 if y <= 0 else 1 if hits <= 1 else 2 if hits == 2 else 3)
                cols.append([index[w] for w in sorted(c)])
                vals.append([float(np.log1p(c[w])) for w in sorted(c)])
            yield pa.RecordBatch.from_arrays([b.column("k").cast(pa.string()), pa.array(grade, pa.int32()), pa.array(cols, pa.list_(pa.int32())),
                                              pa.array(vals, pa.list_(pa.float64()))], ["k", "grade", "cols", "vals"])

    # at most sample_rows x max_terms cells
    got = sorted(sample.mapInArrow(features, "k string, grade int, cols array<int>, vals array<double>").collect())
    w, t = fit_ordinal([list(zip(r["cols"], r["vals"])) for r in got], np.array([r["grade"] for r in got]), len(index))
    return OrdinalModel({word: float(w[j]) for word, j in index.items()}, t)


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with column ``name``: a struct of ``severity`` (0 to 3) and ``p`` (the chance of grade 1 or more)."""
    @F.pandas_udf("severity double, p double")
    def graded(t: pd.Series) -> pd.DataFrame:
        p = [model.probabilities(x) for x in t]
        return pd.DataFrame({"severity": [float(x.sum()) for x in p], "p": [float(x[0]) for x in p]})

    return docs.withColumn(name, graded.asNondeterministic()(F.col(text)))


def reject(docs: DataFrame, model: OrdinalModel, least: float = 0.5, text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose chance of being toxic is below ``least``, in the columns of ``docs``."""
    name = free_name(docs, "toxicity")
    return score(docs, model, text, name).filter(F.col(f"{name}.p") < least).drop(name)


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.col("toxicity.severity").alias("severity"), F.col("toxicity.p").alias("p_toxic"),
                                     (F.col("toxicity.p") >= 0.5).alias("toxic"))
