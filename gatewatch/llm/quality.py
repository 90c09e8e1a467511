"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after the other and adds a shallow tree's leaves to that feature's lookup
table; then the strongest pairs of features get two-way tables in the same way.  A score is the sum of looked-up
table cells, so every part of it can be read off.

Features describe the whole text only (lengths, character classes, repetition); labels, language, source and key
are never inputs.  The model is fitted on at most ``sample_rows`` labelled training rows (smallest MD5 of the key).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import query, saved, table

FEATURES = ["log_chars", "log_words", "word_length", "upper", "digits", "symbols", "punctuation", "other_bytes",
            "line_words", "short_lines", "repeated_lines", "distinct_words", "top_word", "repeated_pairs",
            "words_with_symbol", "capital_starts", "sentence_ends", "bars", "longest_word", "single_letters"]
_UPPER = np.zeros(256); _UPPER[65:91] = 1  # noqa: E702
_DIGIT = np.zeros(256); _DIGIT[48:58] = 1  # noqa: E702
_MARKS = np.zeros(256); _MARKS[[ord(c) for c in ".,;:!?'\"-()"]] = 1  # noqa: E702
_SYMBOL = np.array([33 <= i < 127 and not chr(i).isalnum() and not _MARKS[i] for i in range(256)], float)
_HIGH = np.array([i >= 128 for i in range(256)], float)
_ALNUM = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum())


def features(text: str | None) -> list[float]:
    """The values of ``FEATURES``; a null text counts as empty and gives zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, m = len(raw), len(words)
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen = Counter(words)
    ends = sum(1 for w in words if w[-1] in b".!?")
    marked = sum(c for w, c in seen.items() if w.translate(None, _ALNUM).strip(b".,;:!?'\"-()"))
    double = sum(c for w, c in seen.items() if w.endswith((b"!!", b"??", b"..")))
    return [float(np.log1p(n)), float(np.log1p(m)), n / m, float(chars @ _UPPER) / n, float(chars @ _DIGIT) / n,
            float(chars @ _SYMBOL) / n, float(chars @ _MARKS) / n, float(chars @ _HIGH) / n, float(np.log1p(m / len(lines))),
            sum(1 for x in lines if len(x) < 20) / len(lines), 1 - len(set(lines)) / len(lines), len(seen) / m,
            max(seen.values()) / m, sum(1 for a, b in zip(words, words[1:]) if a == b) / m, marked / m,
            sum(1 for w in words if 65 <= w[0] < 91) / m, (ends - double) / m, words.count(b"|") / m,
            float(np.log1p(max(map(len, seen)))), sum(1 for w in words if len(w) == 1) / m]


@dataclass
class AdditiveModel:
    """Cut points and a table per feature, a two-way table per chosen pair, and an intercept."""
    cuts: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in self.pairs.items():
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _gain(g, h, l2: float):
    return g * g / (h + l2)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float, least: float) -> np.ndarray:
    """Leaf values per bin of the best tree with up to ``leaves`` leaves over ordered bins."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:]):
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            if len(gl):
                s = _gain(gl, hl, l2) + _gain(gt - gl, ht - hl, l2) - _gain(gt, ht, l2)
                s = np.where((hl >= least) & (ht - hl >= least), s, -1)
                best = max(best, (float(s.max()), a + 1 + int(s.argmax())))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def best_cross(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """One cut on each axis of a two-way table: the gain and the four leaves' values per cell."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = G[:-1, :-1], H[:-1, :-1]
    if not a.size:
        return 0.0, np.zeros_like(g)
    quads = [(a, b), (G[:-1, -1:] - a, H[:-1, -1:] - b), (G[-1:, :-1] - a, H[-1:, :-1] - b),
             (G[-1, -1] - G[:-1, -1:] - G[-1:, :-1] + a, H[-1, -1] - H[:-1, -1:] - H[-1:, :-1] + b)]
    s = sum(_gain(x, y, l2) for x, y in quads)
    r, c = np.unravel_index(int(s.argmax()), s.shape)
    out = np.empty_like(g)
    for q, (rows, cols) in enumerate([(slice(0, r + 1), slice(0, c + 1)), (slice(0, r + 1), slice(c + 1, None)),
                                      (slice(r + 1, None), slice(0, c + 1)), (slice(r + 1, None), slice(c + 1, None))]):
        out[rows, cols] = quads[q][0][r, c] / (quads[q][1][r, c] + l2)
    return float(s[r, c] - _gain(G[-1, -1], H[-1, -1], l2)), out


def fit_additive(x: np.ndarray, y: np.ndarray, max_bins: int = 32, rounds: int = 150, pair_rounds: int = 40,
                 n_pairs: int = 8, rate: float = 0.15, l2: float = 5.0) -> AdditiveModel:
    """Cyclic boosting with logistic loss; with one class only, a constant."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, max_bins + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else [np.zeros(0)] * len(FEATURES)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(cuts, float(np.log(share / (1 - share))), [np.zeros(len(c) + 1) for c in cuts])
    if len(set(y.tolist())) < 2:
        return model
    b = model.bins(x)
    z = np.full(len(x), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            g, h = slopes()
            step = rate * shallow_tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)), 4, l2, 2.0)
            t += step
            z += step[b[:, j]]

    def cells(i, j, v):
        ni, nj = len(model.tables[i]), len(model.tables[j])
        return np.bincount(b[:, i] * nj + b[:, j], v, ni * nj).reshape(ni, nj)

    g, h = slopes()
    ranked = sorted(((best_cross(cells(i, j, g), cells(i, j, h), l2)[0], (i, j)) for i, j in combinations(range(len(cuts)), 2)), reverse=True)
    for _, p in ranked[:n_pairs]:
        model.pairs[p] = np.zeros((len(model.tables[p[0]]), len(model.tables[p[1]])))
    for _ in range(pair_rounds):
        for (i, j), t in model.pairs.items():
            g, h = slopes()
            step = rate * best_cross(cells(i, j, g), cells(i, j, h), l2)[1]
            t += step
            z += step[b[:, i], b[:, j]]
    return model


@F.pandas_udf(ArrayType(DoubleType()))
def text_features(t: pd.Series) -> pd.Series:
    return pd.Series([features(x) for x in t])


def fold(key: Column, n: int) -> Column:
    """``crc32`` of the key as text modulo ``n``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def fit(rows: DataFrame, labels: DataFrame, train: Column, sample_rows: int = 50_000, label: str = "quality") -> AdditiveModel:
    """Fit on ``rows`` (``k``, ``x``) whose key is labelled and passes ``train``.

    A key labelled twice takes the larger label; at most ``sample_rows`` keys are used.  Rows equal in key and features
    count once; of more rows those with the smallest hash of both stay, so one key cannot fill the sample.
    """
    chosen = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(train)
              .groupBy(F.col("doc_id").alias("k")).agg(F.max(label).cast("int").alias("y"))
              .orderBy(F.md5(F.col("k").cast("string")), "k").limit(sample_rows))
    got = rows.join(F.broadcast(chosen), "k").select("k", "y", "x").distinct().orderBy(F.xxhash64("k", "x"), "k", "x").limit(sample_rows).collect()
    x = np.array([r["x"] for r in got], float).reshape(len(got), len(FEATURES))
    return fit_additive(x, np.array([float(r["y"] > 0) for r in got]))


def score(rows: DataFrame, model: AdditiveModel, x: str = "x") -> DataFrame:
    """``rows`` with ``score``: looked-up cells of all bins added, batch by batch."""
    @F.pandas_udf("double")
    def added(v: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(v.to_numpy()).astype(float)) if len(v) else [], dtype=float)

    return rows.withColumn("score", added(F.col(x)))


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = saved(docs.select(F.col("doc_id").alias("k"), text_features("text").alias("x")))
    model = fit(rows, labels, fold(F.col("doc_id"), 3) != 1)
    return score(rows, model).select(F.col("k").alias("doc_id"), (fold(F.col("k"), 3) == 1).alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"))
