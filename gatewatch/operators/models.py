"""Feature tables and models.

Training and scoring are Spark jobs: MLlib where it has the model, per-tree tasks for the isolation
forest.  Models are kept with Spark ML ``save`` / ``load``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import (IDF, CountVectorizer, ElementwiseProduct, Normalizer, StandardScaler,
                                StringIndexer, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features as FE
from .prefix import attach_row, exact_quantiles
from .windows import HOT_ROWS, hour_features

BEHAVIOUR = ["behavior_request_rate", "behavior_error_rate", "behavior_unique_paths",
             "behavior_unique_user_agents", "behavior_avg_response_time",
             "behavior_night_requests_ratio", "behavior_weekend_requests_ratio"]


# -- features -----------------------------------------------------------------------
def basic_features(rows: DataFrame, keep=("event_id",), body: str | None = None) -> DataFrame:
    """M01."""
    c = F.col
    cols = FE.basic_features(c("request_uri"), c(body) if body else F.lit(""), c("request_method"),
                             c("http_user_agent"), F.timestamp_micros("ts_us"), c("status"),
                             c("body_bytes_sent"), c("request_time"))
    return rows.select(*keep, *[v.alias(k) for k, v in cols.items()])


def attack_features(rows: DataFrame, keep=("event_id",), body: str | None = None) -> DataFrame:
    """M02."""
    t = FE.decoded_text(rows, "request_uri", F.col(body) if body else F.lit(""), "_text")
    return t.select(*keep, *[v.alias(k) for k, v in FE.attack_features(F.col("_text")).items()])


def all_features(rows: DataFrame, keep=("event_id",), hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """M01 + M02 + M03 in one row; addresses without history get zeros."""
    h = hour_features(rows, hot_rows=hot_rows)
    c = F.col
    basic = FE.basic_features(c("request_uri"), F.lit(""), c("request_method"), c("http_user_agent"),
                              F.timestamp_micros("ts_us"), c("status"), c("body_bytes_sent"), c("request_time"))
    t = FE.decoded_text(h, "request_uri", F.lit(""), "_text")
    return t.select(*keep, *[v.alias(k) for k, v in basic.items()],
                    *[v.alias(k) for k, v in FE.attack_features(c("_text")).items()],
                    *[F.coalesce(c(b), F.lit(0.0)).alias(b) for b in BEHAVIOUR])


def char_ngrams(text, lo: int = 1, hi: int = 3):
    """Lower-cased character n-grams in text order, repeated blanks taken as one."""
    t = F.regexp_replace(F.lower(text), r"\s\s+", " ")

    def grams(n):
        at = F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1)))
        return F.when(F.length(t) >= n, F.transform(at, lambda i: F.substr(t, i, F.lit(n)))) \
                .otherwise(F.array().cast("array<string>"))

    return F.concat(*[grams(n) for n in range(lo, hi + 1)])


def char_tfidf(docs: DataFrame, text: str, max_features: int = 1000, out: str = "tfidf"):
    """(docs with a sparse unit-length vector, vocabulary).

    The vocabulary is the ``max_features`` most frequent n-grams of the corpus; a term weighs
    ``tf * (ln((1 + n) / (1 + df)) + 1)``, one more than MLlib's inverse document frequency.
    """
    g = docs.withColumn("_grams", char_ngrams(F.col(text)))
    cv = CountVectorizer(inputCol="_grams", outputCol="_tf", vocabSize=max_features).fit(g)
    counted = cv.transform(g)
    idf = IDF(inputCol="_tf", outputCol="_unused").fit(counted)
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf.idf.toArray() + 1.0), inputCol="_tf", outputCol="_w")
    unit = Normalizer(p=2.0, inputCol="_w", outputCol=out)
    return unit.transform(scale.transform(counted)).drop("_grams", "_tf", "_w"), cv.vocabulary


# -- preparation ---------------------------------------------------------------------
def standardise(rows: DataFrame, cols: list[str], out: str = "scaled") -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0.

    MLlib divides by the sample deviation, so the result is rescaled by sqrt(n / (n - 1)).
    """
    a = VectorAssembler(inputCols=cols, outputCol="_raw", handleInvalid="keep").transform(rows)
    m = StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True).fit(a)
    s = attach_row(m.transform(a), rows.agg(F.count(F.lit(1)).alias("_n")))
    f = F.when(F.col("_n") > 1, F.sqrt(F.try_divide(F.col("_n"), F.col("_n") - 1))).otherwise(1.0)
    return s.withColumn(out, F.transform(vector_to_array("_std"), lambda x: x * f)).drop("_raw", "_std", "_n")


def encode_labels(rows: DataFrame, label: str, out: str = "label_index"):
    """Labels numbered in alphabetical order; (rows, classes)."""
    m = StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc").fit(rows)
    return m.transform(rows), list(m.labels)


def stratified_split(rows: DataFrame, label: str, tie: str, test: float = 0.2):
    """80 / 20 split inside each class by a hash of the row id: repeatable, no sampling state."""
    u = F.pmod(F.xxhash64(F.col(tie), F.lit(42)), F.lit(10_000)) / 10_000
    marked = rows.withColumn("_u", u)
    return marked.where(F.col("_u") >= test).drop("_u"), marked.where(F.col("_u") < test).drop("_u")


# -- classifiers ----------------------------------------------------------------------
def train_random_forest(rows: DataFrame, cols: list[str], label: str, tie: str, trees: int = 100, depth: int = 10,
                        folds: int = 0):
    """(model, metrics).  ``folds`` adds cross-validated accuracy."""
    a = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(rows)
    a, classes = encode_labels(a, label)
    train, test = stratified_split(a, "label_index", tie)
    rf = RandomForestClassifier(labelCol="label_index", featuresCol="features", numTrees=trees, maxDepth=depth, seed=42)
    model = rf.fit(train)
    acc = MulticlassClassificationEvaluator(labelCol="label_index", metricName="accuracy")
    got = {"model_name": "RandomForest", "train_accuracy": acc.evaluate(model.transform(train)),
           "validation_accuracy": acc.evaluate(model.transform(test)), "classes": classes,
           "feature_importance": dict(zip(cols, model.featureImportances.toArray().tolist()))}
    if len(classes) == 2:
        got["auc_score"] = BinaryClassificationEvaluator(labelCol="label_index").evaluate(model.transform(test))
    if folds:
        cv = CrossValidator(estimator=rf, estimatorParamMaps=ParamGridBuilder().build(), evaluator=acc,
                            numFolds=folds, seed=42).fit(a)
        got["cv_mean_accuracy"], got["cv_std_accuracy"] = cv.avgMetrics[0], cv.stdMetrics[0]
    return model, got


def classify(model, rows: DataFrame, cols: list[str], classes: list[str], name: str, normal: str = "normal") -> DataFrame:
    """Predictions: is_attack, attack_type, confidence and the probability of each class."""
    a = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(rows)
    p = model.transform(a).withColumn("_p", vector_to_array("probability"))
    labels = F.array(*[F.lit(x) for x in classes])
    lab = F.element_at(labels, F.col("prediction").cast("int") + 1)
    return (p.withColumn("_label", lab)
            .withColumn("is_attack", F.col("_label") != normal)
            .withColumn("attack_type", F.when(F.col("is_attack"), F.col("_label")))
            .withColumn("confidence", F.array_max("_p"))
            .withColumn("probability_scores", F.map_from_arrays(labels, "_p"))
            .withColumn("model_name", F.lit(name))
            .drop("features", "rawPrediction", "probability", "prediction", "_p", "_label"))


def train_perceptron(rows: DataFrame, cols: list[str], label: str, hidden=(256, 128, 64), iterations: int = 50):
    """Dense network over standardised inputs; (model, classes).

    Layers and iterations are those of the reference.  MLlib's units are sigmoid, without dropout, and an iteration (L-BFGS)
    takes all rows; it may end earlier, once the loss settles.
    """
    a = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(rows)
    a, classes = encode_labels(a, label)
    m = MultilayerPerceptronClassifier(labelCol="label_index", featuresCol="features", seed=42, maxIter=iterations,
                                       layers=[len(cols), *hidden, max(len(classes), 2)]).fit(a)
    return m, classes


# -- isolation forest -------------------------------------------------------------------
def _mean_path(n: float) -> float:
    """Average depth of an unsuccessful search in a binary tree over n points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, cut, left, right, depth value); leaves have feature -1."""
    nodes: list = []

    def build(idx, depth):
        me = len(nodes)
        nodes.append(None)
        part = x[idx]
        span = part.max(axis=0) - part.min(axis=0) if len(idx) else np.zeros(x.shape[1])
        usable = np.flatnonzero(span > 0)
        if depth >= limit or len(idx) <= 1 or len(usable) == 0:
            nodes[me] = (-1, 0.0, -1, -1, depth + _mean_path(len(idx)))
            return me
        f = int(rng.choice(usable))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        go = part[:, f] <= cut
        left, right = build(idx[go], depth + 1), build(idx[~go], depth + 1)
        nodes[me] = (f, cut, left, right, 0.0)
        return me

    build(np.arange(len(x)), 0)
    return nodes


NODE_DDL = "tree int, node int, feature int, cut double, left int, right int, depth double"


def grow_forest(rows: DataFrame, vector: str, tie: str, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """One table of tree nodes.

    Each tree wants ``sample`` rows: every row draws a hash per tree, the smallest hashes win.  Rows
    are thinned to an expected few samples' worth before the ranking, so each tree's task ranks a
    bounded number of rows however large the input is, and a tree is grown from ``sample`` rows.
    """
    draw = attach_row(rows.select(F.col(tie).alias("_id"), F.col(vector).alias("_x")),
                      rows.agg(F.count(F.lit(1)).alias("_n")))
    share = lambda *h: F.pmod(F.xxhash64(*h), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # chance that keeps about 4 * sample rows per tree; all rows when there are fewer
    draw = draw.withColumn("_keep", F.least(F.lit(1.0), F.lit(4.0 * sample) / F.col("_n")))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                     lambda t: share(F.col("_id"), t, F.lit(seed)) < F.col("_keep"))
    draw = draw.select("_id", "_x", F.explode(drawn).alias("tree"))
    w = Window.partitionBy("tree").orderBy(F.xxhash64("_id", "tree", F.lit(seed)), "_id")
    chosen = draw.withColumn("_r", F.row_number().over(w)).where(f"_r <= {sample}")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = np.vstack(pdf.sort_values("_r")["_x"].to_numpy())
        nodes = _grow(x, np.random.default_rng(seed * 1000 + t), int(np.ceil(np.log2(max(len(x), 2)))))
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "depth"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", t)
        return out

    return chosen.select("tree", "_r", "_x").groupBy("tree").applyInPandas(one, NODE_DDL)


def collect_forest(nodes: DataFrame, trees: int = 100, sample: int = 256) -> pd.DataFrame:
    """The forest as a local table.  Its size is bounded by construction: at most 2 * sample - 1
    nodes per tree, whatever the size of the training data."""
    pdf = nodes.toPandas()
    if len(pdf) > trees * 2 * sample:
        raise ValueError("node table is larger than the forest parameters allow")
    return pdf.sort_values(["tree", "node"])


def score_forest(rows: DataFrame, vector: str, forest: pd.DataFrame, sample: int = 256, n_train: int | None = None,
                 out: str = "anomaly_score") -> DataFrame:
    """Score in (0, 1], high for isolated rows."""
    trees = [g[["feature", "cut", "left", "right", "depth"]].to_numpy() for _, g in forest.groupby("tree")]
    c = _mean_path(min(sample, n_train or sample)) or 1.0
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def score(xs: pd.Series) -> pd.Series:
        x = np.vstack(xs.to_numpy()) if len(xs) else np.zeros((0, 1))
        total = np.zeros(len(x))
        for t in shared.value:
            at = np.zeros(len(x), dtype=int)
            live = t[at, 0] >= 0
            while live.any():
                i = np.flatnonzero(live)
                f = t[at[i], 0].astype(int)
                goes = x[i, f] <= t[at[i], 1]
                at[i] = np.where(goes, t[at[i], 2], t[at[i], 3]).astype(int)
                live[i] = t[at[i], 0] >= 0
            total += t[at, 4]
        return pd.Series(2.0 ** (-(total / len(shared.value)) / c))

    return rows.withColumn(out, score(F.col(vector)))


def flag_anomalies(scored: DataFrame, contamination: float = 0.1, score: str = "anomaly_score") -> DataFrame:
    """Adds ``decision`` (negative for anomalies) and ``is_anomaly``; the cut is the score that the
    wanted share of the training rows exceeds."""
    s = attach_row(scored, exact_quantiles(scored, [], score, {"_cut": 1.0 - contamination}))
    return (s.withColumn("decision", F.col("_cut") - F.col(score))
            .withColumn("is_anomaly", F.col("decision") < 0).drop("_cut"))


def anomaly_training_report(flagged: DataFrame) -> DataFrame:
    """Ratio, mean, deviation, least and largest decision value of the training rows."""
    d = F.col("decision")
    return flagged.agg(F.avg(F.col("is_anomaly").cast("double")).alias("anomaly_ratio"),
                       F.avg(d).alias("mean_anomaly_score"), F.stddev_pop(d).alias("std_anomaly_score"),
                       F.min(d).alias("min_anomaly_score"), F.max(d).alias("max_anomaly_score"))


def anomaly_alerts(flagged: DataFrame) -> DataFrame:
    """Anomalies whose distance from the cut exceeds 0.5; above 0.8 they are high."""
    d = F.abs("decision")
    return flagged.where(F.col("is_anomaly") & (d > 0.5)).withColumn(
        "severity", F.when(d > 0.8, "high").otherwise("medium"))


# -- combination -------------------------------------------------------------------------
def ensemble_vote(predictions: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """Weighted vote per row.

    ``predictions``: key, model_name, is_attack, attack_type, confidence, probability_scores.
    ``weights``: model_name, weight (validation accuracy, 1 where there is none); models with weight 0
    take no part.
    """
    w = (attach_row(weights, weights.agg(F.sum("weight").alias("_t")))
         .select("model_name", (F.col("weight") / F.col("_t")).alias("w")).where("w > 0"))
    p = predictions.join(w, "model_name")
    votes = p.groupBy(key).agg(
        F.sum(F.when(F.col("is_attack"), F.col("w")).otherwise(0.0)).alias("_yes"), F.sum("w").alias("_all"),
        (F.sum(F.col("confidence") * F.col("w")) / F.sum("w")).alias("confidence"))
    types = (p.where("is_attack and attack_type is not null").groupBy(key, "attack_type").agg(F.sum("w").alias("s"))
             .groupBy(key).agg(F.max_by("attack_type", F.struct("s", "attack_type")).alias("attack_type")))
    probs = (p.select(key, "w", F.explode("probability_scores").alias("class", "prob"))
             .groupBy(key, "class").agg(F.sum(F.col("prob") * F.col("w")).alias("s")))
    norm = probs.groupBy(key).agg(F.sum("s").alias("_s"), F.map_from_entries(
        F.collect_list(F.struct("class", "s"))).alias("_m"))
    norm = norm.select(key, F.transform_values("_m", lambda k, v: F.when(
        F.col("_s") > 0, v / F.col("_s")).otherwise(v)).alias("probability_scores"))
    return (votes.join(types, key, "left").join(norm, key, "left")
            .withColumn("is_attack", F.col("_yes") > F.col("_all") / 2).drop("_yes", "_all")
            .withColumn("model_name", F.lit("Ensemble")))


def best_model(metrics: DataFrame) -> DataFrame:
    """The model with the highest latest validation accuracy above 0."""
    latest = metrics.groupBy("model_name").agg(F.max_by("validation_accuracy", "trained_us").alias("score"))
    return latest.where("score > 0").orderBy(F.desc("score"), "model_name").limit(1)


def default_prediction(rows: DataFrame) -> DataFrame:
    """What is answered before any model is trained."""
    return (rows.withColumn("is_attack", F.lit(False)).withColumn("attack_type", F.lit(None).cast("string"))
            .withColumn("confidence", F.lit(0.5)).withColumn("probability_scores", F.create_map(
                F.lit("normal"), F.lit(0.5), F.lit("attack"), F.lit(0.5)))
            .withColumn("model_name", F.lit("default")))


def prediction_statistics(predictions: DataFrame) -> DataFrame:
    """AG28."""
    n, a = F.count(F.lit(1)), F.count_if(F.col("is_attack"))
    return predictions.agg(n.alias("total_predictions"), a.alias("attack_predictions"),
                           F.coalesce(F.try_divide(a, n), F.lit(0.0)).alias("attack_detection_rate"))
