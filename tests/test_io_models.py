"""Tables written and read back, and model invariants."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewatch.operators import models as M
from gatewatch.sources import logs, sinks


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="gatewatch-test-")


def test_access_log_is_partitioned_by_date(spark, data, tmp):
    sinks.write_access_log(data.access_log, f"{tmp}/log", 5)
    back = spark.read.parquet(f"{tmp}/log")
    assert back.count() == data.access_log.count() and "date" in back.columns
    plan = back.where("date = '2024-01-01' and remote_addr = '8.8.4.4'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "EqualTo(remote_addr,8.8.4.4)" in plan


def test_audit_and_exports(spark, data, tmp):
    from gatewatch.operators.audit import security_events
    e = security_events(data.security_input, data.malicious_ips)
    sinks.write_audit(e, f"{tmp}/audit")
    back = spark.read.parquet(f"{tmp}/audit")
    assert dict(back.dtypes)["threat_indicators"] == "string" and back.count() == e.count()
    s = sinks.training_samples(data.access_log.withColumn("x", F.length("request_uri")), "event_type", ["x"])
    sinks.export_json(s, f"{tmp}/samples")
    assert logs.import_samples(spark, f"{tmp}/samples").count() == s.count()


def test_log_lines_round_trip(spark, data, tmp):
    e = logs.parse_entries(data.json_log, "json", "api")
    sinks.write_log_lines(e, f"{tmp}/json", "json")
    back = logs.read_log_file(spark, f"{tmp}/json", "json", "api")
    same = ["level", "ip_address", "request_method", "request_url", "response_status"]
    assert e.select(same).exceptAll(back.select(same)).count() == 0
    assert logs.read_log_file(spark, f"{tmp}/json", "json", "api", limit=10).count() == 10


def test_threat_file_and_missing_source(spark, tmp):
    open(f"{tmp}/ips.txt", "w").write("1.2.3.4\n  5.6.7.8 \n\n1.2.3.4\n")
    assert {r[0] for r in logs.read_threat_list(spark, f"{tmp}/ips.txt").collect()} == {"1.2.3.4", "5.6.7.8"}
    df, errors = logs.read_all_sources({"gone": lambda: spark.read.text(f"{tmp}/none")})
    assert df is None and set(errors) == {"gone"}


def test_isolation_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(0)
    pts = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(zip(rng.uniform(50, 70, 100), rng.uniform(20, 40, 100)))]
    df = spark.createDataFrame(pts, "id bigint, x array<double>")
    forest = M.collect_forest(M.grow_forest(df, "x", "id"))
    assert forest["tree"].nunique() == 100
    train = M.flag_anomalies(M.score_forest(df, "x", forest, n_train=100))
    rep = M.anomaly_training_report(train).collect()[0]
    assert rep.anomaly_ratio == pytest.approx(0.1, abs=0.02)
    probe = spark.createDataFrame([(1, [60.0, 30.0]), (2, [200.0, 300.0])], "id bigint, x array<double>")
    s = {r.id: r.anomaly_score for r in M.score_forest(probe, "x", forest, n_train=100).collect()}
    cut = train.agg((F.max(F.col("decision") + F.col("anomaly_score")))).collect()[0][0]
    assert s[1] < cut < s[2]


def test_forest_sample_stays_bounded(spark):
    df = spark.range(60_000).select("id", F.array(F.rand(1), F.rand(2)).alias("x"))
    nodes = M.grow_forest(df, "x", "id", trees=10, sample=64)
    per = nodes.groupBy("tree").count().collect()
    assert len(per) == 10 and all(r["count"] <= 2 * 64 for r in per)


def test_random_forest_separates(spark):
    rows = [(i, float(i % 50), "attack" if i % 50 > 25 else "normal") for i in range(400)]
    df = spark.createDataFrame(rows, "event_id bigint, f double, label string")
    model, got = M.train_random_forest(df, ["f"], "label", "event_id", trees=5, depth=4, folds=2)
    assert got["validation_accuracy"] > 0.9 and got["auc_score"] > 0.9 and got["classes"] == ["attack", "normal"]
    p = M.classify(model, df, ["f"], got["classes"], "RandomForest")
    assert p.where("is_attack and attack_type = 'attack'").count() > 150
    assert M.default_prediction(df).where("confidence = 0.5 and not is_attack").count() == 400


def test_dense_network_is_trained_whole(spark, monkeypatch):
    from types import SimpleNamespace

    from gatewatch.plans.q_models import m08
    fits = []

    class Watched(M.MultilayerPerceptronClassifier):
        def fit(self, rows, *args):
            fits.append((self.getLayers()[1:-1], self.getMaxIter(), rows.count()))
            return super().fit(rows, *args)

    monkeypatch.setattr(M, "MultilayerPerceptronClassifier", Watched)
    log = spark.range(2_000).selectExpr(
        "id AS event_id", "1704067200000000 + id * 1000 AS ts_us", "concat('10.0.0.', id % 50) AS remote_addr",
        """CASE WHEN id % 40 = 0 THEN concat('/f?p=../../etc/passwd', id) WHEN id % 20 = 1 THEN '/s?q=1 union select a from b'
           ELSE concat('/p/', id % 13) END AS request_uri""", "'GET' AS request_method", "'Mozilla/5.0' AS http_user_agent",
        "CAST(NULL AS string) AS http_referer", "200L AS status", "5L AS body_bytes_sent", "id / 1000 AS request_time")
    got = {(r.label, r.attack_type): r.n for r in m08(SimpleNamespace(access_log=log)).collect()}
    assert fits == [([256, 128, 64], 50, 2_000)]
    assert got == {("path_traversal", "path_traversal"): 50, ("sql_injection", "sql_injection"): 100, ("normal", None): 1_850}
