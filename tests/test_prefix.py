"""Split totals, previous rows, quantiles against brute force, with one key that holds most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewatch.operators import prefix as P

S = P.SECOND


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    out = []
    for i in range(3000):
        k = "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(40)}"
        out.append((k, rnd.randrange(0, 900) * S + rnd.choice([0, 0, 1, 999_999]), i, f"/u{rnd.randrange(30)}",
                    rnd.choice([200, 404])))
    return out, spark.createDataFrame(out, "k string, ts bigint, id bigint, uri string, status int")


@pytest.mark.parametrize("slice_us,hot", [(0, None), (400 * S, None), (0, 100), (400 * S, 5), (0, 10**6)])
def test_windowed_totals(rows, slice_us, hot, monkeypatch):
    local, df = rows
    monkeypatch.setattr(P, "STRETCHES", 50)
    got = P.windowed_totals(df, ["k"], "ts", [
        P.Rolling("n60", F.lit(1), 60 * S), P.Rolling("n404", F.when(F.col("status") == 404, 1), 120 * S),
        P.Rolling("strict", F.lit(1), 60 * S, strict=True),
        P.RollingDistinct("uris", F.col("uri"), 90 * S, {"odd": F.col("uri").rlike("[13579]$")})], slice_us, hot)
    got = {r.id: r for r in got.collect()}
    assert len(got) == len(local)
    for k, t, i, u, s in random.Random(1).sample(local, 400):
        same = [r for r in local if r[0] == k and r[1] <= t]
        g = got[i]
        assert g.n60 == sum(r[1] >= t - 60 * S for r in same)
        assert g.strict == sum(r[1] > t - 60 * S for r in same)
        assert g.n404 == sum(r[4] == 404 and r[1] >= t - 120 * S for r in same)
        in90 = {r[3] for r in same if r[1] >= t - 90 * S}
        assert g.uris == len(in90) and g.odd == sum(int(x[-1]) % 2 for x in in90)
        assert (g.uri, g.status) == (u, s)


def test_rolling_totals(rows):
    local, df = rows
    got = P.rolling_totals(df, ["k"], "ts", [
        P.Rolling("n", F.lit(1), None), P.Rolling("recent", F.lit(1), 60 * S, strict=True),
        P.RollingDistinct("uris", F.col("uri"), None)], tie="id", slice_us=50 * S)
    got = {r.id: r for r in got.collect()}
    for k, t, i, _, _ in random.Random(2).sample(local, 400):
        upto = [r for r in local if r[0] == k and (r[1], r[2]) <= (t, i)]
        assert got[i].n == len(upto)
        assert got[i].recent == sum(r[1] > t - 60 * S for r in upto)
        assert got[i].uris == len({r[3] for r in upto})
    with pytest.raises(ValueError):
        P.rolling_totals(df, ["k"], "ts", [P.RollingDistinct("u", F.col("uri"), 5)], tie="id")


def test_previous_and_numbers(rows):
    local, df = rows
    prev = {r.id: r.prev_ts for r in P.previous_time(df, ["k"], "ts", "id", slice_us=30 * S).collect()}
    num = {r.id: r.rn for r in P.row_numbers(df, ["k"], "ts", "id", slice_us=30 * S).collect()}
    for k in {r[0] for r in local}:
        o = sorted((r[1], r[2]) for r in local if r[0] == k)
        for n, (t, i) in enumerate(o):
            assert prev[i] == (o[n - 1][0] if n else None)
            assert num[i] == n + 1


@pytest.mark.parametrize("accuracy,most", [(10_000, 10**6), (100, 10**6), (100, 60), (40, 20)])
def test_exact_quantiles(spark, accuracy, most):
    rng = np.random.default_rng(3)
    data = [("big", float(x)) for x in rng.lognormal(0, 2, 4000)] + [("two", 1.0), ("two", 5.0), ("one", 3.0)]
    data += [("ties", float(x)) for x in rng.integers(0, 4, 900)]
    df = spark.createDataFrame(data, "k string, v double")
    got = P.exact_quantiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p0": 0.0, "p100": 1.0}, accuracy, most)
    for r in got.collect():
        x = [v for k, v in data if k == r.k]
        want = np.percentile(x, [50, 95, 99, 0, 100])
        assert np.allclose([r.p50, r.p95, r.p99, r.p0, r.p100], want)
    all_ = P.exact_quantiles(df, [], "v", {"m": 0.5}, accuracy, most).collect()[0].m
    assert np.isclose(all_, np.percentile([v for _, v in data], 50))


def test_no_join_or_second_scan_in_windowed_plan(rows):
    _, df = rows
    out = P.windowed_totals(df, ["k"], "ts", [P.Rolling("n", F.lit(1), S), P.RollingDistinct("u", F.col("uri"), S)])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    physical = out._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange") == 1


def test_a_flooded_minute_runs_in_many_tasks(spark):
    """Nine rows in ten come from one address within a minute, most of them for one uri."""
    n = 40_000
    df = spark.range(n).selectExpr("id", "CASE WHEN id % 10 < 9 THEN 'hot' WHEN id % 20 = 19 THEN NULL ELSE concat('k', id % 700) END AS k",
                                   f"CAST(CASE WHEN id % 10 < 9 THEN id * 1500 ELSE id * 50000 END AS BIGINT) AS ts",
                                   "CASE WHEN id % 3 > 0 THEN '/same' ELSE concat('/u', id % 1000) END AS uri")
    specs = [P.Rolling("n", F.lit(1), 20 * S), P.RollingDistinct("uris", F.col("uri"), 30 * S)]
    out = P.windowed_totals(df, ["k"], "ts", specs, hot_rows=5_000)
    whole = P.windowed_totals(df, ["k"], "ts", specs)
    key = lambda r: (r.id, r.k, r.ts, r.uri, r.n, r.uris)
    assert sorted(map(key, out.collect()), key=str) == sorted(map(key, whole.collect()), key=str)
    # largest group that any window or join sorts: rows of one stretch
    stretch = (30 * S + 1) // P.STRETCHES + 1
    most = df.where("k = 'hot'").groupBy((F.col("ts") / stretch).cast("bigint")).count().agg(F.max("count")).first()[0]
    assert most < n / 1000
