"""Greedy filters, limiter and adaptive threshold against one-row-at-a-time loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewatch.operators import alerts, bans, gaps

S = 1_000_000


def greedy(rows, gap):
    out, free = [], {}
    for k, t, i, g in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if t >= free.get(k, -1):
            out.append((k, t, i))
            free[k] = t + (gap if gap else g)
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    return [("hot" if rnd.random() < .6 else f"k{rnd.randrange(20)}", rnd.randrange(0, 4000) * S // 2, i,
             rnd.choice([5, 20, 60]) * S) for i in range(2500)]


@pytest.mark.parametrize("segment", [None, 45 * S, 61 * S])
def test_fixed_gap(spark, rows, segment):
    df = spark.createDataFrame(rows, "k string, ts bigint, id bigint, g bigint")
    got = alerts.suppress(df, "k", "ts", "id", 30, segment)
    assert sorted((r.k, r.ts, r.id) for r in got.collect()) == greedy(rows, 30 * S)


@pytest.mark.parametrize("segment", [None, 30 * S, 100 * S])
def test_gap_of_the_kept_row(spark, rows, segment):
    df = spark.createDataFrame(rows, "k string, ts bigint, id bigint, g bigint")
    got = gaps.greedy_keep(df, ["k"], "ts", "id", F.col("g"), 60 * S, segment)
    assert sorted((r.k, r.ts, r.id) for r in got.collect()) == greedy(rows, None)


def test_published_example(spark):
    df = spark.createDataFrame([("a", t * S, t) for t in (0, 100, 299, 300, 450, 601)], "k string, ts bigint, id bigint")
    assert sorted(r.id for r in alerts.suppress(df, "k", "ts", "id").collect()) == [0, 300, 601]


def test_limiter_first_five_of_seven(spark):
    df = spark.createDataFrame([("c", i * S, i) for i in range(7)], "k string, ts bigint, id bigint")
    got = sorted((r.id, r.allowed, r.remaining) for r in gaps.sliding_limit(df, ["k"], "ts", "id", 5, 10 * S).collect())
    assert [g[1] for g in got] == [True] * 5 + [False] * 2
    assert [g[2] for g in got] == [4, 3, 2, 1, 0, 0, 0]


@pytest.mark.parametrize("most,window,batch", [(4, 10, 10_000), (1, 10, 10_000), (50, 10, 7), (3, 400, 7), (4, 1, 1)])
def test_limiter_brute_force(spark, rows, most, window, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "k string, ts bigint, id bigint, g bigint")
        got = {r.id: (r.allowed, r.remaining) for r in gaps.sliding_limit(df, ["k"], "ts", "id", most, window * S).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept = {}
    for k, t, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        q = kept[k] = [x for x in kept.get(k, []) if x > t - window * S]
        ok = len(q) < most
        if ok:
            q.append(t)
        assert got[i] == (ok, most - len(q))


def test_limiter_of_a_flood_is_no_loop_over_rows():
    import time
    t = np.arange(5_000_000, dtype=np.int64) * 3
    began = time.perf_counter()
    ok = gaps._limited(t, np.empty(0, np.int64), 20, 10 * S)
    assert ok.sum() == 40 and time.perf_counter() - began < 2
    began = time.perf_counter()
    assert gaps._limited(t * S, np.empty(0, np.int64), 20, 10 * S).all() and time.perf_counter() - began < 5


@pytest.mark.parametrize("block", [50, 120, 50_000])
def test_dynamic_threshold(spark, block):
    rnd = random.Random(5)
    rows = [(rnd.choice(["cpu_usage", "other"]), i * S, i, rnd.gauss(60, 10), False) for i in range(700)]
    # a stretch with no normal value in reach: the threshold must stand still
    rows = [(n, t, i, v, 300 <= i < 460 or rnd.random() < .1) for n, t, i, v, _ in rows]
    df = spark.createDataFrame(rows, "name string, ts_us bigint, event_id bigint, value double, is_anomaly boolean")
    got = {r.event_id: r for r in alerts.dynamic_thresholds(df, fallback=30.0, block=block, slice_us=40 * S).collect()}
    for name, first in (("cpu_usage", 80.0), ("other", 30.0)):
        base = thr = first
        hist = []
        for n, _, i, v, a in rows:
            if n != name:
                continue
            hist.append((v, a))
            normal = [x for x, bad in hist[-50:] if not bad]
            if len(hist) >= 10 and normal:
                base = base * 0.95 + np.mean(normal) * 0.05
                thr = base + np.std(normal) * 0.1
            assert np.isclose(got[i].baseline, base) and np.isclose(got[i].threshold, thr)
            assert got[i].exceeded == (v > thr)


def test_threshold_stays_near_normal_values(spark):
    rnd = random.Random(1)
    rows = [("cpu_usage", i * S, i, 60 + rnd.uniform(-10, 10), False) for i in range(20)]
    df = spark.createDataFrame(rows, "name string, ts_us bigint, event_id bigint, value double, is_anomaly boolean")
    last = max(alerts.dynamic_thresholds(df, {"cpu_usage": 70.0}).collect(), key=lambda r: r.ts_us)
    assert 50 <= last.threshold <= 90


def test_ban_intervals_do_not_overlap(spark, rows):
    df = spark.createDataFrame([(k, t, i, g // S) for k, t, i, g in rows],
                               "ip string, ts_us bigint, event_id bigint, duration_s bigint")
    per = {}
    for r in bans.ban_intervals(df, 60, 90 * S).collect():
        per.setdefault(r.ip, []).append((r.start_us, r.end_us))
    for v in per.values():
        v.sort()
        assert all(a[1] <= b[0] for a, b in zip(v, v[1:]))
