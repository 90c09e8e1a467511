"""What one task sees, and what is computed once, however large the input."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gatewatch import rules as R
from gatewatch.operators import models as M
from gatewatch.operators import prefix as P
from gatewatch.operators import windows as W
from gatewatch.streaming import detect
from gatewatch.streaming.address import AddressProcessor

S = 1_000_000


def rows_of_tasks(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_many_small_groups_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_ROWS", 500)
    df = spark.range(20_000).selectExpr("id", "id % 2000 AS k", "id * 1000 AS ts", "concat('/', id % 7) AS uri")
    specs = [P.Rolling("n", F.lit(1), 20 * S), P.RollingDistinct("uris", F.col("uri"), 30 * S)]
    out = P.windowed_totals(df, ["k"], "ts", specs, hot_rows=100_000)
    assert max(rows_of_tasks(out)) < 1_500
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, P.windowed_totals(df, ["k"], "ts", specs).collect()))
    assert P.windowed_totals(df.where("id < 0"), ["k"], "ts", specs, hot_rows=100_000).count() == 0


def requests(spark, n):
    return spark.range(n).selectExpr(
        "id AS event_id", "1704067200000000 + id * 1000 AS ts_us", "concat('10.0.', id % 20, '.', id % 100) AS remote_addr",
        "concat('/p/', id % 13) AS request_uri", "'GET' AS request_method", "'ua' AS http_user_agent", "200L AS status",
        "5L AS body_bytes_sent", "id / 1000 AS request_time")


def test_features_deal_by_rows_and_cut_busy_addresses(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_ROWS", 500)
    df = requests(spark, 10_000)
    out = M.all_features(df)
    assert max(rows_of_tasks(out)) < 3_000
    cut = M.all_features(df, hot_rows=50)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, cut.collect()))


def test_hour_window_deals_by_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_ROWS", 500)
    assert max(rows_of_tasks(W.hour_features(requests(spark, 10_000), hot_rows=W.HOT_ROWS))) < 3_000


def test_labelled_features_are_computed_once(spark, data):
    from gatewatch.plans.q_models import _labelled
    f, cols = _labelled(data)
    assert "Window" not in f._jdf.queryExecution().optimizedPlan().toString()
    assert len(cols) > 50 and f.count() == data.access_log.count()


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Map(dict):
    getValue = dict.get

    def updateValue(self, k, v):
        self[k] = v

    def containsKey(self, k):
        return k in self

    def removeKey(self, k):
        del self[k]

    def iterator(self):
        return iter(list(self.items()))


class Handle:
    """State in memory that counts what it is asked for."""

    def __init__(self):
        self.timers = []

    def getValueState(self, *_):
        return Value()

    def getMapState(self, *_):
        return Map()

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


class Clock:
    def __init__(self, us):
        self.ms = us // 1000

    def getCurrentWatermarkInMs(self):
        return self.ms


def judged(batches, ttl_s=3_600):
    """Output of one group of addresses for micro batches of (remote_addr, seconds, uri, is_ban), watermark a minute behind."""
    p = AddressProcessor({**R.BAN_RULES}, ttl_s)
    p.init(Handle())
    out, mark, n = [], 0, 0
    for rows in batches:
        df = pd.DataFrame(rows, columns=["remote_addr", "ts_us", "uri", "is_ban"])
        df["ts_us"] *= S
        df["event_id"], n = n + np.arange(len(df)), n + len(df)
        df = df.assign(status=404.0, agent=df["uri"] % 2, has_path=True, has_agent=True, sensitive=df["uri"] == 3, pattern_label=None)
        if len(df):
            out += [r for x in p.handleInputRows((0,), iter([df]), Clock(mark)) for r in x.itertuples(index=False, name=None)]
            mark = max(mark, int(df["ts_us"].max()) - 60 * S)
        list(p.handleExpiredTimer((0,), Clock(mark), None))
    return out


def test_addresses_of_a_group_are_judged_like_each_alone():
    rnd = random.Random(8)
    batches, t = [], 10_000
    for b in range(6):
        rows = [(rnd.choice(["a", "b", "c", None, "d"] if b % 2 else ["a", "b", None]), t + rnd.randrange(900), rnd.randrange(6), rnd.random() < .1)
                for _ in range(150)]
        batches.append(sorted(rows, key=lambda r: r[1]))
        t += rnd.choice([600, 2_000, 5_000])
    strip = lambda rows: sorted((str(r[0]), r[2], *r[4:]) for r in rows)
    alone = [r for a in ["a", "b", "c", None, "d"] for r in judged([[x for x in b if x[0] == a] for b in batches])]
    # an address that is alone has a watermark of its own, so late rows and forgetting are held against one that never forgets
    whole, kept = judged(batches, None), judged([[x for x in b if x[0] is not None] for b in batches], None)
    assert strip(r for r in whole if r[0] is not None) == strip(kept)
    assert len(alone) >= len(whole) > 500
    one = judged([[x for x in batches[0] if x[0] == "a"]])
    assert strip(one) == strip(r for r in judged(batches[:1]) if r[0] == "a")


def test_a_forgotten_address_begins_anew_and_keeps_its_bans():
    rows = judged([[("a", 0, 1, False), ("a", 1, 1, True), ("b", 1, 1, False)], [("b", 3_000, 1, False)], [("a", 9_000, 1, False), ("b", 6_500, 2, False)]])
    got = {(r[0], r[2] // S): dict(zip(("n", "paths", "bans"), (r[10], r[15], r[17]))) for r in rows}
    assert got["a", 9_000] == {"n": 1, "paths": 1, "bans": 1}
    assert got["b", 3_000]["n"] == 2 and got["b", 6_500] == {"n": 3, "paths": 2, "bans": 0}


def test_many_addresses_make_few_state_keys(spark):
    keys = detect.in_groups(spark.range(5_000).selectExpr("concat('10.0.', id % 250, '.', id % 199) AS ip"), "ip").count().count()
    assert keys <= detect.GROUPS


def test_topk_bounds_leave_few_vectors_to_rescore():
    from gatewatch.llm import topk
    v = (np.random.default_rng(4).standard_normal((6000, 64)) * 128).astype(np.int64)
    able = topk.Index(v).possible(v[0], 10, 0, 320)
    assert set(np.argsort(-(v @ v[0]))[1:11]) <= set(able.tolist()) and len(able) < 600
