"""The detection job as a stream, and the stateful steps it is made of.

Requests are judged by ``address.AddressProcessor`` (``transformWithState``); smaller states (the last passed time
of a suppression key, the end of a running ban) are kept with ``applyInPandasWithState``.  Event time with a watermark
replaces arrival order in the rolling rules: a row is judged against the rows of its address that
are not newer than itself, rows behind the watermark are dropped, idle addresses time out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import rules as R
from ..functions import patterns as P
from ..functions.ip import pseudonym_sha
from ..operators.addresses import drop_configured
from ..operators.prefix import SECOND
from ..operators.windows import ban_decision, frequency_verdict, risk_score
from .address import OUTPUT, AddressProcessor

#: Addresses share state in this many groups, so the calls to the state store do not grow with the addresses.
GROUPS = 512


def in_groups(rows: DataFrame, key: str):
    return rows.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(GROUPS))).groupBy("_group")


def judged_requests(requests: DataFrame, watermark: str = "1 minute", rules: dict | None = None, bans: DataFrame | None = None,
                    ttl_s: int | None = 86_400) -> DataFrame:
    """W01-W06, W08 and J05 on a stream: each request with the counts of its address at that moment.

    ``requests`` need remote_addr, event_id, ts_us, request_uri, status, pattern_label and, for distinct agents,
    http_user_agent; ``bans`` (remote_addr, ts_us) is a stream too.  Rolling counts follow event time.  Running totals
    follow arrival: micro batches one after another, in order of time inside each.
    """
    rules = {**R.BAN_RULES, **(rules or {})}
    uri = F.coalesce("request_uri", F.lit(""))
    agent = F.coalesce(F.col("http_user_agent") if "http_user_agent" in requests.columns else F.lit(None).cast("string"), F.lit(""))
    rows = requests.select(
        "remote_addr", "event_id", "ts_us", F.col("status").cast("double").alias("status"), F.xxhash64(uri).alias("uri"),
        F.xxhash64(agent).alias("agent"), (uri != "").alias("has_path"), (agent != "").alias("has_agent"),
        P.is_sensitive(uri).alias("sensitive"), F.lit(False).alias("is_ban"), "pattern_label")
    if bans is not None:
        fixed = {"event_id": F.lit(-1).cast("bigint"), "is_ban": F.lit(True), "remote_addr": F.col("remote_addr"), "ts_us": F.col("ts_us")}
        fixed |= {c: F.lit(0).cast("bigint") for c in ("uri", "agent")} | {c: F.lit(False) for c in ("has_path", "has_agent", "sensitive")}
        rows = rows.unionByName(bans.select(*(fixed.get(c, F.lit(None).cast(t)).alias(c) for c, t in rows.dtypes)))
    rows = rows.withColumn("timestamp", F.timestamp_micros("ts_us")).withWatermark("timestamp", watermark)
    return in_groups(rows, "remote_addr").transformWithStateInPandas(
        AddressProcessor(rules, ttl_s), OUTPUT, "append", "eventTime")


def decide(judged: DataFrame, rules: dict | None = None, risk_level: Column | None = None) -> DataFrame:
    """Verdict, risk score and ban decision of judged requests; ``risk_level`` is that of the address' country."""
    out = (judged.withColumn("frequency_label", frequency_verdict(rules))
           .withColumn("attack_label", F.coalesce("pattern_label", "frequency_label"))
           .withColumn("risk_level", F.lit(None).cast("string") if risk_level is None else risk_level))
    out = out.withColumn("risk_score", risk_score())
    for n, e in ban_decision(rules).items():
        out = out.withColumn(n, e)
    return out


def detection_stream(requests: DataFrame, allow: list[str], attack_rules=None, watermark: str = "1 minute",
                     bans: DataFrame | None = None, rules: dict | None = None, risk_level: Column | None = None,
                     ttl_s: int | None = 86_400) -> DataFrame:
    """ST12: allow-list, patterns, rolling rules, behaviour of the address and ban decision of each request, one shuffle
    by address in all.  ``combined_verdict`` of the result are the requests that start a ban."""
    rows = drop_configured(requests.where("remote_addr is not null and remote_addr <> ''"), allow)
    rows = rows.withColumn("pattern_label", P.first_attack_match(attack_rules))
    return decide(judged_requests(rows, watermark, rules, bans, ttl_s), rules, risk_level)


def suppress_stream(rows: DataFrame, key: str, window_s: int = 300, watermark: str = "1 minute") -> DataFrame:
    """ST01 / ST04 on a stream of (key, ts_us, event_id): the state is the last passed time."""
    w = window_s * SECOND
    src = rows.select(F.col(key).alias("key"), "ts_us", "event_id").withColumn(
        "timestamp", F.timestamp_micros("ts_us")).withWatermark("timestamp", watermark)

    def step(k, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(batches)).sort_values(["ts_us", "event_id"])
        last = state.get[0] if state.exists else None
        passed = []
        t = new["ts_us"].to_numpy()
        i = 0 if last is None else int(np.searchsorted(t, last + w))
        while i < len(t):
            passed.append(i)
            last = int(t[i])
            i = int(np.searchsorted(t, last + w))
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + w) // 1000, state.getCurrentWatermarkMs() + 1))
        yield new.iloc[passed][["key", "ts_us", "event_id"]]

    return src.groupBy("key").applyInPandasWithState(
        step, "key string, ts_us bigint, event_id bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def threshold_stream(samples: DataFrame, start: dict[str, float], fallback: float, sensitivity: float = 0.1,
                     rate: float = 0.05, watermark: str = "1 minute") -> DataFrame:
    """ST03 on a stream of (name, ts_us, event_id, value, is_anomaly): the state is the last 50
    samples, the baseline and the threshold."""
    src = samples.withColumn("timestamp", F.timestamp_micros("ts_us")).withWatermark("timestamp", watermark)

    def step(k, batches, state: GroupState):
        name = k[0]
        new = pd.concat(list(batches)).sort_values(["ts_us", "event_id"])
        first = start.get(name, fallback)
        vals, anom, n, base, thr = state.get if state.exists else ([], [], 0, first, first)
        vals, anom, got = list(vals), list(anom), []
        for v, a in zip(new["value"], new["is_anomaly"]):
            vals, anom, n = (vals + [v])[-50:], (anom + [bool(a)])[-50:], n + 1
            normal = np.array(vals)[~np.array(anom)]
            if n >= 10 and len(normal):
                base = base * (1 - rate) + normal.mean() * rate
                thr = base + normal.std() * sensitivity
            got.append((base, thr, v > thr))
        state.update((vals, anom, n, float(base), float(thr)))
        out = new[["name", "ts_us", "event_id", "value"]].copy()
        out["baseline"], out["threshold"], out["exceeded"] = zip(*got)
        yield out

    return src.groupBy("name").applyInPandasWithState(
        step, "name string, ts_us bigint, event_id bigint, value double, baseline double, threshold double, exceeded boolean",
        "vals array<double>, anom array<boolean>, n bigint, base double, thr double", "append",
        GroupStateTimeout.NoTimeout)


def ban_stream(triggers: DataFrame, watermark: str = "1 minute") -> DataFrame:
    """ST02 / ST07 on a stream of (ip, ts_us, event_id, duration_s): a 'ban' row when a ban starts, an
    'unban' row when event time passes its end.  The state are the ends of the bans that run in a group of addresses."""
    src = triggers.withColumn("timestamp", F.timestamp_micros("ts_us")).withWatermark("timestamp", watermark)

    def step(k, batches, state: GroupState):
        ends, out, now = dict(zip(*state.get)) if state.exists else {}, [], state.getCurrentWatermarkMs()
        new = pd.DataFrame({"ip": []}) if state.hasTimedOut else pd.concat(list(batches)).sort_values(["ts_us", "event_id"])
        present = {None if pd.isna(x) else x for x in new["ip"].unique()}
        for ip in [x for x, end in ends.items() if x not in present and end // 1000 < now]:
            out.append((ip, "unban", ends.pop(ip)))
        for ip, t, d in zip(new["ip"], new["ts_us"], new["duration_s"]) if present else ():
            ip = None if pd.isna(ip) else ip
            end = ends.get(ip)
            if end is not None and t < end:
                continue
            if end is not None:
                out.append((ip, "unban", end))
            ends[ip] = int(t) + int(d) * SECOND
            out.append((ip, "ban", int(t)))
        if ends:
            state.update((list(ends), list(ends.values())))
            state.setTimeoutTimestamp(max(min(ends.values()) // 1000, now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["ip", "action", "ts_us"])

    return in_groups(src, "ip").applyInPandasWithState(
        step, "ip string, action string, ts_us bigint", "ips array<string>, ends array<bigint>", "append",
        GroupStateTimeout.EventTimeTimeout)


def counters_stream(requests: DataFrame, ttl: str = "24 hours", salt: str = "", watermark: str = "1 minute") -> DataFrame:
    """ST06 on a stream: a session window with the lifetime as gap is exactly a sliding expiry."""
    src = requests.withColumn("timestamp", F.timestamp_micros("ts_us")).withWatermark("timestamp", watermark)
    return (src.groupBy(pseudonym_sha(F.col("remote_addr"), salt).alias("ip_hash"),
                        F.session_window("timestamp", ttl).alias("life"))
            .agg(F.count(F.lit(1)).alias("request_count"), F.count_if(F.col("status") >= 400).alias("error_count"),
                 F.max("ts_us").alias("last_seen_us")))


def heartbeat_stream(heartbeats: DataFrame) -> DataFrame:
    """ST10 on a stream: latest heartbeat per node, update or complete mode."""
    return heartbeats.groupBy("node_id").agg(F.max("ts_us").alias("last_heartbeat_us"))
