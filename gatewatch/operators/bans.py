"""Ban records, their state and the system-log reports about them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from .gaps import greedy_keep
from .prefix import SECOND
from .traffic import top_n

HOUR_US = 3_600_000_000


def ban_records(verdicts: DataFrame, duration_s: int = 3600) -> DataFrame:
    """A pending record per positive row; repeated bans are not merged here."""
    return verdicts.select(F.col("remote_addr").alias("ip"), "reason", F.col("node_id").alias("source_node"),
                           "ts_us", "event_id", F.lit(duration_s).cast("bigint").alias("duration_s"),
                           F.lit("pending").alias("status"))


def ban_intervals(triggers: DataFrame, max_duration_s: int | None = None, segment_us: int | None = None) -> DataFrame:
    """ST02: the first trigger bans until it expires, later ones do nothing until then.

    Without ``max_duration_s`` the longest duration is looked up in ``triggers``; longer ones than a given bound are an error.
    """
    kept = greedy_keep(triggers, ["ip"], "ts_us", "event_id", F.col("duration_s") * SECOND,
                       None if max_duration_s is None else max_duration_s * SECOND, segment_us)
    return kept.select("ip", F.col("ts_us").alias("start_us"), (F.col("ts_us") + F.col("gap_us")).alias("end_us"),
                       "event_id")


def active_bans_last(triggers: DataFrame) -> DataFrame:
    """ST02, executor table: every trigger overwrites the address's row, so the last one counts."""
    last = F.max_by(F.struct("duration_s", "reason", "ts_us"), F.struct("ts_us", "event_id"))
    return triggers.groupBy("ip").agg(last.alias("_l")).select(
        "ip", F.col("_l.ts_us").alias("banned_us"), F.col("_l.reason").alias("reason"),
        (F.col("_l.ts_us") + F.col("_l.duration_s") * SECOND).alias("expires_us"))


def ban_state_counts(bans: DataFrame, as_of_us: int) -> DataFrame:
    """AG24."""
    live = F.lit(as_of_us) < F.col("expires_us")
    return bans.agg(F.count(F.lit(1)).alias("total_bans"), F.count_if(live).alias("active_bans"),
                    F.count_if(~live).alias("expired_bans"))


def expired(bans: DataFrame, as_of_us: int) -> DataFrame:
    """ST07: bans to lift; a ban that ends exactly now is over."""
    return bans.where(F.lit(as_of_us) >= F.col("expires_us"))


def ban_status(ips: DataFrame, bans: DataFrame, ip: str = "ip") -> DataFrame:
    """J12."""
    b = bans.select(F.col("ip").alias(ip)).distinct().withColumn("_b", F.lit(True))
    return ips.join(b, ip, "left").withColumn(
        "ban_status", F.when(F.col("_b"), "banned").otherwise("monitoring")).drop("_b")


def apply_manual_bans(current: DataFrame, requests: DataFrame) -> DataFrame:
    """A request is accepted when its address is not on the list (the first one per address)."""
    first = requests.groupBy("ip").agg(F.min_by(F.struct("reason", "duration_s", "ts_us", "node_id"),
                                                F.struct("ts_us", "event_id")).alias("r")).select("ip", "r.*")
    new = first.join(current.select("ip").distinct(), "ip", "left_anti")
    return current.unionByName(new.select(
        "ip", F.col("ts_us").alias("banned_us"), "reason",
        (F.col("ts_us") + F.col("duration_s") * SECOND).alias("expires_us")))


def apply_unbans(current: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(list without the addresses, requests for addresses that are not on it)."""
    r = requests.select("ip").distinct()
    return current.join(r, "ip", "left_anti"), requests.join(current.select("ip").distinct(), "ip", "left_anti")


def split_ban_requests(requests: DataFrame) -> DataFrame:
    """``valid`` by the API's shape rule, ``valid_log`` by the log writer's octet rule."""
    ip = F.col("ip")
    shape = ip.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$")
    ok = (shape & F.length("reason").between(1, 200) & F.col("duration_s").between(60, 86400 * 30))
    parts = F.split(ip, "\\.")
    octets = F.forall(parts, lambda p: p.rlike("^[0-9]+$") & (p.try_cast("int").between(0, 255)))
    log_ok = F.when(F.size(parts) == 4, F.coalesce(octets, F.lit(False))).otherwise(ip.contains(":"))
    return requests.withColumn("valid", F.coalesce(ok, F.lit(False))).withColumn("valid_log", log_ok)


# -- reports over parsed system-log events -------------------------------------------
def in_window(events: DataFrame, as_of_us: int, hours: int, event_type: str) -> DataFrame:
    return events.where((F.col("event_type") == event_type) & (F.col("ts_us") >= as_of_us - hours * HOUR_US))


def currently_banned(events: DataFrame, as_of_us: int, hours: int) -> DataFrame:
    """Banned minus unbanned addresses of the window; their order does not matter."""
    pick = lambda t: in_window(events, as_of_us, hours, t).where(
        F.col("ip_address") != "").select("ip_address").distinct()
    return pick("ip_banned").join(pick("ip_unbanned"), "ip_address", "left_anti")


def ban_totals(events: DataFrame, as_of_us: int, hours: int) -> DataFrame:
    """AG09 totals.  One pass to one row per address, one to the totals."""
    e = events.where(F.col("event_type").isin("ip_banned", "ip_unbanned")
                     & (F.col("ts_us") >= as_of_us - hours * HOUR_US))
    has = lambda t: F.count_if(F.col("event_type") == t)
    per = e.groupBy(F.coalesce("ip_address", F.lit("")).alias("ip")).agg(
        has("ip_banned").alias("b"), has("ip_unbanned").alias("u"))
    known, b, u = F.col("ip") != "", F.col("b") > 0, F.col("u") > 0
    return per.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("total_bans"),
                   F.coalesce(F.sum("u"), F.lit(0)).alias("total_unbans"),
                   F.count_if(known & b).alias("unique_banned_ips"),
                   F.count_if(known & u).alias("unique_unbanned_ips"),
                   F.count_if(known & b & ~u).alias("currently_banned"))


def ban_breakdown(events: DataFrame, as_of_us: int, hours: int) -> DataFrame:
    """AG09 reasons and hours: (dimension, key, n)."""
    e = in_window(events, as_of_us, hours, "ip_banned").where(F.col("ip_address") != "")
    cells = F.array(F.struct(F.lit("reason").alias("dimension"), TX.ban_reason(F.col("message")).alias("key")),
                    F.struct(F.lit("hour").alias("dimension"),
                             TX.hour_bucket(F.timestamp_micros("ts_us")).alias("key")))
    return e.select(F.explode(cells).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n")).select("d.*", "n")


def top_banned(events: DataFrame, as_of_us: int, hours: int, n: int = 10) -> DataFrame:
    """TK04."""
    return top_n(in_window(events, as_of_us, hours, "ip_banned").where(F.col("ip_address") != ""),
                 "ip_address", n)


def attack_breakdown(events: DataFrame, as_of_us: int, hours: int) -> DataFrame:
    """AG10 types, hours and severities (severities with zeros): (dimension, key, n)."""
    e = in_window(events, as_of_us, hours, "attack_detected")
    cell = lambda d, k: F.struct(F.lit(d).alias("dimension"), k.alias("key"))
    msg = F.col("message")
    got = (e.select(F.explode(F.array(
        cell("type", TX.attack_type_label(msg)), cell("hour", TX.hour_bucket(F.timestamp_micros("ts_us"))),
        cell("severity", TX.attack_severity(msg, F.col("level"))))).alias("d"), F.lit(1).alias("one"))
        .unionByName(events.sparkSession.range(1).select(F.explode(F.array(*[
            cell("severity", F.lit(s)) for s in ("low", "medium", "high", "critical")])).alias("d"),
            F.lit(0).alias("one"))))
    return got.groupBy("d").agg(F.sum("one").alias("n")).select("d.*", "n")


def attack_trend(events: DataFrame, as_of_us: int, hours: int) -> DataFrame:
    """AG10 direction: the later half of the window against the rest."""
    e = in_window(events, as_of_us, hours, "attack_detected")
    late = F.count_if(F.col("ts_us") >= as_of_us - (hours // 2) * HOUR_US)
    t = e.agg(F.count(F.lit(1)).alias("total_attacks"), late.alias("recent"))
    old = F.col("total_attacks") - F.col("recent")
    return t.withColumn("trend_direction", F.when(F.col("total_attacks") == 0, "stable")
                        .when(F.col("recent") > old * F.lit(1.2), "increasing")
                        .when(F.col("recent") < old * F.lit(0.8), "decreasing").otherwise("stable"))


def daily_ban_alarm(events: DataFrame, as_of_us: int, limit: int = 100) -> DataFrame:
    """AG32."""
    day = 86_400_000_000
    start = as_of_us - as_of_us % day
    n = F.count_if((F.col("event_type") == "ip_banned") & (F.col("ts_us") >= start))
    return events.agg(n.alias("bans_today")).withColumn("alarm", F.col("bans_today") > limit)


def escalating_bans(intervals: DataFrame, base_s: int, factor: float, max_s: int) -> DataFrame:
    """Declared policy: the n-th ban of an address lasts ``base * factor^(n-1)``, capped."""
    from .prefix import row_numbers
    n = row_numbers(intervals, ["ip"], "start_us", "event_id", "n", slice_us=86_400_000_000)
    # past this exponent the cap holds; a larger one would only overflow
    enough = math.ceil(math.log(max(max_s / base_s, 1)) / math.log(factor)) + 1 if factor > 1 else 0
    grown = F.lit(float(base_s)) * F.pow(F.lit(float(factor)), F.least(F.col("n") - 1, F.lit(enough)))
    return n.withColumn("ban_seconds", F.least(grown, F.lit(float(max_s))).cast("bigint"))


