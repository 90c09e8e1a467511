"""What an address has done so far, as one row per address."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import ip as IP
from ..functions.regex import is_valid
from .addresses import listed_addresses
from .prefix import MINUTE
from .windows import risk_score

IP_COL = "remote_addr"


def count_map(rows: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Counts per value as a map; values are counted per (key, value) before they meet."""
    return (rows.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys)
            .agg(F.map_from_entries(F.collect_list(F.struct(col, "_n"))).alias(out)))


def distinct_counts(rows: DataFrame, keys: list[str], cols: dict[str, str]) -> DataFrame:
    """Distinct non-NULL values per key for several columns in two partial aggregations each."""
    out = None
    for name, col in cols.items():
        d = (rows.where(F.col(col).isNotNull()).select(*keys, col).distinct()
             .groupBy(*keys).agg(F.count(F.lit(1)).alias(name)))
        out = d if out is None else out.join(d, keys, "full")
    return out


def first_values(rows: DataFrame, keys: list[str], col: str, n: int, out: str) -> DataFrame:
    """The first ``n`` distinct values in text order; ranked early, so no list ever holds more."""
    w = Window.partitionBy(*keys).orderBy(col)
    return (rows.where(F.col(col) != "").select(*keys, col).distinct()
            .withColumn("_r", F.row_number().over(w)).where(f"_r <= {n}")
            .groupBy(*keys).agg(F.array_sort(F.collect_list(col)).alias(out)))


def ip_behaviour(rows: DataFrame, bans: DataFrame | None = None) -> DataFrame:
    """AG04 + AG06.  ``rows`` carry ``attack_label``."""
    s = F.coalesce(F.col("status"), F.lit(200))
    band = lambda lo: F.count_if(s.between(lo, lo + 99))
    base = rows.groupBy(IP_COL).agg(
        F.min("ts_us").alias("first_seen_us"), F.max("ts_us").alias("last_seen_us"),
        F.count(F.lit(1)).alias("request_count"), F.count("attack_label").alias("attack_count"),
        band(200).alias("count_2xx"), band(300).alias("count_3xx"), band(400).alias("count_4xx"),
        band(500).alias("count_5xx"))
    named = rows.select(IP_COL, F.nullif(F.col("request_uri"), F.lit("")).alias("_p"),
                        F.nullif(F.col("http_user_agent"), F.lit("")).alias("_u"))
    d = distinct_counts(named, [IP_COL], {"unique_paths": "_p", "unique_agents": "_u"})
    out = base.join(d, IP_COL, "left")
    if bans is not None:
        out = out.join(bans.groupBy(IP_COL).agg(F.count(F.lit(1)).alias("ban_count")), IP_COL, "left")
    else:
        out = out.withColumn("ban_count", F.lit(0).cast("bigint"))
    geo = IP.geo_struct(F.col(IP_COL))
    out = out.fillna(0, ["unique_paths", "unique_agents", "ban_count"]).withColumn("_g", geo)
    out = out.withColumn("country", F.col("_g.country")).withColumn("risk_level", F.col("_g.risk_level"))
    return out.drop("_g").withColumn("risk_score", risk_score())


def behaviour_summary(state: DataFrame, rows: DataFrame, last: int = 5) -> DataFrame:
    """AG05: shares of the status classes and the last attacks, oldest first."""
    w = Window.partitionBy(IP_COL).orderBy(F.desc("ts_us"), F.desc("event_id"))
    recent = (rows.where("attack_label is not null")
              .select(IP_COL, "ts_us", "event_id", F.col("attack_label").alias("type"),
                      F.col("request_uri").alias("path"))
              .withColumn("_r", F.row_number().over(w)).where(f"_r <= {last}")
              .groupBy(IP_COL).agg(F.array_sort(F.collect_list(F.struct("ts_us", "event_id", "type", "path")))
                                   .alias("recent_attacks")))
    out = state.join(recent, IP_COL, "left")
    for k in (2, 3, 4, 5):
        out = out.withColumn(f"rate_{k}xx", F.col(f"count_{k}xx") / F.col("request_count"))
    empty = F.array().cast(out.schema["recent_attacks"].dataType)
    return out.withColumn("recent_attacks", F.coalesce("recent_attacks", empty))


def ip_report(state: DataFrame, rows: DataFrame, agents: int = 10, paths: int = 20) -> DataFrame:
    """AG08: summary plus status map and the first ``agents`` and ``paths`` in text order.  All agents and
    paths are listed by ``address_values`` and bans by ``ban_history``: an address may have any number."""
    return (behaviour_summary(state, rows)
            .join(count_map(rows, [IP_COL], "status", "status_codes"), IP_COL, "left")
            .join(first_values(rows, [IP_COL], "http_user_agent", agents, "user_agents"), IP_COL, "left")
            .join(first_values(rows, [IP_COL], "request_uri", paths, "top_paths"), IP_COL, "left"))


def address_values(rows: DataFrame) -> DataFrame:
    """AG08: every agent and path of every address with its count, one row each."""
    cell = lambda d, c: F.when(F.col(c) != "", F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")))
    cells = F.array_compact(F.array(cell("agent", "http_user_agent"), cell("path", "request_uri")))
    return (rows.select(IP_COL, F.explode(cells).alias("_d")).groupBy(IP_COL, "_d")
            .agg(F.count(F.lit(1)).alias("n")).select(IP_COL, "_d.*", "n"))


def ban_history(bans: DataFrame, address: str) -> DataFrame:
    """AG08: all bans of one address, oldest first, one row each."""
    return bans.where(F.col(IP_COL) == address).select(
        IP_COL, "ts_us", "event_id", "reason", "duration_s").orderBy("ts_us", "event_id")


def risk_distribution(state: DataFrame, networks: DataFrame, bands=(30, 70)) -> DataFrame:
    """AG07."""
    listed = listed_addresses(state, networks, IP_COL).withColumn("_listed", F.lit(True))
    s = state.join(listed, IP_COL, "left")
    low, high = bands
    score = F.col("risk_score")
    return s.agg(F.count(F.lit(1)).alias("total_ips"), F.count("_listed").alias("whitelisted_ips"),
                 F.count_if(F.col("_listed").isNull()).alias("monitored_ips"),
                 F.sum("request_count").alias("total_requests"), F.sum("attack_count").alias("total_attacks"),
                 F.coalesce(F.try_divide(F.sum("attack_count"), F.sum("request_count")), F.lit(0.0))
                 .alias("attack_rate"),
                 F.count_if(score < low).alias("low"),
                 F.count_if((score >= low) & (score < high)).alias("medium"),
                 F.count_if(score >= high).alias("high"))


def top_risky(state: DataFrame, networks: DataFrame, n: int = 10) -> DataFrame:
    """TK03."""
    listed = listed_addresses(state, networks, IP_COL)
    return (state.where("risk_score > 0").join(listed, IP_COL, "left_anti")
            .orderBy(F.desc("risk_score"), IP_COL).limit(n))


def detector_stats(rows: DataFrame, as_of_us: int) -> DataFrame:
    """AG02."""
    base = rows.groupBy(IP_COL).agg(
        F.count(F.lit(1)).alias("total_requests"), F.max("ts_us").alias("last_request_us"),
        *[F.count_if(F.col("ts_us") >= as_of_us - m * MINUTE).alias(f"requests_last_{m}min")
          for m in (1, 5, 10, 60)])
    d = distinct_counts(rows, [IP_COL], {"unique_paths": "request_uri", "unique_user_agents": "http_user_agent"})
    return (base.join(d, IP_COL, "left")
            .join(count_map(rows, [IP_COL], "status", "status_codes"), IP_COL, "left")
            .join(count_map(rows, [IP_COL], "request_method", "methods"), IP_COL, "left"))


def detector_totals(rows: DataFrame, attack_rules=None) -> DataFrame:
    """AG03: rule counts come from the rule table."""
    rules = {k: [p for p in ps if is_valid(p)] for k, on, ps in (attack_rules or R.DEFAULT_ATTACK_RULES) if on}
    rules = {k: v for k, v in rules.items() if v}
    return rows.groupBy(IP_COL).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.count(F.lit(1)).alias("monitored_ips"), F.sum("_n").alias("total_requests"),
        F.lit(len(rules)).alias("enabled_types"),
        F.lit(sum(map(len, rules.values()))).alias("enabled_patterns"))


def anomaly_features(rows: DataFrame, as_of_us: int) -> DataFrame:
    """Seven numbers per address; attacks only of the last hour (strictly), the rest all-time."""
    recent = F.col("attack_label").isNotNull() & (F.col("ts_us") > as_of_us - 60 * MINUTE)
    base = rows.groupBy(IP_COL).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(recent).alias("_a"),
        F.count_if(recent & (F.col("status") >= 400)).alias("_e"),
        F.coalesce(F.avg("request_time"), F.lit(0.0)).alias("response_time"))
    named = rows.select(IP_COL, F.nullif(F.col("request_uri"), F.lit("")).alias("_p"),
                        F.nullif(F.col("http_user_agent"), F.lit("")).alias("_u"),
                        F.when(F.col("status").between(400, 499), F.col("status")).alias("_s"))
    d = distinct_counts(named, [IP_COL], {"unique_paths": "_p", "user_agent_diversity": "_u", "_codes": "_s"})
    j = base.join(d, IP_COL, "left").fillna(0, ["unique_paths", "user_agent_diversity", "_codes"])
    c = F.col
    # the share of *distinct* 4xx codes is the published meaning of this feature
    return j.select(IP_COL, (c("_n") / 3600).alias("request_rate"),
                    (c("_e") / F.greatest(c("_a"), F.lit(1))).alias("error_rate"), "unique_paths",
                    "user_agent_diversity", (c("_codes") / c("_n")).alias("status_4xx_rate"),
                    (c("_a") / 3600).alias("attack_frequency"), "response_time")
