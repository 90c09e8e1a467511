"""Rolling rules per address, the frequency verdict and the ban decision.

Input rows have ``remote_addr``, ``ts_us`` (event time, µs), ``event_id`` (order of rows of one
time) and the request columns.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import patterns as P
from .prefix import (HOUR, MINUTE, SECOND, Rolling, RollingDistinct, join_keys, previous_time, rolling_totals,
                     windowed_totals)

IP, TS, TIE = "remote_addr", "ts_us", "event_id"
#: An address with more requests in one window is spread over tasks.
HOT_ROWS = 200_000


def rate_counts(rows: DataFrame, window_minutes: int | None = None, **kw) -> DataFrame:
    """W01-W05 in one go: n404, n_1min, n_5min, n_uris, n_sensitive, each including its own row."""
    w = (window_minutes or R.BAN_RULES["time_window_minutes"]) * MINUTE
    uri = F.coalesce(F.col("request_uri"), F.lit(""))
    return windowed_totals(rows, [IP], TS, [
        Rolling("n404", F.when(F.col("status") == 404, 1), w),
        Rolling("n_1min", F.lit(1), MINUTE),
        Rolling("n_5min", F.lit(1), 5 * MINUTE),
        RollingDistinct("n_uris", uri, 10 * MINUTE, {"n_sensitive": P.is_sensitive(uri)})], **kw)


def rate_labels(rules: dict | None = None) -> dict[str, Column]:
    """The five labels over ``rate_counts`` columns, NULL where a rule does not fire."""
    r = {**R.BAN_RULES, **(rules or {})}
    w = r["time_window_minutes"]
    lab = lambda cond, a, n, b: F.when(cond, F.concat(F.lit(a), F.col(n).cast("string"), F.lit(b)))
    return {
        "rolling_404": lab(F.col("n404") >= r["not_found_threshold"], "high_404_frequency:", "n404",
                           f"_in_{w}min"),
        "rolling_1min": lab(F.col("n_1min") > r["requests_per_minute"], "high_request_frequency:",
                            "n_1min", "_per_minute"),
        "rolling_5min": lab(F.col("n_5min") > r["requests_per_5min"], "sustained_high_frequency:",
                            "n_5min", "_in_5min"),
        "rolling_distinct_uri": lab(F.col("n_uris") > r["distinct_paths"], "directory_scanning:",
                                    "n_uris", "_unique_paths"),
        "rolling_sensitive": lab(F.col("n_sensitive") > r["sensitive_paths"],
                                 "sensitive_path_scanning:", "n_sensitive", "_sensitive_paths"),
    }


def frequency_verdict(rules: dict | None = None) -> Column:
    """First rule that fires, where no pattern matched (column ``pattern_label``)."""
    return F.when(F.col("pattern_label").isNull(), F.coalesce(*rate_labels(rules).values()))


def detect(rows: DataFrame, attack_rules=None, rules: dict | None = None, **kw) -> DataFrame:
    """Pattern label, frequency verdict and their combination ``attack_label``."""
    w = {**R.BAN_RULES, **(rules or {})}["time_window_minutes"]
    out = rate_counts(rows.withColumn("pattern_label", P.first_attack_match(attack_rules)), w, **kw)
    return (out.withColumn("frequency_label", frequency_verdict(rules))
               .withColumn("attack_label", F.coalesce("pattern_label", "frequency_label")))


def regular_intervals(rows: DataFrame, **kw) -> DataFrame:
    """At least five gaps so far, their sample deviation below 1 s and their mean below 5 s."""
    g = previous_time(rows, [IP], TS, TIE, "_prev", **kw)
    gap = ((F.col(TS) - F.col("_prev")).cast("decimal(20,0)"))
    big = "decimal(38,0)"
    out = rolling_totals(g, [IP], TS, [
        Rolling("n_gaps", F.when(F.col("_prev").isNotNull(), 1), None),
        Rolling("_sum", gap, None, type=big), Rolling("_sq", gap * gap, None, type=big)],
        tie=TIE, **kw)
    n, s, q = F.col("n_gaps").cast("double"), F.col("_sum").cast("double"), F.col("_sq").cast("double")
    mean = F.when(F.col("n_gaps") > 0, s / n / SECOND)
    sd = F.when(F.col("n_gaps") > 1, F.sqrt(F.greatest(
        (q - s * s / n) / (n - 1), F.lit(0.0))) / SECOND)
    hit = F.coalesce((F.col("n_gaps") >= 5) & (sd < 1.0) & (mean < 5.0), F.lit(False))
    return (out.withColumn("mean_gap", mean).withColumn("stdev_gap", sd)
               .withColumn("timing_suspicious", hit)
               .withColumn("timing_score", F.when(hit, 15).otherwise(0).cast("bigint"))
               .drop("_prev", "_sum", "_sq"))


def advanced_verdict(detected: DataFrame, **kw) -> DataFrame:
    """rows with a basic verdict or a suspicious agent, timing or payload."""
    d = regular_intervals(detected, **kw)
    for n, c in {**P.ua_analysis(F.col("http_user_agent")),
                 **P.payload_analysis(F.col("request_uri"))}.items():
        d = d.withColumn(n, c)
    return d.where(F.col("attack_label").isNotNull() | F.col("ua_suspicious")
                   | F.col("timing_suspicious") | F.col("payload_suspicious"))


def running_behaviour(rows: DataFrame, attack: Column, risk_level: Column, bans: DataFrame | None = None,
                      **kw) -> DataFrame:
    """W06 + W08 + J05: what is known of the address when each row arrives, its own row included.

    ``bans`` (remote_addr, ts_us, event_id) are counted as of the row, at most at its own time.
    """
    status = F.coalesce(F.col("status"), F.lit(200))
    ua, uri = (F.nullif(F.col(c), F.lit("")) for c in ("http_user_agent", "request_uri"))
    rows = rows.withColumn("is_attack", attack.isNotNull()).withColumn("risk_level", risk_level)
    specs = [
        Rolling("request_count", F.lit(1), None),
        Rolling("attack_count", F.when(F.col("is_attack"), 1), None),
        Rolling("attacks_60s", F.when(F.col("is_attack"), 1), MINUTE, strict=True),
        Rolling("count_4xx", F.when(status.between(400, 499), 1), None),
        Rolling("count_404", F.when(status == 404, 1), None),
        RollingDistinct("unique_paths", uri, None),
        RollingDistinct("unique_agents", ua, None),
    ]
    if bans is None:
        out = rolling_totals(rows, [IP], TS, specs, tie=TIE, **kw).withColumn(
            "ban_count", F.lit(0).cast("bigint"))
    else:
        both = with_ban_rows(rows, bans)
        ban = F.col("_is_ban")
        specs = [replace(s, amount=F.when(~ban, s.amount)) if isinstance(s, Rolling) else s for s in specs]
        out = rolling_totals(both, [IP], TS, [*specs, Rolling("ban_count", F.when(ban, 1), None)],
                             tie="_ord", **kw).where(~ban).drop("_is_ban", "_ord")
    first = rows.groupBy(IP).agg(F.min(TS).alias("first_seen_us"))
    return join_keys(out, first, [IP]).withColumn("risk_score", risk_score())


def with_ban_rows(rows: DataFrame, bans: DataFrame) -> DataFrame:
    """Requests and bans as one time line; a ban of the same time counts for the request."""
    b = bans.select(IP, TS, *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes
                              if c not in (IP, TS)], F.lit(True).alias("_is_ban"),
                    F.lit(-1).cast("bigint").alias("_ord"))
    r = rows.withColumn("_is_ban", F.lit(False)).withColumn("_ord", F.col(TIE))
    return r.unionByName(b)


def ban_history_asof(rows: DataFrame, bans: DataFrame, **kw) -> DataFrame:
    """Bans of the address up to each request, without a range join."""
    both = with_ban_rows(rows.select(IP, TS, TIE), bans)
    return (rolling_totals(both, [IP], TS, [Rolling("ban_count", F.when(F.col("_is_ban"), 1), None)],
                           tie="_ord", **kw).where(~F.col("_is_ban")).drop("_is_ban", "_ord"))


def risk_score() -> Column:
    """AG06 over request_count, attack_count, count_4xx, unique_paths, unique_agents, risk_level,
    ban_count."""
    w = R.RISK_WEIGHTS
    c = F.col
    part = lambda rate, cap: F.least(rate * 100, F.lit(float(cap)))
    over = lambda n, base, step, cap: F.when(n > base, F.least(
        ((n - base) * step).cast("double"), F.lit(float(cap)))).otherwise(0.0)
    n = c("request_count")
    geo = P.lookup(c("risk_level"), {k: float(v) for k, v in R.GEO_RISK.items()}, 10.0)
    score = (part(c("attack_count") / n, 50) * w["attack_frequency"]
             + part(c("count_4xx") / n, 30) * w["status_4xx_rate"]
             + over(c("unique_paths"), 10, 2, 25) * w["unique_paths"]
             + over(c("unique_agents"), 5, 3, 20) * w["user_agent_diversity"]
             + F.when(c("risk_level").isNull(), 0.0).otherwise(geo) * w["geo_risk"]
             + F.when(c("ban_count") > 0, F.least((c("ban_count") * 15).cast("double"), F.lit(30.0)))
             .otherwise(0.0) * w["ban_history"])
    return F.least(score, F.lit(100.0))


def ban_decision(rules: dict | None = None, malicious: Column | None = None) -> dict[str, Column]:
    """W09 over ``running_behaviour``: should_ban and the reason of the first rule that holds."""
    r = {**R.BAN_RULES, **(rules or {})}
    c, t = F.col, R.BAN_TEXT
    span = (c(TS) - c("first_seen_us")) / SECOND
    rate = F.when(span > 0, c("request_count") / span * 60)
    fmt = lambda k, x: F.format_string(t[k], x)
    whens = [(c("risk_score") >= r["risk_threshold"], fmt("risk", c("risk_score"))),
             (c("attack_count") >= r["attack_threshold"], fmt("attacks", c("attack_count"))),
             (c("is_attack") & (c("attacks_60s") >= 3), F.lit(t["burst"])),
             (c("count_404") >= r["not_found_threshold"], fmt("not_found", c("count_404"))),
             (rate > r["request_rate_threshold"], fmt("rate", rate))]
    if malicious is not None:
        whens.insert(0, (malicious, F.lit(t["malicious"])))
    reason = None
    for cond, text in whens:
        reason = F.when(cond, text) if reason is None else reason.when(cond, text)
    return {"ban_reason": reason.otherwise(F.lit(t["none"])),
            "should_ban": F.coalesce(reason.isNotNull(), F.lit(False))}


def combined_verdict(behaviour: DataFrame) -> DataFrame:
    """Ban rows and their reason, the attack label before the behaviour rule."""
    return (behaviour.where(F.col("attack_label").isNotNull() | F.col("should_ban"))
            .withColumn("reason", F.coalesce("attack_label", "ban_reason")))


def hour_features(rows: DataFrame, **kw) -> DataFrame:
    """The last hour of the address as seven model features."""
    t = F.timestamp_micros(F.col(TS))
    hour = F.hour(t)
    dec = "decimal(30,12)"
    secs = F.when(F.col("request_time") != 0, F.col("request_time"))
    out = windowed_totals(rows, [IP], TS, [
        Rolling("_n", F.lit(1), HOUR),
        Rolling("_err", F.when(F.coalesce(F.col("status"), F.lit(200)) >= 400, 1), HOUR),
        Rolling("_rt", secs, HOUR, type=dec), Rolling("_rn", F.when(secs.isNotNull(), 1), HOUR),
        Rolling("_night", F.when((hour < 6) | (hour > 22), 1), HOUR),
        Rolling("_wend", F.when(F.weekday(t) >= 5, 1), HOUR),
        RollingDistinct("_paths", F.coalesce("request_uri", F.lit("")), HOUR),
        RollingDistinct("_uas", F.coalesce("http_user_agent", F.lit("")), HOUR)], **kw)
    n = F.col("_n")
    return out.select(*rows.columns,
                      (n / 3600).alias("behavior_request_rate"),
                      (F.col("_err") / n).alias("behavior_error_rate"),
                      F.col("_paths").cast("double").alias("behavior_unique_paths"),
                      F.col("_uas").cast("double").alias("behavior_unique_user_agents"),
                      F.when(F.col("_rn") > 0, F.col("_rt").cast("double") / F.col("_rn"))
                      .otherwise(0.0).alias("behavior_avg_response_time"),
                      (F.col("_night") / n).alias("behavior_night_requests_ratio"),
                      (F.col("_wend") / n).alias("behavior_weekend_requests_ratio"))


