"""Alerts: rules, severities, suppression, thresholds, resolution and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.patterns import lookup
from .gaps import greedy_keep, smoothed_threshold
from .prefix import SECOND


def attack_severity(attack_type: Column) -> Column:
    """F18."""
    return lookup(F.lower(attack_type), R.ATTACK_SEVERITY, "medium")


def health_alert(cpu: Column, memory: Column) -> Column:
    """processor first, memory only when the processor is fine; NULL when both are."""
    mk = lambda sev, title, body, v: F.struct(
        F.lit("system_health").alias("type"), F.lit(sev).alias("severity"), F.lit(R.ALERT_TEXT[title]).alias("title"),
        F.format_string(R.ALERT_TEXT[body], v.cast("string")).alias("description"))
    return (F.when(cpu > 90, mk("high", "cpu_title", "cpu_body", cpu))
             .when(memory > 95, mk("critical", "memory_title", "memory_body", memory)))


def ratio_severity(value: Column, threshold: Column) -> Column:
    """F21."""
    r = F.try_divide(value, threshold)
    return F.when(r >= 2.0, "critical").when(r >= 1.5, "high").when(r >= 1.2, "medium").otherwise("low")


def suppress(rows: DataFrame, key: str, ts: str, tie: str, window_s: int = 300,
             segment_us: int | None = None) -> DataFrame:
    """ST01 / ST04: rows that pass, at least ``window_s`` after the last that passed for the key."""
    return greedy_keep(rows, [key], ts, tie, window_s * SECOND, window_s * SECOND, segment_us).drop("gap_us")


def dynamic_thresholds(samples: DataFrame, defaults: dict[str, float] | None = None, fallback: float | None = None,
                       sensitivity: float = 0.1, rate: float = 0.05, block: int = 50_000,
                       slice_us: int | None = None) -> DataFrame:
    """ST03: the threshold each sample is judged by, and whether it exceeds it.

    Metrics without a configured start value are left out unless ``fallback`` gives one.
    """
    start = defaults if defaults is not None else R.DEFAULT_THRESHOLDS
    names = samples.select("name").distinct()
    value = None
    for k, v in start.items():
        value = F.when(F.col("name") == k, F.lit(float(v))) if value is None else value.when(F.col("name") == k, float(v))
    value = F.lit(fallback).cast("double") if value is None else value.otherwise(F.lit(fallback).cast("double"))
    initial = names.withColumn("initial", value).where("initial is not null")
    t = smoothed_threshold(samples, "name", "ts_us", "event_id", "value", "is_anomaly", initial,
                           sensitivity, rate, block, slice_us)
    return t.withColumn("exceeded", F.col("value") > F.col("threshold"))


def threshold_lookup(samples: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Samples of configured metrics with their threshold."""
    return samples.join(thresholds, "name")


def route(threshold: Column, anomaly: Column, attack: Column, health: Column) -> Column:
    """one alert per event, in this order."""
    return F.coalesce(threshold, anomaly, attack, health)


def build_alerts(rows: DataFrame, kind: Column, severity: Column, title: Column, description: Column) -> DataFrame:
    """alert rows with id ``type_epochsecond``; a sequence keeps alerts of one second apart."""
    a = rows.select("event_id", "ts_us", kind.alias("type"), severity.alias("severity"), title.alias("title"),
                    description.alias("description"), F.col("source_ip"),
                    F.coalesce("node_id", F.lit("unknown")).alias("node_id"),
                    F.lit(False).alias("resolved"), F.expr("ts_us div 1000000").alias("_sec"))
    # a (type, second) group is one second of alerts, so a plain ranking is small
    from pyspark.sql import Window
    seq = F.row_number().over(Window.partitionBy("type", "_sec").orderBy("ts_us", "event_id"))
    return (a.withColumn("_seq", seq)
            .withColumn("id", F.concat("type", F.lit("_"), F.col("_sec").cast("string"), F.when(
                F.col("_seq") > 1, F.concat(F.lit("_"), F.col("_seq").cast("string"))).otherwise("")))
            .drop("_sec", "_seq"))


def active_alerts(alerts: DataFrame, severity: str | None = None, kind: str | None = None) -> DataFrame:
    """open alerts, newest first."""
    out = alerts.where(~F.col("resolved"))
    if severity:
        out = out.where(F.col("severity") == severity)
    if kind:
        out = out.where(F.col("type") == kind)
    return out.orderBy(F.desc("ts_us"), F.desc("event_id"))


def resolve(alerts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The latest resolution of each alert applied; unknown ids are ignored."""
    r = resolutions.groupBy("id").agg(F.max_by(F.struct("resolved_us", "notes"), "resolved_us").alias("_r"))
    return (alerts.drop("resolved_us").join(r, "id", "left")
            .withColumn("resolved", F.col("resolved") | F.col("_r").isNotNull())
            .withColumn("resolved_us", F.col("_r.resolved_us"))
            .withColumn("resolution_notes", F.col("_r.notes")).drop("_r"))


def alert_statistics(alerts: DataFrame) -> DataFrame:
    """AG21: (dimension, key, n) with the number of open alerts."""
    cell = lambda d, k: F.struct(F.lit(d).alias("dimension"), k.alias("key"))
    cells = F.array_compact(F.array(
        cell("total", F.lit("")), cell("severity", F.col("severity")), cell("type", F.col("type")),
        F.when(~F.col("resolved"), cell("active", F.lit("")))))
    return alerts.select(F.explode(cells).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n")).select("d.*", "n")


def resolution_time(alerts: DataFrame) -> DataFrame:
    """AG22: mean seconds from alert to resolution."""
    return alerts.where("resolved").agg(
        (F.avg(F.col("resolved_us") - F.col("ts_us")) / SECOND).alias("resolution_time_avg"))


def rule_alerts(samples: DataFrame, metric: str, threshold: float, window_s: int) -> DataFrame:
    """Declared alert rules: rolling sum of a metric over the window compared with a threshold."""
    from .prefix import Rolling, windowed_totals
    s = windowed_totals(samples.where(F.col("name") == metric), ["node_id"], "ts_us",
                        [Rolling("n", F.lit(1), window_s * SECOND)])
    return s.withColumn("fires", F.col("n") > threshold)


