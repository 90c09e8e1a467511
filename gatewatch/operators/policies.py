"""Declared policies: documented in configuration, each a parameter set over existing operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.regex import search
from .prefix import SECOND, Rolling, windowed_totals

IP, TS = "remote_addr", "ts_us"
P = R.POLICY


def not_found_rate(rows: DataFrame, window_s=P["not_found_window"], count=P["not_found_count"],
                   rate=P["not_found_rate"]) -> DataFrame:
    """At least ``count`` 404s in the window that are at least ``rate`` of its requests."""
    out = windowed_totals(rows, [IP], TS, [Rolling("n", F.lit(1), window_s * SECOND),
                                           Rolling("n404", F.when(F.col("status") == 404, 1), window_s * SECOND)])
    return out.withColumn("fires", (F.col("n404") >= count) & (F.col("n404") >= F.col("n") * rate))


def server_error_burst(rows: DataFrame, window_s=P["server_error_window"], count=P["server_error_count"]) -> DataFrame:
    out = windowed_totals(rows, [IP], TS, [Rolling("n5xx", F.when(F.col("status") >= 500, 1), window_s * SECOND)])
    return out.withColumn("fires", F.col("n5xx") >= count)


def brute_force(rows: DataFrame, paths=P["brute_paths"], window_s=P["brute_window"], count=P["brute_count"]) -> DataFrame:
    """Requests to login paths."""
    hit = F.lit(False)
    for p in paths:
        hit = hit | F.col("request_uri").startswith(p)
    out = windowed_totals(rows, [IP], TS, [Rolling("n_login", F.when(hit, 1), window_s * SECOND)])
    return out.withColumn("score", F.when(F.col("n_login") >= count, P["brute_score"]).otherwise(0))


def country_score(country: Column, blocked=P["blocked_countries"]) -> Column:
    """Points for a blocked country."""
    return F.when(country.isin(list(blocked)), P["country_score"]).otherwise(0)


def weighted_score(parts: dict[str, Column], age_steps: Column, weights=None, decay=P["decay"]) -> Column:
    """Weighted sum of 0-100 parts, faded by ``decay`` per step of age."""
    w = weights or P["weights"]
    total = sum((parts[k] * v for k, v in list(w.items())[1:]), parts[next(iter(w))] * next(iter(w.values())))
    return total * F.pow(F.lit(decay), age_steps)


def retained(events: DataFrame, as_of_us: int, severity: str = "severity") -> DataFrame:
    """Events younger than the retention of their severity."""
    days = F.lit(P["default_retention_days"])
    for k, v in P["retention_days"].items():
        days = F.when(F.col(severity) == k, v).otherwise(days)
    return events.where(F.col(TS) >= F.lit(as_of_us) - days.cast("bigint") * 86400 * SECOND)


def filter_lines(lines: DataFrame, include: list[str], exclude: list[str], col: str = "value") -> DataFrame:
    """Lines that match an include pattern (when there are any) and no exclude pattern."""
    keep = F.lit(not include)
    for p in include:
        keep = keep | search(col, p)
    for p in exclude:
        keep = keep & ~search(col, p)
    return lines.where(keep)


def pattern_rate(lines: DataFrame, key: str, pattern: str, threshold: int, window_s: int, col: str = "value") -> DataFrame:
    """Lines of a key at which the pattern has matched ``threshold`` times within the window."""
    hits = lines.where(search(col, pattern))
    out = windowed_totals(hits, [key], TS, [Rolling("n", F.lit(1), window_s * SECOND)])
    return out.where(F.col("n") >= threshold)
