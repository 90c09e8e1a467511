"""Batch forms of the stateful operators: counters with a lifetime, eviction, registry, retraining."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ip import pseudonym_sha
from .prefix import SECOND, slice_of


def counters_ttl(rows: DataFrame, ttl_s: int, salt: str, ip: str = "remote_addr") -> DataFrame:
    """ST06: counters per address that vanish ``ttl_s`` after the last hit: one row per lifetime.

    Rows of one slice no longer than the lifetime always belong together, so they are counted there
    first; only the slice rows of an address are put in order.
    """
    ttl = ttl_s * SECOND
    part = rows.groupBy(ip, slice_of(F.col("ts_us"), ttl).alias("_s")).agg(
        F.min("ts_us").alias("a"), F.max("ts_us").alias("b"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") >= 400).alias("e"))
    w = Window.partitionBy(ip).orderBy("_s")
    fresh = F.coalesce(F.col("a") - F.lag("b").over(w) >= ttl, F.lit(True)).cast("int")
    life = part.withColumn("_f", fresh).withColumn(
        "_life", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = life.groupBy(ip, "_life").agg(F.min("a").alias("first_us"), F.max("b").alias("last_seen_us"),
                                        F.sum("n").alias("request_count"), F.sum("e").alias("error_count"))
    return out.withColumn("ip_hash", pseudonym_sha(F.col(ip), salt)).withColumn(
        "expires_us", F.col("last_seen_us") + ttl)


def evict_rows(rows: DataFrame, ts: str, as_of_us: int, max_age_s: int) -> DataFrame:
    """ST08: request history not older than ``max_age_s`` (24 hours by default elsewhere)."""
    return rows.where(F.col(ts) >= as_of_us - max_age_s * SECOND)


def evict_idle(state: DataFrame, last_seen: str, as_of_us: int, max_idle_s: int = 7 * 86400) -> DataFrame:
    """ST08: addresses seen within ``max_idle_s``."""
    return state.where(F.col(last_seen) >= as_of_us - max_idle_s * SECOND)


def node_registry(heartbeats: DataFrame, as_of_us: int, online_s: int) -> DataFrame:
    """ST10: the latest heartbeat per node."""
    last = F.max_by(F.struct(*[c for c in heartbeats.columns if c != "node_id"]),
                    F.struct("ts_us", "event_id"))
    out = heartbeats.groupBy("node_id").agg(last.alias("_l"), F.min("ts_us").alias("registered_us"))
    return out.select("node_id", "registered_us", F.col("_l.ts_us").alias("last_heartbeat_us"), "_l.*").withColumn(
        "online", F.col("last_heartbeat_us") >= as_of_us - online_s * SECOND)


def registry_counts(registry: DataFrame) -> DataFrame:
    """ST10: registered and connected nodes."""
    return registry.agg(F.count(F.lit(1)).alias("registered_nodes"), F.count_if(F.col("online")).alias("connected_nodes"))


def retrain_needed(samples: DataFrame, seconds_since_training: int, threshold: int = 1000,
                   interval_s: int = 86400, minimum: int = 100) -> DataFrame:
    """ST13."""
    n = F.col("samples")
    due = (n >= threshold) | F.lit(seconds_since_training >= interval_s)
    return samples.agg(F.count(F.lit(1)).alias("samples")).withColumn("retrain", due & (n >= minimum))
