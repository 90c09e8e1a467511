"""Notification routing and rate limits, up to an outbox table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from .alerts import suppress


def route_notifications(rows: DataFrame, enabled: list[str], routes: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per enabled channel of the level; levels without a route go nowhere."""
    level, out = F.col("level"), None
    for lev, chans in (routes or R.NOTIFICATION_ROUTES).items():
        arr = F.array(*[F.lit(x) for x in chans if x in enabled]).cast("array<string>")
        out = F.when(level == lev, arr) if out is None else out.when(level == lev, arr)
    return rows.withColumn("channel", F.explode(out))


def rate_limited(routed: DataFrame, window_s: int = 60) -> DataFrame:
    """ST04: what each (channel, level) really sends, with at least ``window_s`` between two."""
    r = routed.withColumn("_key", F.concat_ws("|", "channel", "level"))
    kept = suppress(r, "_key", "ts_us", "event_id", window_s)
    return kept.select(F.split("_key", r"\|")[0].alias("channel"), F.split("_key", r"\|")[1].alias("level"),
                       "ts_us", "event_id")


def rate_limited_by_source(rows: DataFrame, window_s: int = 60) -> DataFrame:
    """ST04, the other stack: keyed on level and source; a held back send still reports success."""
    r = rows.withColumn("_key", F.concat_ws("_", "level", "source"))
    kept = suppress(r, "_key", "ts_us", "event_id", window_s).select("event_id", F.lit(True).alias("sent"))
    return (r.join(kept, "event_id", "left").withColumn("sent", F.coalesce("sent", F.lit(False)))
            .withColumn("reported_success", F.lit(True)).drop("_key"))


def notifier_statistics(sent: DataFrame) -> DataFrame:
    """AG33: last sent time per channel and type."""
    return sent.groupBy("channel", "level").agg(F.max("ts_us").alias("last_sent_us"), F.count(F.lit(1)).alias("n"))
