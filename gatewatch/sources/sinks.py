"""Writing: access logs, bans, audit events, exports, capped lists, dead letters, fan-out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse as P
from ..operators.prefix import attach_row


def access_log_rows(rows: DataFrame, processed_us=None) -> DataFrame:
    """Rows as stored, with node, processing time and the date they are partitioned by."""
    done = F.lit(processed_us) if processed_us is not None else F.unix_micros(F.current_timestamp())
    return rows.withColumn("processed_us", done).withColumn(
        "date", F.to_date(F.timestamp_micros("ts_us")))


def write_access_log(rows: DataFrame, path: str, processed_us=None) -> None:
    """Append by date.  Rows of an address are clustered inside the files, so a lookup reads few
    row groups; busy dates are spread over tasks by address and time instead of one task per date."""
    r = access_log_rows(rows, processed_us)
    (r.repartition("date", "remote_addr", F.expr("ts_us div 600000000")).sortWithinPartitions("remote_addr", "ts_us")
      .write.mode("append").partitionBy("date").parquet(path))


def write_bans(bans: DataFrame, path: str) -> None:
    """S11."""
    bans.write.mode("append").parquet(path)


def audit_rows(events: DataFrame) -> DataFrame:
    """Events as stored: nested fields as JSON text, NULL geo stays NULL."""
    out = events
    for f in events.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out = out.withColumn(f.name, F.to_json(f.name))
    return out.withColumn("date", F.to_date("timestamp"))


def write_audit(events: DataFrame, path: str) -> None:
    audit_rows(events).write.mode("append").partitionBy("date", "event_type").parquet(path)


def write_log_lines(entries: DataFrame, path: str, fmt: str = "json") -> None:
    """S13."""
    line = P.format_entry_json(entries) if fmt == "json" else P.format_entry_clf(entries)
    line.select("value").write.mode("append").text(path)


def newest(rows: DataFrame, max_entries: int, ts: str, tie: str) -> DataFrame:
    """What a capped list keeps.  Top-k: each task offers its own best rows."""
    return rows.orderBy(F.desc(ts), F.desc(tie)).limit(max_entries)


def dead_letters(batches: DataFrame, failed_us) -> DataFrame:
    """Failed batches with the time of the failure and a retry count of 0."""
    return batches.withColumn("failed_us", F.lit(failed_us)).withColumn("retry_count", F.lit(0))


def replayable(letters: DataFrame, max_retries: int = 3, payload: str = "value") -> DataFrame:
    """Letters that may be sent again; text that is no JSON is dropped for good.

    A failed replay leaves the stored retry count as it was.
    """
    ok = F.try_parse_json(payload).isNotNull()
    return letters.where(ok & (F.coalesce("retry_count", F.lit(0)) < max_retries))


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def export_behaviour(statistics: DataFrame, top: DataFrame, per_ip: DataFrame, folder: str) -> None:
    """Three JSON datasets in one folder."""
    for name, df in (("statistics", statistics), ("top_risky_ips", top), ("ip_behaviors", per_ip)):
        export_json(df, f"{folder}/{name}")


def in_range(rows: DataFrame, start_us=None, end_us=None, ts: str = "ts_us") -> DataFrame:
    """Both ends included, either end open."""
    if start_us is not None:
        rows = rows.where(F.col(ts) >= start_us)
    if end_us is not None:
        rows = rows.where(F.col(ts) <= end_us)
    return rows


def export_performance(metrics: DataFrame, spans: DataFrame, start_us=None, end_us=None):
    """(metrics, spans, one row of counts)."""
    m = in_range(metrics, start_us, end_us)
    s = in_range(spans.where("duration is not null"), start_us, end_us, "start_us")
    counts = attach_row(m.agg(F.count(F.lit(1)).alias("metrics_count")),
                        s.agg(F.count(F.lit(1)).alias("spans_count")))
    return m, s, counts


def training_samples(features: DataFrame, label: str, names: list[str]) -> DataFrame:
    """Labelled samples as they are exported."""
    m = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])
    return features.select("event_id", F.col(label).alias("label"), F.timestamp_micros("ts_us").alias("timestamp"),
                           m.alias("features"))
