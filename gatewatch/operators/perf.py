"""Metrics, endpoints, traces and node health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from .prefix import SECOND, exact_quantiles


def metric_summary(samples: DataFrame, as_of_us: int, window_s: int = 300) -> DataFrame:
    """AG11."""
    s = samples.where(F.col("ts_us") >= as_of_us - window_s * SECOND)
    v = F.col("value")
    base = s.groupBy("name").agg(F.count(v).alias("count"), F.avg(v).alias("avg"), F.min(v).alias("min"),
                                 F.max(v).alias("max"), F.stddev_pop(v).alias("std"))
    return base.join(exact_quantiles(s, ["name"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}), "name")


def endpoint_summary(requests: DataFrame) -> DataFrame:
    """AG12 per method and endpoint (columns request_method, request_path, status, request_time)."""
    keys = ["request_method", "request_path"]
    base = requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_if(F.col("status") >= 400).alias("error_count"),
        F.avg("request_time").alias("avg_response_time"))
    q = exact_quantiles(requests, keys, "request_time", {"p95_response_time": 0.95, "p99_response_time": 0.99})
    return (base.join(q, keys).withColumn("error_rate", F.col("error_count") / F.col("total_requests"))
            .withColumn("endpoint", F.concat_ws(":", *keys)))


def resource_average(samples: DataFrame, last: int | None = 100) -> DataFrame:
    """AG13: mean of each resource's last samples (ranked with a per-task cut, so no list builds up); of all for None."""
    if last is None:
        return samples.groupBy("name").agg(F.avg("value").alias("average"))
    w = Window.partitionBy("name").orderBy(F.desc("ts_us"), F.desc("event_id"))
    return (samples.withColumn("_r", F.row_number().over(w)).where(f"_r <= {last}")
            .groupBy("name").agg(F.avg("value").alias("average")))


def trace_statistics(spans: DataFrame, as_of_us: int, window_s: int = 3600) -> DataFrame:
    """AG14: per operation and overall (operation_name NULL)."""
    s = spans.where((F.col("start_us") >= as_of_us - window_s * SECOND) & F.col("duration").isNotNull())
    d = F.col("duration")
    # every span counts for its operation and for the whole
    both = s.withColumn("operation", F.explode(F.array(F.col("operation_name"), F.lit("*"))))
    base = both.groupBy("operation").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("status") == "error").alias("error_count"),
        F.avg(d).alias("avg_duration"), F.min(d).alias("min_duration"), F.max(d).alias("max_duration"))
    q = exact_quantiles(both, ["operation"], "duration",
                        {"p50_duration": 0.5, "p95_duration": 0.95, "p99_duration": 0.99})
    return base.join(q, "operation").withColumn("error_rate", F.col("error_count") / F.col("count"))


def trace(spans: DataFrame, active: DataFrame, trace_id: str) -> DataFrame:
    """J11 / SO04."""
    return (active.unionByName(spans).where(F.col("trace_id") == trace_id)
            .orderBy("start_us", "span_id"))


def performance_alerts(endpoints: DataFrame, resources: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """AG15: endpoint latency and error rate, resource averages: (type, severity, metric, subject, value)."""
    t = {**R.PERF_THRESHOLDS, **(thresholds or {})}
    row = lambda df, cond, typ, sev, metric, subject, value: df.where(cond).select(
        F.lit(typ).alias("type"), F.lit(sev).alias("severity"), F.lit(metric).alias("metric"),
        subject.alias("subject"), value.alias("value"), F.lit(float(t[metric])).alias("threshold"))
    c = F.col
    out = row(endpoints, c("p95_response_time") > t["response_time_p95"], "performance_degradation", "high",
              "response_time_p95", c("endpoint"), c("p95_response_time"))
    out = out.unionByName(row(endpoints, c("error_rate") > t["error_rate"], "high_error_rate", "high",
                              "error_rate", c("endpoint"), c("error_rate")))
    for name, typ in (("cpu_usage", "high_cpu_usage"), ("memory_usage", "high_memory_usage")):
        out = out.unionByName(row(resources, (c("name") == name) & (c("average") > t[name]), typ, "medium",
                                  name, c("name"), c("average")))
    return out


def health_score(nodes: DataFrame) -> DataFrame:
    """AG31 per node (stopped_services, disk_pct, mem_pct, errors_last_hour), disk deductions included."""
    c = F.col
    score = (F.lit(100) - 20 * c("stopped_services")
             - F.when(c("disk_pct") > 95, 30).when(c("disk_pct") > 90, 10).otherwise(0)
             - F.when(c("mem_pct") > 90, 20).when(c("mem_pct") > 80, 10).otherwise(0)
             - F.when(c("errors_last_hour") > 10, 15).otherwise(0))
    return nodes.withColumn("health_score", score.cast("bigint")).withColumn(
        "band", F.when(c("health_score") >= 90, "excellent").when(c("health_score") >= 70, "good")
        .when(c("health_score") >= 50, "fair").otherwise("poor"))


def agent_counters(batches: DataFrame) -> DataFrame:
    """AG27 per node (processed, sent, failed, bytes, errors)."""
    names = ("processed", "sent", "failed", "bytes", "errors")
    return batches.groupBy("node_id").agg(*[F.sum(n).alias(n) for n in names])


def source_statistics(reads: DataFrame) -> DataFrame:
    """AG26 over an operation log (source, op, ok)."""
    ok, op = F.col("ok"), F.col("op")
    return reads.groupBy("source").agg(
        F.count_if((op == "read") & ok).alias("logs_read"), F.count_if((op == "write") & ok).alias("logs_written"),
        F.count_if(~ok).alias("error_count"), F.bool_or(ok).alias("connected"))


def event_type_counts(events: DataFrame) -> DataFrame:
    """AG29: counts of all types."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
