"""Security events: building, searching, statistics and compliance reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ip as IP
from ..functions import patterns as P
from ..functions.regex import settle
from .addresses import flag_listed


def security_events(raw: DataFrame, malicious: DataFrame) -> DataFrame:
    """requests to security events.

    Input columns: id, ts_us, source_ip, request_path, request_body, response_status, given_type,
    given_description, node_id (others pass through).  The threat score is taken before a listed
    address adds its indicator and lifts the level.
    """
    c = F.col
    e = flag_listed(raw, malicious, "source_ip", "is_malicious")
    # matched once; five of the columns below depend on it
    e = settle(e, e.columns, {"threat_indicators": P.threat_indicators(c("request_path"), c("request_body"))})
    e = (e.withColumn("event_type", P.event_type(c("threat_indicators"), c("given_type"), c("response_status")))
          .withColumn("security_level", P.security_level(c("threat_indicators"), c("response_status"))))
    e = (e.withColumn("compliance_tags", P.compliance_tags(c("event_type")))
          .withColumn("description", F.coalesce("given_description", F.concat("event_type", F.lit(" detected"))))
          .withColumn("geo_location", IP.geo_struct(c("source_ip")))
          .withColumn("threat_score", P.threat_score(c("event_type"), c("is_malicious"),
                                                     c("threat_indicators"), c("security_level"))))
    e = (e.withColumn("threat_indicators", F.when(c("is_malicious"), F.array_append(
            "threat_indicators", F.lit("known_malicious_ip"))).otherwise(c("threat_indicators")))
          .withColumn("security_level", F.when(c("is_malicious"), F.lit("high")).otherwise(c("security_level"))))
    e = e.withColumn("timestamp", F.timestamp_micros("ts_us"))
    return e.withColumn("checksum", checksum()).drop("given_type", "given_description")


def checksum() -> Column:
    c = F.col
    return P.event_checksum(c("id"), c("event_type"), c("timestamp"), c("source_ip"), c("description"))


def verify_integrity() -> Column:
    """The stored checksum equals a fresh one."""
    return F.col("checksum").eqNullSafe(checksum())


def search_events(events: DataFrame, start_us=None, end_us=None, types=None, levels=None, ips=None,
                  limit: int | None = None) -> DataFrame:
    """newest first; both ends of the time range are included.  All of them, unless a page of ``limit`` is asked for."""
    for cond in ([F.col("ts_us") >= start_us] if start_us is not None else []) + \
                ([F.col("ts_us") <= end_us] if end_us is not None else []) + \
                [F.col(n).isin(list(v)) for n, v in (("event_type", types), ("security_level", levels),
                                                     ("source_ip", ips)) if v]:
        events = events.where(cond)
    out = events.orderBy(F.desc("ts_us"), F.desc("event_id"))
    return out if limit is None else out.limit(limit)


def recent_events(events: DataFrame, as_of_us: int, hours: int, event_type: str | None = None,
                  limit: int | None = None) -> DataFrame:
    """F16: system-log events of the last hours, newest first."""
    if hours <= 0 or (limit is not None and limit <= 0):
        raise ValueError("hours and limit must be positive")
    out = events.where(F.col("ts_us") >= as_of_us - hours * 3_600_000_000)
    if event_type:
        out = out.where(F.col("event_type") == event_type)
    out = out.orderBy(F.desc("ts_us"), F.desc("event_id"))
    return out if limit is None else out.limit(limit)


def security_statistics(events: DataFrame, since_us: int) -> DataFrame:
    """AG16: one pass of grouping sets: total, by type, by level, by node (dimension, key, n)."""
    e = events.where(F.col("ts_us") >= since_us)
    dims = ["event_type", "security_level", "node_id"]
    g = e.groupingSets([[F.col(d)] for d in dims] + [[]], *dims).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    dim = F.lit("total")
    key = F.lit("")
    for d in dims:
        dim = F.when(F.col(f"_g_{d}") == 0, d).otherwise(dim)
        key = F.when(F.col(f"_g_{d}") == 0, F.col(d)).otherwise(key)
    return g.select(dim.alias("dimension"), key.alias("key"), "n")


def top_event_ips(events: DataFrame, since_us: int, n: int = 10) -> DataFrame:
    """TK06."""
    return (events.where(F.col("ts_us") >= since_us).groupBy("source_ip").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "source_ip").limit(n))


def threat_statistics(events: DataFrame) -> DataFrame:
    """AG17."""
    return events.agg(F.avg("threat_score").alias("avg_threat_score"),
                      F.max("threat_score").alias("max_threat_score"),
                      F.count_if(F.col("threat_score") >= 70).alias("high_threat_events"))


def compliance_source(events: DataFrame, standard: str, start_us: int, end_us: int) -> DataFrame:
    """All events of the period that are tagged with the standard."""
    return events.where(F.col("ts_us").between(start_us, end_us) & F.array_contains("compliance_tags", standard))


def _n(*types) -> Column:
    return F.count_if(F.col("event_type").isin(*types))


def compliance_report(events: DataFrame, standard: str, start_us: int, end_us: int) -> DataFrame:
    """AG18-AG20: the summary of one standard as one row."""
    e = compliance_source(events, standard, start_us, end_us)
    total = F.count(F.lit(1)).alias("total_events")
    if standard == "pci_dss":
        return e.agg(total, _n("login_failure").alias("failed_login_attempts"),
                     _n("login_success").alias("successful_logins"),
                     _n("unauthorized_access").alias("unauthorized_access_attempts")).withColumns({
                         "req_8_1_events": F.col("failed_login_attempts") + F.col("successful_logins"),
                         "req_8_1_status": F.when(F.col("failed_login_attempts") < 100, "compliant")
                         .otherwise("non_compliant"),
                         "req_10_2_status": F.lit("compliant")})
    if standard == "gdpr":
        return e.agg(total, _n("data_exfiltration").alias("data_breach_incidents"),
                     _n("unauthorized_access").alias("unauthorized_access_attempts")).withColumn(
                         "required_within_72h", F.col("data_breach_incidents") > 0)
    if standard == "hipaa":
        return e.agg(total, F.count_if(F.lower("description").contains("phi")).alias("phi_access_events"))
    return e.agg(total)


def compliance_events(events: DataFrame, standard: str, start_us: int, end_us: int, n: int | None = None) -> DataFrame:
    """The events a report is made of, newest first; a page of the newest ``n`` where one is asked for."""
    out = compliance_source(events, standard, start_us, end_us).orderBy(F.desc("ts_us"), F.desc("event_id"))
    return out if n is None else out.limit(n)
