"""Declared policies as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ip as IP
from ..operators import bans as BA
from ..operators import policies as PO
from . import oracle_views as O
from .q_reports import END
from .registry import query

c = lambda n: F.col(n)


def _w(sec):
    return f"OVER (PARTITION BY remote_addr ORDER BY ts_us RANGE BETWEEN {sec}000000 PRECEDING AND CURRENT ROW)"


@query("x01_not_found_rate", f"SELECT event_id, n404 >= 20 AND n404 >= n * 0.5 AS fires FROM (SELECT event_id, count(*) {_w(300)} AS n, count(*) FILTER (WHERE status = 404) {_w(300)} AS n404 FROM access_log) t")
def x01(d):
    return PO.not_found_rate(d.access_log).select("event_id", "fires")


@query("x02_server_error_burst", f"SELECT event_id, count(*) FILTER (WHERE status >= 500) {_w(180)} >= 3 AS fires FROM access_log")
def x02(d):
    return PO.server_error_burst(d.access_log, count=3).select("event_id", "fires")


@query("x03_brute_force", f"SELECT event_id, CASE WHEN count(*) FILTER (WHERE request_uri LIKE '/admin%' OR request_uri LIKE '/login%' OR request_uri LIKE '/wp-admin%') {_w(300)} >= 3 THEN 95 ELSE 0 END AS score FROM access_log")
def x03(d):
    return PO.brute_force(d.access_log, count=3).select("event_id", "score")


@query("x04_weighted_score", f"""
SELECT event_id, round((0.4 * (CASE WHEN status >= 400 THEN 80 ELSE 0 END) + 0.3 * least(request_time, 100) + 0.2 * (CASE WHEN {O.COUNTRY} IN ('CN','RU','KP') THEN 50 ELSE 0 END) + 0.1 * 40) * power(0.9, ({END} - ts_us) / 60000000.0), 6) AS score FROM access_log""")
def x04(d):
    parts = {"pattern_match": F.when(c("status") >= 400, 80).otherwise(0), "frequency": F.least("request_time", F.lit(100.0)),
             "geolocation": PO.country_score(IP.geo_struct(c("remote_addr"))["country"]), "user_agent": F.lit(40)}
    age = (F.lit(END) - c("ts_us")) / 60_000_000
    return d.access_log.select("event_id", F.round(PO.weighted_score(parts, age), 6).alias("score"))


@query("x05_retention", f"SELECT event_id FROM alerts WHERE ts_us >= {END + 365 * 86400000000} - (CASE severity WHEN 'critical' THEN 1095 WHEN 'high' THEN 730 WHEN 'medium' THEN 365 ELSE 90 END) * 86400000000")
def x05(d):
    return PO.retained(d.alerts, END + 365 * 86_400_000_000).select("event_id")


@query("x06_line_filters", "SELECT event_id FROM system_log WHERE contains(value, 'IP') AND NOT contains(value, 'CRITICAL')")
def x06(d):
    return PO.filter_lines(d.system_log, ["IP"], ["CRITICAL"]).select("event_id")


@query("x07_pattern_rate", f"SELECT event_id FROM (SELECT event_id, count(*) {_w(300)} AS n FROM access_log WHERE regexp_matches(concat(request_method, ' ', status), 'GET .*404')) t WHERE n >= 20")
def x07(d):
    lines = d.access_log.withColumn("value", F.concat_ws(" ", "request_method", c("status").cast("string")))
    return PO.pattern_rate(lines, "remote_addr", "GET .*404", 20, 300).select("event_id")


@query("x08_escalating_bans", """
SELECT ip, ts_us AS start_us, CAST(least(60 * power(2, row_number() OVER (PARTITION BY ip ORDER BY ts_us) - 1), 900) AS BIGINT) AS ban_seconds FROM st02_chain""")
def x08(d):
    i = BA.ban_intervals(d.ban_records, 120)
    return BA.escalating_bans(i, 60, 2, 900).select("ip", "start_us", "ban_seconds")


@query("x09_alert_rule", "SELECT event_id, count(*) OVER (PARTITION BY node_id ORDER BY ts_us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) > 10 AS fires FROM metrics WHERE name = 'error'")
def x09(d):
    from ..operators.alerts import rule_alerts
    return rule_alerts(d.metrics, "error", 10, 60).select("event_id", "fires")
