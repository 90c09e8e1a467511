"""Security-log views derived from the generic test tables.

Every view is one SELECT, written once and rendered for Spark and for DuckDB, so that a query and
its check read exactly the same rows.  30 days of events are squeezed 3600 times into 12 minutes
(rate rules fire) and user ranges are folded into a few busy addresses.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex import settle
from ..session import pin_utc

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
EPOCH = 1704067200000000  # 2024-01-01T00:00:00Z in µs


class SparkText:
    us = "unix_micros(CAST({} AS TIMESTAMP))"
    idiv = "(({}) div ({}))"
    log_time = "concat(date_format(timestamp_micros({}), 'dd/MMM/yyyy:HH:mm:ss'), ' +0000')"
    iso_time = "date_format(timestamp_micros({}), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
    sql_time = "date_format(timestamp_micros({}), 'yyyy-MM-dd HH:mm:ss')"
    slash_time = "date_format(timestamp_micros({}), 'yyyy/MM/dd HH:mm:ss')"
    syslog_time = "date_format(timestamp_micros({}), 'MMM d HH:mm:ss')"
    prefix = "gw_"


class DuckText:
    us = "epoch_us({})"
    idiv = "(({}) // ({}))"
    log_time = "concat(strftime(make_timestamp({}), '%d/%b/%Y:%H:%M:%S'), ' +0000')"
    iso_time = "strftime(make_timestamp({}), '%Y-%m-%dT%H:%M:%S.%f')"
    sql_time = "strftime(make_timestamp({}), '%Y-%m-%d %H:%M:%S')"
    slash_time = "strftime(make_timestamp({}), '%Y/%m/%d %H:%M:%S')"
    syslog_time = "strftime(make_timestamp({}), '%b %-d %H:%M:%S')"
    prefix = ""


def _squeeze(d):
    return f"{EPOCH} + {d.idiv.format(d.us.format('ts') + f' - {EPOCH}', 3600)}"


def access_log(d):
    third = d.idiv.format("user_id", 250)
    return f"""
SELECT event_id, ts_us, remote_addr,
  CASE WHEN event_type='signup' THEN 'POST' WHEN event_type='purchase' THEN 'PUT' ELSE 'GET' END AS request_method,
  CASE WHEN event_id % 23 = 0 THEN '/index.php?id=1 union select * from users'
       WHEN event_id % 29 = 0 THEN '/search?q=<script>alert(1)</script>'
       WHEN event_id % 31 = 0 THEN '/../../etc/passwd'
       WHEN event_id % 37 = 0 THEN '/run?cmd=;cat%20/etc/shadow'
       WHEN user_id BETWEEN 40 AND 49 AND event_id % 3 = 0 THEN concat(CASE event_id % 7
            WHEN 0 THEN '/admin' WHEN 1 THEN '/wp-admin' WHEN 2 THEN '/.env' WHEN 3 THEN '/.git'
            WHEN 4 THEN '/backup' WHEN 5 THEN '/phpmyadmin' ELSE '/config' END, '/')
       ELSE concat('/p/', CAST(event_id % (CASE WHEN user_id BETWEEN 30 AND 39 THEN 997 ELSE 13 END) AS STRING)) END AS request_uri,
  CAST(CASE WHEN user_id BETWEEN 30 AND 39 AND event_id % 2 = 0 THEN 404
       WHEN event_type='error' THEN (CASE event_id % 5 WHEN 0 THEN 500 WHEN 1 THEN 403 WHEN 2 THEN 401 ELSE 404 END)
       ELSE 200 END AS BIGINT) AS status,
  CAST(floor(value * 1000) AS BIGINT) AS body_bytes_sent,
  CASE event_id % 11 WHEN 0 THEN 'sqlmap/1.0' WHEN 1 THEN 'curl/7.68.0'
       WHEN 2 THEN 'Googlebot/2.1 (+http://www.google.com/bot.html)' WHEN 3 THEN ''
       ELSE concat('Mozilla/5.0 (X11; v', CAST(user_id % 4 AS STRING), ')') END AS http_user_agent,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'http://ref.example.com/' END AS http_referer,
  value / 10 AS request_time, event_type, user_id,
  concat('node-', CAST(user_id % 4 AS STRING)) AS node_id
FROM (SELECT event_id, user_id, event_type, value, {_squeeze(d)} AS ts_us,
    CASE WHEN user_id < 20 THEN '45.33.0.1' WHEN user_id < 30 THEN '120.9.0.1'
         WHEN user_id < 40 THEN '8.8.4.4'   WHEN user_id < 45 THEN '10.0.0.5'
         WHEN user_id < 50 THEN '66.7.0.1'
         ELSE concat(CASE user_id % 5 WHEN 0 THEN '23.4.' WHEN 1 THEN '66.8.' WHEN 2 THEN '120.10.'
                                      WHEN 3 THEN '192.168.' ELSE '203.0.' END,
              CAST({third} % 250 AS STRING), '.', CAST(user_id % 250 AS STRING)) END AS remote_addr
  FROM {d.prefix}events) e"""


def raw_log(d):
    return f"""
SELECT event_id, concat(remote_addr, ' - ', CASE WHEN event_id % 9 = 0 THEN 'alice' ELSE '-' END, ' [',
  {d.log_time.format('ts_us')}, '] "', request_method, ' ', replace(request_uri, ' ', '%20'), ' HTTP/1.1" ',
  CAST(status AS STRING), ' ', CASE WHEN event_id % 101 = 0 THEN '-' ELSE CAST(body_bytes_sent AS STRING) END, ' "',
  coalesce(http_referer, '-'), '" "', CASE WHEN http_user_agent = '' THEN '-' ELSE http_user_agent END, '"') AS value
FROM access_log"""


def timed_log(d):
    return """
SELECT event_id, concat(value, ' ', CASE WHEN event_id % 7 = 0 THEN '-' ELSE CAST(event_id % 40 AS STRING) END,
  ' ', CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE concat('0.', CAST(100 + event_id % 800 AS STRING)) END) AS value
FROM raw_log"""


def clf_log(d):
    """Generic lines: user always absent, size may be absent, agent may be empty."""
    return f"""
SELECT event_id, concat(remote_addr, ' - - [', {d.log_time.format('ts_us')}, '] "', request_method, ' ',
  replace(request_uri, ' ', '%20'), ' HTTP/1.1" ', CAST(status AS STRING), ' ',
  CASE WHEN event_id % 101 = 0 THEN '-' ELSE CAST(body_bytes_sent AS STRING) END, ' "',
  coalesce(http_referer, ''), '" "', http_user_agent, '"') AS value
FROM access_log"""


def json_log(d):
    q = "'\"'"
    return f"""
SELECT event_id, CASE WHEN event_id % 53 = 0 THEN '{{"broken": ' ELSE concat('{{',
  CASE event_id % 4 WHEN 0 THEN '"timestamp"' WHEN 1 THEN '"time"' WHEN 2 THEN '"@timestamp"' ELSE '"other"' END,
  ': "', {d.iso_time.format('ts_us')}, 'Z", ',
  CASE WHEN event_id % 3 = 0 THEN concat('"ip": "', remote_addr, '", ') ELSE concat('"remote_addr": "', remote_addr, '", ') END,
  CASE WHEN event_id % 5 = 0 THEN '"level": "WARNING", ' ELSE '' END,
  CASE WHEN event_id % 2 = 0 THEN '"url"' ELSE '"path"' END, ': ', {q}, request_uri, {q}, ', ',
  '"method": ', {q}, request_method, {q}, ', "status": ', CAST(status AS STRING), ', "size": ',
  CAST(body_bytes_sent AS STRING), ', "node": ', {q}, node_id, {q}, '}}') END AS value
FROM access_log"""


def system_log(d):
    ts, ip = d.sql_time.format("ts_us"), "remote_addr"
    reason = ("CASE event_id % 6 WHEN 0 THEN 'sql injection attempt' WHEN 1 THEN 'reason=brute force login' "
              "WHEN 2 THEN 'due to: rate limit exceeded' WHEN 3 THEN 'xss script' WHEN 4 THEN '404 flood scan' "
              "ELSE 'unclear' END")
    kind = ("CASE event_id % 7 WHEN 0 THEN 'sql_injection' WHEN 1 THEN 'xss' WHEN 2 THEN 'path traversal' "
            "WHEN 3 THEN 'brute_force' WHEN 4 THEN 'flood' WHEN 5 THEN 'csrf' ELSE 'odd' END")
    level = "CASE event_id % 4 WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'ERROR' ELSE 'CRITICAL' END"
    q = "'\"'"
    return f"""
SELECT event_id, CASE
  WHEN event_id % 10 < 3 THEN concat({ts}, ' - ', node_id, ' - WARNING - [ip_banned] IP ', {ip}, ' has been banned for 60 minutes: ', {reason})
  WHEN event_id % 10 = 3 AND user_id % 2 = 0 THEN concat({ts}, ' - ', node_id, ' - INFO - [ip_unbanned] IP ', {ip}, ' has been unbanned')
  WHEN event_id % 10 < 6 THEN concat({ts}, ' - ', node_id, ' - ', {level}, ' - [attack_detected] Attack detected from IP ', {ip}, ': ', {kind})
  WHEN event_id % 10 = 6 THEN concat('{{"timestamp": "', {d.iso_time.format('ts_us')}, 'Z", "event_type": "ip_banned", "level": "WARNING", ',
       '"ip": ', {q}, {ip}, {q}, ', "message": "ban_reason: ', {kind}, ' seen"}}')
  WHEN event_id % 10 = 7 THEN concat({d.slash_time.format('ts_us')}, ' performance report of the system')
  WHEN event_id % 10 = 8 THEN concat({d.syslog_time.format('ts_us')}, ' host app: error, IP ', {ip}, ' unbanned')
  ELSE concat('[', {ts}, '] IP ', {ip}, ' banned') END AS value
FROM access_log"""


def ban_records(d):
    return """
SELECT remote_addr AS ip, ts_us, event_id, 30 + (event_id % 4) * 30 AS duration_s,
  concat('rule ', CAST(event_id % 3 AS STRING)) AS reason, node_id
FROM access_log WHERE event_type = 'signup'"""


def metrics(d):
    return """
SELECT event_id, event_type AS name, value * 1.0 AS value, ts_us, node_id, value > 150 AS is_anomaly
FROM (SELECT event_id, event_type, ts_us, node_id, request_time * 10 AS value FROM access_log) m"""


def spans(d):
    return """
SELECT CAST(user_id AS STRING) AS trace_id, event_id AS span_id, event_type AS operation_name, ts_us AS start_us,
  CASE WHEN event_id % 50 = 0 THEN NULL ELSE request_time * 10 END AS duration,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, node_id
FROM access_log"""


def alerts(d):
    return """
SELECT event_id, ts_us, remote_addr AS source_ip, node_id,
  CASE event_id % 4 WHEN 0 THEN 'threshold_exceeded' WHEN 1 THEN 'anomaly_detected' WHEN 2 THEN 'attack_detected' ELSE 'system_health' END AS type,
  CASE status WHEN 500 THEN 'critical' WHEN 404 THEN 'high' WHEN 403 THEN 'medium' ELSE 'low' END AS severity,
  event_id % 3 = 0 AS resolved,
  CASE WHEN event_id % 3 = 0 THEN ts_us + (event_id % 600) * 1000000 END AS resolved_us
FROM access_log WHERE status >= 400"""


def security_input(d):
    """Requests as raw security events: a body now and then, a given type now and then."""
    return """
SELECT event_id, CAST(event_id AS STRING) AS id, ts_us, remote_addr AS source_ip, http_user_agent AS user_agent,
  request_method, request_uri AS request_path,
  CASE WHEN event_id % 41 = 0 THEN 'x=1&y=<iframe src=q>' END AS request_body,
  status AS response_status, body_bytes_sent AS response_size, node_id,
  CASE event_id % 13 WHEN 0 THEN 'data_exfiltration' WHEN 1 THEN 'login_success' WHEN 2 THEN 'brute_force_attack' WHEN 3 THEN 'no such type' END AS given_type,
  CASE WHEN event_id % 17 = 0 THEN 'PHI record opened' END AS given_description
FROM access_log"""


def malicious_ips(d):
    cut = lambda i: f"CAST(split_part(remote_addr, '.', {i}) AS INT)"
    return f"""
SELECT DISTINCT remote_addr AS ip FROM access_log
WHERE ({cut(1)} + {cut(2)} + {cut(3)} + {cut(4)}) % 7 = 0"""


def networks(d):
    """One allow-list entry per supplier: networks of several lengths plus some broken texts."""
    return f"""
SELECT s_suppkey, CASE s_suppkey % 10 WHEN 0 THEN '192.168.0.0/16' WHEN 1 THEN '10.0.0.0/8'
  WHEN 2 THEN concat('23.4.0.', CAST(s_suppkey % 256 AS STRING), '/32')
  WHEN 3 THEN concat('66.8.0.', CAST(s_suppkey % 256 AS STRING))
  WHEN 4 THEN 'not a network' ELSE concat('172.16.', CAST(s_suppkey % 256 AS STRING), '.0/24') END AS cidr
FROM {d.prefix}supplier"""


def geo_ranges(d):
    """One range per nation: 25 equal slices of the first octet."""
    return f"""
SELECT n_name AS country, CASE n_nationkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk_level,
  4 AS family, CAST(n_nationkey AS BIGINT) * 10 * 16777216 AS lo, (CAST(n_nationkey AS BIGINT) + 1) * 10 * 16777216 - 1 AS hi
FROM {d.prefix}nation"""


def tenants(d):
    return f"""
SELECT n_nationkey AS tenant_id, n_name AS name, {EPOCH} + CAST(n_nationkey AS BIGINT) * 86400000000 AS created_us,
  CASE n_nationkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'suspended' WHEN 2 THEN 'active' ELSE 'inactive' END AS status,
  CAST(1000 AS BIGINT) AS max_banned_ips, CAST(100 AS BIGINT) AS max_rules,
  CAST(n_nationkey % 5 * 20 AS BIGINT) AS max_users, CAST(10000 AS BIGINT) AS max_api_requests_per_hour,
  CAST(1000 AS BIGINT) AS max_storage_mb, CAST(300 AS BIGINT) AS max_concurrent_sessions
FROM {d.prefix}nation"""


def users(d):
    return f"""
SELECT c_custkey AS user_id, c_nationkey AS tenant_id, c_name AS username, {EPOCH} + c_custkey * 1000000 AS created_us,
  CASE c_custkey % 5 WHEN 0 THEN 'viewer' WHEN 1 THEN 'operator' WHEN 2 THEN 'security_admin' WHEN 3 THEN 'tenant_admin'
    ELSE CASE WHEN c_custkey % 25 = 4 THEN 'super_admin' ELSE 'viewer' END END AS role,
  CASE c_custkey % 3 WHEN 0 THEN 'log:export' WHEN 1 THEN 'ip:view' END AS extra_permission,
  c_acctbal > 0 AS is_active
FROM {d.prefix}customer"""


def sessions(d):
    us = d.us.format("o_orderdate")
    return f"""
SELECT o_orderkey AS session_id, o_custkey AS user_id, concat('t', CAST(o_orderkey AS STRING)) AS token,
  {us} AS created_us, {us} + 86400000000 AS expires_us, o_orderstatus <> 'F' AS is_active
FROM {d.prefix}orders"""


def heartbeats(d):
    return """
SELECT node_id, ts_us, event_id, remote_addr AS host FROM access_log WHERE event_type = 'view'"""


def notifications(d):
    return """
SELECT event_id, ts_us, node_id AS source,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'ban' WHEN 'purchase' THEN 'unban' WHEN 'click' THEN 'warning' ELSE 'info' END AS level
FROM access_log"""


VIEWS = {f.__name__: f for f in (
    access_log, raw_log, timed_log, clf_log, json_log, system_log, ban_records, metrics, spans, alerts,
    security_input, malicious_ips, networks, geo_ranges, tenants, users, sessions, heartbeats, notifications)}


def _needed(sql: str, views: dict, extra: dict) -> list[str]:
    have, todo = set(), [sql]
    bodies = {n: views[n] for n in views} | extra
    while todo:
        text = todo.pop()
        for n, body in bodies.items():
            if n not in have and re.search(rf"\b{n}\b", text):
                have.add(n)
                todo.append(body)
    return [n for n in bodies if n in have]


def with_views(sql: str, d, extra: dict[str, str] | None = None) -> str:
    """``sql`` preceded by the views it names (and those they name) as common table expressions."""
    extra = extra or {}
    bodies = {n: f(d) for n, f in VIEWS.items()} | extra
    names = _needed(sql, {n: f(d) for n, f in VIEWS.items()}, extra)
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({bodies[n].strip()})" for n in names)
    return f"WITH RECURSIVE {ctes}\n{sql.strip()}" if d is DuckText else f"WITH {ctes}\n{sql.strip()}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    """A derived view as a DataFrame over the tables of ``sf_dir``, or a stream over their files."""
    pin_utc(spark)
    sql = with_views(f"SELECT * FROM {name}", SparkText)
    for t in TABLES:
        if re.search(rf"\bgw_{t}\b", sql):
            df = table(spark, sf_dir, t)
            if stream:
                df = spark.readStream.schema(df.schema).option("pathGlobFilter", f"{t}.parquet").parquet(sf_dir)
            df.createOrReplaceTempView(f"gw_{t}")
    out = spark.sql(sql)
    # a log view stands for a table of lines: make each line once, however often it is read
    return settle(out, ["event_id"], {"value": F.col("value")}) if out.columns == ["event_id", "value"] else out
