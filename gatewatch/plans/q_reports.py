"""Reports, joins, filters, top lists and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..functions import ip as IP
from ..functions import parse as PA
from ..functions import patterns as PT
from ..functions import text as TX
from ..operators import alerts as AL
from ..operators import audit as AU
from ..operators import bans as BA
from ..operators import notify as NO
from ..operators import perf as PE
from ..operators import tenancy as TE
from ..operators import traffic as TR
from . import oracle_views as O
from .q_parse import sys_events
from .registry import query

c = lambda n: F.col(n)
END = 1704067920000000   # 2024-01-01T00:12:00Z, the end of the squeezed log
CUT = END - 300_000_000
N = F.count


def sec_events(d):
    return AU.security_events(d.security_input, d.malicious_ips)


# -- traffic ---------------------------------------------------------------------
@query("ag01_traffic_summary", f"""
SELECT count(*) AS total_requests, count(DISTINCT remote_addr) AS unique_ips, count(*) FILTER (WHERE n > 0) AS suspicious_requests,
 CAST(0 AS BIGINT) AS bot_requests, count(*) FILTER (WHERE {O.contains_any('lower(http_user_agent)', R.BOT_WORDS)}) AS bot_requests_seen,
 round(count(*) FILTER (WHERE n > 0)/CAST(count(*) AS DOUBLE)*100, 6) AS suspicious_rate FROM (SELECT *, {O.HITS} AS n FROM access_log) t""")
def ag01(d):
    t = TR.traffic_summary(d.access_log, F.coalesce(F.size(PT.suspicious_hits()) > 0, F.lit(False)))
    return t.withColumn("suspicious_rate", F.round("suspicious_rate", 6))


@query("ag01_status_and_methods", """
SELECT 'status' AS dimension, CAST(status AS VARCHAR) AS key, count(*) AS n FROM access_log GROUP BY 2
UNION ALL SELECT 'method', request_method, count(*) FROM access_log GROUP BY 2""")
def ag01b(d):
    return TR.dimension_counts(d.access_log, {"status": "status", "method": "request_method"})


@query("tk01_top_ips", "SELECT remote_addr, count(*) AS n FROM access_log GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def tk01(d):
    return TR.top_n(d.access_log, "remote_addr")


@query("tk02_top_user_agents", "SELECT http_user_agent, count(*) AS n FROM access_log GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def tk02(d):
    return TR.top_n(d.access_log, "http_user_agent")


# -- system log ------------------------------------------------------------------
_BAN = f"FROM sys_events WHERE event_type = 'ip_banned' AND ts_us >= {END} - 3600000000"
_ATT = f"FROM sys_events WHERE event_type = 'attack_detected' AND ts_us >= {END} - 3600000000"
_HOURK = "strftime(make_timestamp(ts_us), '%Y-%m-%d %H:00')"


@query("ag09_ban_statistics", f"""
SELECT (SELECT count(*) {_BAN}) AS total_bans, (SELECT count(*) {_BAN.replace('ip_banned', 'ip_unbanned')}) AS total_unbans,
 (SELECT count(DISTINCT nullif(ip_address, '')) {_BAN}) AS unique_banned_ips, (SELECT count(DISTINCT nullif(ip_address, '')) {_BAN.replace('ip_banned', 'ip_unbanned')}) AS unique_unbanned_ips,
 (SELECT count(*) FROM (SELECT nullif(ip_address, '') AS i {_BAN} EXCEPT SELECT nullif(ip_address, '') {_BAN.replace('ip_banned', 'ip_unbanned')}) x WHERE i IS NOT NULL) AS currently_banned""")
def ag09(d):
    return BA.ban_totals(sys_events(d), END, 1)


@query("ag09_ban_breakdown", f"""
SELECT 'reason' AS dimension, {O.BAN_REASON} AS key, count(*) AS n {_BAN} AND ip_address <> '' GROUP BY 2
UNION ALL SELECT 'hour', {_HOURK}, count(*) {_BAN} AND ip_address <> '' GROUP BY 2""")
def ag09b(d):
    return BA.ban_breakdown(sys_events(d), END, 1)


@query("ag10_attack_trends", f"""
SELECT 'type' AS dimension, {O.ATTACK_TYPE} AS key, count(*) AS n {_ATT} GROUP BY 2
UNION ALL SELECT 'hour', {_HOURK}, count(*) {_ATT} GROUP BY 2
UNION ALL SELECT 'severity', s.k, count(x.sev) FROM (VALUES ('low'), ('medium'), ('high'), ('critical')) s(k) LEFT JOIN (SELECT {O.SEVERITY} AS sev {_ATT}) x ON x.sev = s.k GROUP BY 2""")
def ag10(d):
    return BA.attack_breakdown(sys_events(d), END, 1)


@query("ag10_trend_direction", f"""
SELECT total_attacks, recent, CASE WHEN total_attacks = 0 THEN 'stable' WHEN recent > (total_attacks - recent) * 1.2 THEN 'increasing' WHEN recent < (total_attacks - recent) * 0.8 THEN 'decreasing' ELSE 'stable' END AS trend_direction
FROM (SELECT count(*) AS total_attacks, count(*) FILTER (WHERE ts_us >= {END}) AS recent {_ATT}) t""")
def ag10b(d):
    return BA.attack_trend(sys_events(d), END, 1)


@query("ag32_daily_ban_alarm", f"SELECT count(*) AS bans_today, count(*) > 100 AS alarm FROM sys_events WHERE event_type = 'ip_banned' AND ts_us >= 1704067200000000")
def ag32(d):
    return BA.daily_ban_alarm(sys_events(d), END)


@query("ag29_event_type_counts", "SELECT event_type, count(*) AS n FROM sys_events GROUP BY 1")
def ag29(d):
    return PE.event_type_counts(sys_events(d))


@query("j04_currently_banned", f"""
SELECT DISTINCT ip_address {_BAN} AND ip_address <> '' AND ip_address NOT IN (SELECT ip_address {_BAN.replace('ip_banned', 'ip_unbanned')} AND ip_address IS NOT NULL)""")
def j04(d):
    return BA.currently_banned(sys_events(d), END, 1)


@query("so02_ban_difference", f"SELECT DISTINCT ip_address {_BAN} AND ip_address <> '' EXCEPT SELECT ip_address {_BAN.replace('ip_banned', 'ip_unbanned')}")
def so02(d):
    return BA.currently_banned(sys_events(d), END, 1)


@query("tk04_top_banned", f"SELECT ip_address, count(*) AS n {_BAN} AND ip_address <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def tk04(d):
    return BA.top_banned(sys_events(d), END, 1)


@query("tk05_top_attackers", f"SELECT ip_address, count(*) AS n {_ATT} AND ip_address <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def tk05(d):
    return TR.top_n(BA.in_window(sys_events(d), END, 1, "attack_detected").where("ip_address <> ''"), "ip_address")


@query("tk07_attack_type_rank", f"SELECT {O.ATTACK_TYPE} AS attack_type, count(*) AS n FROM sys_events WHERE event_type = 'attack_detected' GROUP BY 1")
def tk07(d):
    e = sys_events(d).where("event_type = 'attack_detected'").withColumn("attack_type", TX.attack_type_label(c("message")))
    return TR.top_n(e, "attack_type", None)


@query("f16_recent_events", f"SELECT event_id, ts_us, event_type FROM sys_events WHERE ts_us >= {END} - 3600000000 AND event_type = 'attack_detected' ORDER BY ts_us DESC, event_id DESC LIMIT 500")
def f16(d):
    return AU.recent_events(sys_events(d), END, 1, "attack_detected", 500).select("event_id", "ts_us", "event_type")


@query("tk09_paged_logs", f"SELECT event_id, level FROM sys_events WHERE level = 'ERROR' AND ts_us >= {CUT} AND ts_us <= {END} AND contains(lower(message), 'attack') ORDER BY ts_us DESC, event_id DESC LIMIT 100")
def tk09(d):
    e = sys_events(d).where((c("level") == "ERROR") & c("ts_us").between(CUT, END) & F.lower("message").contains("attack"))
    return TR.page(e, [F.desc("ts_us"), F.desc("event_id")], 100).select("event_id", "level")


@query("ag23_today_counts", "SELECT count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-03-04' AND o_orderdate <= TIMESTAMP '1998-03-04 12:00:00') AS today FROM orders")
def ag23(d):
    o = d.orders.select(F.unix_micros(c("o_orderdate").cast("timestamp")).alias("ts_us"))
    return TR.today(o, 889012800000000, "today")


# -- bans ------------------------------------------------------------------------
_LAST = """SELECT ip, ts_us AS banned_us, reason, ts_us + duration_s * 1000000 AS expires_us FROM ban_records QUALIFY row_number() OVER (PARTITION BY ip ORDER BY ts_us DESC, event_id DESC) = 1"""


@query("st02_active_bans_last", _LAST)
def active_last(d):
    return BA.active_bans_last(d.ban_records)


@query("ag24_ban_state_counts", f"""
SELECT count(*) AS total_bans, count(*) FILTER (WHERE {CUT} < expires_us) AS active_bans, count(*) FILTER (WHERE {CUT} >= expires_us) AS expired_bans FROM ({_LAST}) t""")
def ag24(d):
    return BA.ban_state_counts(BA.active_bans_last(d.ban_records), CUT)


@query("st07_ban_expiry", f"SELECT ip, expires_us FROM ({_LAST}) t WHERE expires_us <= {END}")
def st07(d):
    return BA.expired(BA.active_bans_last(d.ban_records), END).select("ip", "expires_us")


@query("j12_ban_status", f"""
SELECT remote_addr, CASE WHEN remote_addr IN (SELECT ip FROM ({_LAST}) t WHERE expires_us > {CUT}) THEN 'banned' ELSE 'monitoring' END AS ban_status FROM access_log GROUP BY remote_addr""")
def j12(d):
    live = BA.active_bans_last(d.ban_records).where(c("expires_us") > CUT)
    return BA.ban_status(d.access_log.select("remote_addr").distinct(), live, "remote_addr").select(
        "remote_addr", "ban_status")


@query("j16_manual_ban_apply", f"""
SELECT ip, expires_us FROM ({_LAST}) t WHERE banned_us < {CUT} AND ip NOT LIKE '23.4.%'
UNION ALL SELECT ip, arg_min(ts_us + duration_s*1000000, ts_us) FROM ban_records WHERE event_id % 2 = 0 AND ip NOT LIKE '23.4.%' AND ip NOT IN (SELECT ip FROM ({_LAST}) t WHERE banned_us < {CUT}) GROUP BY 1""")
def j16(d):
    cur = BA.active_bans_last(d.ban_records).where(c("banned_us") < CUT)
    merged = BA.apply_manual_bans(cur, d.ban_records.where("event_id % 2 = 0"))
    unban = d.ban_records.where("ip LIKE '23.4.%'")
    return BA.apply_unbans(merged, unban)[0].select("ip", "expires_us")


@query("f22_valid_ban_request", r"""
SELECT event_id, regexp_matches(ip, '^([0-9]{1,3}\.){3}[0-9]{1,3}$') AND length(reason) BETWEEN 1 AND 200 AND duration_s BETWEEN 60 AND 2592000 AS valid,
 event_id % 7 <> 0 AND event_id % 5 <> 1 AS valid_log
FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'example.org' WHEN event_id % 5 = 1 THEN '1.2.3.999' ELSE ip END AS ip, reason, duration_s FROM ban_records) t""")
def f22(d):
    e = c("event_id")
    r = d.ban_records.withColumn("ip", F.when(e % 7 == 0, "example.org").when(e % 5 == 1, "1.2.3.999").otherwise(c("ip")))
    return BA.split_ban_requests(r).select("event_id", "valid", "valid_log")


@query("tk08_paged_ban_list", f"SELECT ip, banned_us FROM ({_LAST}) t WHERE contains(ip, '.0.') ORDER BY banned_us DESC, ip LIMIT 50 OFFSET 50")
def tk08(d):
    b = BA.active_bans_last(d.ban_records).where(c("ip").contains(".0."))
    return TR.page(b, [F.desc("banned_us"), "ip"], 50, 2).select("ip", "banned_us")


_ATTACKS = f"SELECT *, split_part(label, ':', 1) AS attack_type, {O.COUNTRY} AS country FROM (SELECT *, {O.PATTERN_LABEL} AS label FROM access_log) a WHERE label IS NOT NULL"


def attacks(d):
    a = d.access_log.withColumn("label", PT.first_attack_match()).where("label is not null")
    return (a.withColumn("attack_type", F.substring_index("label", ":", 1))
             .withColumn("country", IP.geo_struct(c("remote_addr"))["country"]))


@query("tk10_paged_attacks", f"SELECT event_id, attack_type FROM ({_ATTACKS}) t WHERE ts_us >= {CUT} AND attack_type = 'sql_injection' ORDER BY ts_us DESC, event_id DESC LIMIT 100")
def tk10(d):
    a = attacks(d).where((c("ts_us") >= CUT) & (c("attack_type") == "sql_injection"))
    return TR.page(a, [F.desc("ts_us"), F.desc("event_id")], 100).select("event_id", "attack_type")


@query("ag30_attacks_by_dimension", " UNION ALL ".join(
    f"SELECT '{g}' AS grouped_by, CAST({x} AS VARCHAR) AS key, count(*) AS n FROM ({_ATTACKS}) t WHERE ts_us BETWEEN {END} - 3600000000 AND {END} GROUP BY 2"
    for g, x in (("type", "attack_type"), ("ip", "remote_addr"), ("country", "country"), ("hour", "hour(make_timestamp(ts_us))"))))
def ag30(d):
    a, out = attacks(d), None
    for g in ("type", "ip", "country", "hour"):
        p = TR.attacks_by_dimension(a, END, "hour", g).select(F.lit(g).alias("grouped_by"), "key", "n")
        out = p if out is None else out.unionByName(p)
    return out


@query("ag34_platform_totals", f"SELECT count(*) AS total_requests, count({O.PATTERN_LABEL}) AS total_attacks, count(DISTINCT node_id) AS active_nodes, (SELECT count(DISTINCT ip) FROM ban_records) AS banned_ips FROM access_log")
def ag34(d):
    return TR.platform_totals(d.access_log, PT.first_attack_match().isNotNull(), d.ban_records)


# -- security events ---------------------------------------------------------------
_IND = "concat_ws(',', " + ", ".join(f"CASE WHEN {h} THEN '{k}' END" for k, h in O.THREATS.items()) + ")"


@query("f09_threat_patterns", "SELECT id, found AS indicators FROM sec_typed")
def f09(d):
    return d.security_input.select("id", F.array_join(PT.threat_indicators(
        c("request_path"), c("request_body")), ",").alias("indicators"))


def _typed(d):
    return d.security_input.withColumn("ind", PT.threat_indicators(c("request_path"), c("request_body"))) \
        .withColumn("event_type", PT.event_type(c("ind"), c("given_type"), c("response_status")))


@query("f10_event_type", "SELECT id, event_type FROM sec_typed")
def f10(d):
    return _typed(d).select("id", "event_type")


@query("f11_security_level", "SELECT id, base_level AS level FROM sec_typed")
def f11(d):
    return _typed(d).select("id", PT.security_level(c("ind"), c("response_status")).alias("level"))


@query("f12_compliance_tags", "SELECT id, tags FROM sec_events")
def f12(d):
    return _typed(d).select("id", F.array_join(PT.compliance_tags(c("event_type")), ",").alias("tags"))


@query("f13_threat_score", "SELECT id, threat_score FROM sec_events")
def f13(d):
    return sec_events(d).select("id", "threat_score")


@query("f14_build_security_event", "SELECT id, event_type, security_level, description, indicators, tags, threat_score FROM sec_events")
def f14(d):
    return sec_events(d).select("id", "event_type", "security_level", "description",
                                F.array_join("threat_indicators", ",").alias("indicators"),
                                F.array_join("compliance_tags", ",").alias("tags"), "threat_score")


@query("f15_search_events", f"SELECT id, event_type FROM sec_events WHERE ts_us BETWEEN {CUT} AND {END} AND event_type IN ('login_failure','unauthorized_access','sql_injection') AND security_level IN ('low','high') ORDER BY ts_us DESC, event_id DESC LIMIT 1000")
def f15(d):
    return AU.search_events(sec_events(d), CUT, END, ["login_failure", "unauthorized_access", "sql_injection"],
                            ["low", "high"]).select("id", "event_type")


@query("ag16_security_statistics", f"""
SELECT CASE WHEN grouping(event_type) = 0 THEN 'event_type' WHEN grouping(security_level) = 0 THEN 'security_level' WHEN grouping(node_id) = 0 THEN 'node_id' ELSE 'total' END AS dimension,
 coalesce(event_type, security_level, node_id, '') AS key, count(*) AS n FROM sec_events WHERE ts_us >= {CUT} GROUP BY GROUPING SETS ((event_type), (security_level), (node_id), ())""")
def ag16(d):
    return AU.security_statistics(sec_events(d), CUT)


@query("ag17_threat_score_stats", "SELECT round(avg(threat_score), 6) AS avg_threat_score, max(threat_score) AS max_threat_score, count(*) FILTER (WHERE threat_score >= 70) AS high_threat_events FROM sec_events")
def ag17(d):
    return AU.threat_statistics(sec_events(d)).withColumn("avg_threat_score", F.round("avg_threat_score", 6))


def _src(tag):
    return f"(SELECT * FROM sec_events WHERE ts_us BETWEEN {CUT - 400000000} AND {END} AND contains(tags, '{tag}')) t"


def _cnt(t):
    return f"count(*) FILTER (WHERE event_type = '{t}')"


@query("ag18_compliance_pci", f"""
SELECT count(*) AS total_events, {_cnt('login_failure')} AS failed_login_attempts, {_cnt('login_success')} AS successful_logins, {_cnt('unauthorized_access')} AS unauthorized_access_attempts,
 {_cnt('login_failure')} + {_cnt('login_success')} AS req_8_1_events, CASE WHEN {_cnt('login_failure')} < 100 THEN 'compliant' ELSE 'non_compliant' END AS req_8_1_status, 'compliant' AS req_10_2_status FROM {_src('pci_dss')}""")
def ag18(d):
    return AU.compliance_report(sec_events(d), "pci_dss", CUT - 400000000, END)


@query("ag18_compliance_events", f"SELECT id, event_type FROM {_src('pci_dss')}")
def ag18b(d):
    return AU.compliance_events(sec_events(d), "pci_dss", CUT - 400000000, END).select("id", "event_type")


@query("ag19_compliance_gdpr", f"""
SELECT count(*) AS total_events, {_cnt('data_exfiltration')} AS data_breach_incidents, {_cnt('unauthorized_access')} AS unauthorized_access_attempts, {_cnt('data_exfiltration')} > 0 AS required_within_72h FROM {_src('gdpr')}""")
def ag19(d):
    return AU.compliance_report(sec_events(d), "gdpr", CUT - 400000000, END)


@query("ag20_compliance_other", f"""
SELECT 'hipaa' AS standard, count(*) AS total_events, count(*) FILTER (WHERE contains(lower(description), 'phi')) AS phi_access_events FROM {_src('hipaa')}
UNION ALL SELECT 'iso27001', count(*), NULL FROM {_src('iso27001')}""")
def ag20(d):
    e = sec_events(d)
    a = AU.compliance_report(e, "hipaa", CUT - 400000000, END).withColumn("standard", F.lit("hipaa"))
    b = AU.compliance_report(e, "iso27001", CUT - 400000000, END).withColumn("standard", F.lit("iso27001"))
    return a.unionByName(b, allowMissingColumns=True)


@query("tk06_top_event_ips", f"SELECT source_ip, count(*) AS n FROM sec_events WHERE ts_us >= {CUT} GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def tk06(d):
    return AU.top_event_ips(sec_events(d), CUT)


@query("tk12_latest_security_events", "SELECT id FROM sec_events ORDER BY ts_us DESC, event_id DESC LIMIT 10")
def tk12(d):
    return AU.search_events(sec_events(d), limit=10).select("id")


# -- alerts --------------------------------------------------------------------------
@query("f17_active_alerts", "SELECT event_id FROM alerts WHERE NOT resolved AND severity = 'high'")
def f17(d):
    return AL.active_alerts(d.alerts, "high").select("event_id")


@query("f18_attack_alert", f"SELECT event_id, {O.lookup('attack_type', R.ATTACK_SEVERITY, chr(39) + 'medium' + chr(39))} AS severity, concat('检测到来自IP ', remote_addr, '的', attack_type, '攻击') AS description FROM ({_ATTACKS}) t")
def f18(d):
    return attacks(d).select("event_id", AL.attack_severity(c("attack_type")).alias("severity"),
                             F.format_string(R.ALERT_TEXT["attack_body"], "remote_addr", "attack_type").alias("description"))


@query("f19_health_alert", """
SELECT event_id, CASE WHEN cpu > 90 THEN 'high' WHEN mem > 95 THEN 'critical' END AS severity, CASE WHEN cpu > 90 THEN concat('系统CPU使用率达到', cpu, '%') WHEN mem > 95 THEN concat('系统内存使用率达到', mem, '%') END AS description
FROM (SELECT event_id, body_bytes_sent % 101 AS cpu, body_bytes_sent % 97 AS mem FROM access_log) t""")
def f19(d):
    a = AL.health_alert(c("body_bytes_sent") % 101, c("body_bytes_sent") % 97)
    return d.access_log.select("event_id", a["severity"].alias("severity"), a["description"].alias("description"))


@query("f20_alert_router", f"""
SELECT event_id, CASE WHEN body_bytes_sent > 200000 THEN 'threshold_exceeded' WHEN request_time > 15 THEN 'anomaly_detected' WHEN {O.PATTERN_LABEL} IS NOT NULL THEN 'attack_detected' WHEN body_bytes_sent % 101 > 90 THEN 'system_health' END AS type FROM access_log""")
def f20(d):
    lab = lambda cond, t: F.when(cond, F.lit(t))
    t = AL.route(lab(c("body_bytes_sent") > 200000, "threshold_exceeded"), lab(c("request_time") > 15, "anomaly_detected"),
                 lab(PT.first_attack_match().isNotNull(), "attack_detected"),
                 AL.health_alert(c("body_bytes_sent") % 101, F.lit(0))["type"])
    return d.access_log.select("event_id", t.alias("type"))


@query("f21_severity_by_ratio", "SELECT event_id, CASE WHEN value/50 >= 2 THEN 'critical' WHEN value/50 >= 1.5 THEN 'high' WHEN value/50 >= 1.2 THEN 'medium' ELSE 'low' END AS severity FROM metrics")
def f21(d):
    return d.metrics.select("event_id", AL.ratio_severity(c("value"), F.lit(50.0)).alias("severity"))


@query("f23_system_event_level", "SELECT event_id, CASE WHEN event_type LIKE '%error%' THEN 'error' WHEN event_type = 'click' THEN 'warning' ELSE 'info' END AS level FROM access_log")
def f23(d):
    t = F.when(c("event_type") == "click", "Disk_WARN").otherwise(c("event_type"))
    return d.access_log.select("event_id", TX.system_event_level(t).alias("level"))


@query("f24_build_alert", """
SELECT event_id, concat(type, '_', ts_us // 1000000, CASE WHEN seq > 1 THEN concat('_', seq) ELSE '' END) AS id, resolved FROM (
 SELECT event_id, ts_us, type, false AS resolved, row_number() OVER (PARTITION BY type, ts_us // 1000000 ORDER BY ts_us, event_id) AS seq FROM alerts) t""")
def f24(d):
    return AL.build_alerts(d.alerts, c("type"), c("severity"), F.lit("t"), F.lit("d")).select("event_id", "id", "resolved")


@query("j13_threshold_lookup", "SELECT event_id, value > CASE name WHEN 'view' THEN 20 ELSE 60 END AS exceeded FROM metrics WHERE name IN ('view', 'error')")
def j13(d):
    t = d.spark.sql("SELECT * FROM VALUES ('view', 20.0D), ('error', 60.0D) AS t(name, threshold)")
    return AL.threshold_lookup(d.metrics, t).select("event_id", (c("value") > c("threshold")).alias("exceeded"))


@query("j15_resolve_alert", "SELECT event_id, resolved OR event_id % 6 = 1 AS resolved, CASE WHEN event_id % 6 = 1 THEN ts_us + 5000000 END AS resolved_us FROM alerts")
def j15(d):
    a = d.alerts.withColumn("id", c("event_id"))
    res = a.where("event_id % 6 = 1").select("id", (c("ts_us") + 5000000).alias("resolved_us"), F.lit("ok").alias("notes"))
    return AL.resolve(a, res).select("event_id", "resolved", "resolved_us")


@query("ag21_alert_statistics", """
SELECT 'total' AS dimension, '' AS key, count(*) AS n FROM alerts UNION ALL SELECT 'severity', severity, count(*) FROM alerts GROUP BY 2
UNION ALL SELECT 'type', type, count(*) FROM alerts GROUP BY 2 UNION ALL SELECT 'active', '', count(*) FROM alerts WHERE NOT resolved""")
def ag21(d):
    return AL.alert_statistics(d.alerts)


@query("ag22_resolution_time", "SELECT round(avg(resolved_us - ts_us)/1000000, 6) AS resolution_time_avg FROM alerts WHERE resolved")
def ag22(d):
    return AL.resolution_time(d.alerts).select(F.round("resolution_time_avg", 6).alias("resolution_time_avg"))


# -- performance ------------------------------------------------------------------------
def _r(df, *cols):
    return df.select(*[F.round(x, 6).alias(x) if t == "double" else c(x) for x, t in df.dtypes if not cols or x in cols])


@query("ag11_metric_summary", f"""
SELECT name, count(value) AS count, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, round(stddev_pop(value), 6) AS std,
 round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM metrics WHERE ts_us >= {CUT} GROUP BY name""")
def ag11(d):
    return _r(PE.metric_summary(d.metrics, END))


_EP = "SELECT *, request_method || ':' || split_part(request_uri, '?', 1) AS endpoint FROM access_log"
_EPS = f"""SELECT endpoint, count(*) AS total_requests, count(*) FILTER (WHERE status >= 400) AS error_count, count(*) FILTER (WHERE status >= 400)/CAST(count(*) AS DOUBLE) AS error_rate,
 avg(request_time) AS avg_response_time, quantile_cont(request_time, 0.95) AS p95_response_time, quantile_cont(request_time, 0.99) AS p99_response_time FROM ({_EP}) t GROUP BY 1"""


def endpoints(d):
    return PE.endpoint_summary(d.access_log.withColumn("request_path", F.substring_index("request_uri", "?", 1)))


@query("ag12_endpoint_summary", f"SELECT endpoint, total_requests, error_count, round(error_rate, 6) AS error_rate, round(avg_response_time, 6) AS avg_response_time, round(p95_response_time, 6) AS p95_response_time, round(p99_response_time, 6) AS p99_response_time FROM ({_EPS}) t")
def ag12(d):
    return _r(endpoints(d).drop("request_method", "request_path"))


_RES = "SELECT name, avg(value) AS average FROM (SELECT * FROM metrics QUALIFY row_number() OVER (PARTITION BY name ORDER BY ts_us DESC, event_id DESC) <= 100) t GROUP BY 1"


@query("ag13_resource_average", f"SELECT name, round(average, 6) AS average FROM ({_RES}) t")
def ag13(d):
    return _r(PE.resource_average(d.metrics))


@query("ag14_trace_statistics", f"""
SELECT operation, count(*) AS count, count(*) FILTER (WHERE status = 'error') AS error_count, round(avg(duration), 6) AS avg_duration, min(duration) AS min_duration, max(duration) AS max_duration,
 round(quantile_cont(duration, 0.5), 6) AS p50_duration, round(quantile_cont(duration, 0.95), 6) AS p95_duration, round(quantile_cont(duration, 0.99), 6) AS p99_duration,
 round(count(*) FILTER (WHERE status = 'error')/CAST(count(*) AS DOUBLE), 6) AS error_rate
FROM (SELECT *, unnest([operation_name, '*']) AS operation FROM spans WHERE duration IS NOT NULL AND start_us >= {END} - 3600000000) t GROUP BY 1""")
def ag14(d):
    return _r(PE.trace_statistics(d.spans, END))


@query("ag15_perf_alerts", f"""
SELECT 'performance_degradation' AS type, endpoint AS subject, round(p95_response_time, 6) AS value FROM ({_EPS}) t WHERE p95_response_time > 20
UNION ALL SELECT 'high_error_rate', endpoint, round(error_rate, 6) FROM ({_EPS}) t WHERE error_rate > 0.05
UNION ALL SELECT 'high_cpu_usage', 'cpu_usage', round(average, 6) FROM ({_RES.replace('FROM metrics', "FROM (SELECT * REPLACE (CASE name WHEN 'view' THEN 'cpu_usage' ELSE name END AS name) FROM metrics) m")}) t WHERE name = 'cpu_usage' AND average > 10""")
def ag15(d):
    m = d.metrics.withColumn("name", F.when(c("name") == "view", "cpu_usage").otherwise(c("name")))
    a = PE.performance_alerts(endpoints(d), PE.resource_average(m), {"response_time_p95": 20, "cpu_usage": 10})
    return a.select("type", "subject", F.round("value", 6).alias("value"))


@query("ag31_health_score", """
SELECT node_id, CAST(100 - 20*stopped - CASE WHEN disk > 95 THEN 30 WHEN disk > 90 THEN 10 ELSE 0 END - CASE WHEN mem > 90 THEN 20 WHEN mem > 80 THEN 10 ELSE 0 END - CASE WHEN err > 10 THEN 15 ELSE 0 END AS BIGINT) AS health_score
FROM (SELECT node_id, count(DISTINCT status) FILTER (WHERE status = 500) AS stopped, max(value)/5 AS disk, max(value)/5.5 AS mem, count(*) FILTER (WHERE status = 500) AS err
 FROM (SELECT node_id, status, request_time * 10 AS value FROM access_log) x GROUP BY 1) t""")
def ag31(d):
    v = F.max(c("request_time") * 10)
    n = d.access_log.groupBy("node_id").agg(F.countDistinct(F.when(c("status") == 500, c("status"))).alias("stopped_services"),
                                            (v / 5).alias("disk_pct"), (v / 5.5).alias("mem_pct"),
                                            F.count_if(c("status") == 500).alias("errors_last_hour"))
    return PE.health_score(n).select("node_id", "health_score")


@query("ag26_source_statistics", """
SELECT node_id AS source, count(*) FILTER (WHERE request_method = 'GET' AND status < 400) AS logs_read, count(*) FILTER (WHERE request_method <> 'GET' AND status < 400) AS logs_written,
 count(*) FILTER (WHERE status >= 400) AS error_count, bool_or(status < 400) AS connected FROM access_log GROUP BY 1""")
def ag26(d):
    return PE.source_statistics(d.access_log.select(
        c("node_id").alias("source"), F.when(c("request_method") == "GET", "read").otherwise("write").alias("op"),
        (c("status") < 400).alias("ok")))


@query("ag27_agent_counters", """
SELECT node_id, count(*) AS processed, count(*) FILTER (WHERE status < 500) AS sent, count(*) FILTER (WHERE status >= 500) AS failed, CAST(sum(body_bytes_sent) AS BIGINT) AS bytes, count(*) FILTER (WHERE status >= 400) AS errors FROM access_log GROUP BY 1""")
def ag27(d):
    one = lambda cond: F.when(cond, 1).otherwise(0).cast("bigint")
    return PE.agent_counters(d.access_log.select(
        "node_id", F.lit(1).alias("processed"), one(c("status") < 500).alias("sent"), one(c("status") >= 500).alias("failed"),
        c("body_bytes_sent").alias("bytes"), one(c("status") >= 400).alias("errors")))


@query("j11_trace_lookup", "SELECT span_id, start_us FROM spans WHERE trace_id = '42'")
def j11(d):
    s = d.spans
    return PE.trace(s.where("duration is not null"), s.where("duration is null"), "42").select("span_id", "start_us")


@query("so04_span_union", "SELECT trace_id, count(*) AS n FROM spans GROUP BY 1")
def so04(d):
    s = d.spans
    return s.where("duration is null").unionByName(s.where("duration is not null")).groupBy("trace_id").agg(N("*").alias("n"))


# -- tenancy -----------------------------------------------------------------------------
_ROLE = "CASE role " + " ".join(f"WHEN '{r}' THEN [{', '.join(O.lit(p) for p in ps)}]" for r, ps in R.ROLE_PERMISSIONS.items()) + " ELSE [] END"
_PERM = f"SELECT user_id, CASE WHEN is_active THEN list_sort(list_distinct(list_concat({_ROLE}, CASE WHEN extra_permission IS NULL THEN [] ELSE [extra_permission] END))) ELSE [] END AS p FROM users"


def _perms():
    direct = F.array_compact(F.array(c("extra_permission")))
    return TE.effective_permissions(c("role"), direct, c("is_active"))


@query("j06_user_permissions", f"SELECT user_id, array_to_string(p, ',') AS permissions, list_has_any(p, ['ip:ban', 'log:export']) AS any_of, list_has_all(p, ['ip:ban', 'log:export']) AS all_of FROM ({_PERM}) t")
def j06(d):
    u = d.users.withColumn("p", _perms())
    w = ["ip:ban", "log:export"]
    return u.select("user_id", F.array_join(F.array_sort("p"), ",").alias("permissions"),
                    TE.has_any(c("p"), w).alias("any_of"), TE.has_all(c("p"), w).alias("all_of"))


@query("so03_permission_union", f"SELECT user_id, CAST(len(p) AS BIGINT) AS n FROM ({_PERM}) t")
def so03(d):
    return d.users.select("user_id", F.size(_perms()).cast("bigint").alias("n"))


@query("j07_tenant_scope", """
SELECT m.user_id, m.tenant_id, m.role, (SELECT count(*) FROM users t WHERE m.role = 'super_admin' OR (t.tenant_id = m.tenant_id AND t.role <> 'super_admin')) AS manageable
FROM users m WHERE m.role IN ('super_admin', 'tenant_admin')""")
def j07(d):
    return TE.manageable_counts(d.users)


_SESS = 883612800000000  # 1998-01-01


@query("j08_session_lookup", f"""
SELECT token, u.username, t.name AS tenant_name FROM sessions s JOIN users u USING (user_id) JOIN tenants t ON t.tenant_id = u.tenant_id WHERE s.is_active AND u.is_active AND s.expires_us >= {_SESS}""")
def j08(d):
    return TE.valid_sessions(d.sessions, d.users, d.tenants, _SESS).select("token", "username", "tenant_name")


@query("st09_session_expiry", f"SELECT session_id FROM sessions WHERE expires_us >= {_SESS} AND is_active")
def st09(d):
    return TE.session_cleanup(d.sessions, _SESS).select("session_id")


_USAGE = f"""SELECT t.tenant_id, t.max_users, t.max_concurrent_sessions, count(DISTINCT u.user_id) AS users, count(DISTINCT u.user_id) FILTER (WHERE u.is_active) AS active_users,
 count(DISTINCT s.session_id) AS sessions FROM tenants t LEFT JOIN users u ON u.tenant_id = t.tenant_id LEFT JOIN sessions s ON s.user_id = u.user_id AND s.is_active AND s.expires_us >= {_SESS} GROUP BY ALL"""


def usage(d):
    return TE.tenant_usage(d.users, d.sessions, None, _SESS)


@query("j09_quota_join", f"SELECT tenant_id, users, active_users, sessions AS concurrent_sessions FROM ({_USAGE}) t WHERE users > 0")
def j09(d):
    return usage(d).select("tenant_id", "users", "active_users", "concurrent_sessions")


@query("ag25_tenant_statistics", f"""
SELECT tenant_id, resource, cur AS current, lim AS limit, round(CASE WHEN lim > 0 THEN cur/CAST(lim AS DOUBLE)*100 ELSE 0 END, 6) AS usage_percent, greatest(0, lim - cur) AS available FROM (
 SELECT tenant_id, 'users' AS resource, users AS cur, max_users AS lim FROM ({_USAGE}) a UNION ALL SELECT tenant_id, 'concurrent_sessions', sessions, max_concurrent_sessions FROM ({_USAGE}) b
 UNION ALL SELECT tenant_id, r, 0, l FROM tenants, (VALUES ('banned_ips', 1000), ('rules', 100), ('api_requests_per_hour', 10000), ('storage_mb', 1000)) v(r, l)) t""")
def ag25(d):
    return _r(TE.quota_status(d.tenants, usage(d)))


@query("ag25_check_quota", f"SELECT tenant_id, users + 5 <= max_users AS allowed FROM ({_USAGE}) t")
def ag25b(d):
    return TE.check_quota(TE.quota_status(d.tenants, usage(d)), "users", 5)


@query("j14_tenant_cascade", """
SELECT session_id FROM sessions WHERE user_id NOT IN (SELECT user_id FROM users WHERE tenant_id % 3 = 0)""")
def j14(d):
    gone = d.tenants.where("tenant_id % 3 = 0")
    return TE.delete_tenants(gone, d.tenants, d.users, d.sessions)[2].select("session_id")


@query("tk11_tenant_lists", "SELECT tenant_id, name FROM tenants WHERE status = 'active'")
def tk11(d):
    return TE.tenant_list(d.tenants, "active").select("tenant_id", "name")


# -- notifications -------------------------------------------------------------------------
_ROUTES = " UNION ALL ".join(f"SELECT '{k}' AS level, '{ch}' AS channel" for k, v in R.NOTIFICATION_ROUTES.items() for ch in v if ch != "wechat")


@query("j10_notification_routing", f"SELECT event_id, level, channel FROM notifications JOIN ({_ROUTES}) r USING (level)")
def j10(d):
    return NO.route_notifications(d.notifications, ["email", "dingtalk"]).select("event_id", "level", "channel")


# -- set operations --------------------------------------------------------------------------
@query("so01_source_concat", f"""
SELECT kind, count(*) AS n FROM (SELECT 'web' AS kind FROM clf_log UNION ALL SELECT 'api' FROM json_log WHERE event_id % 53 <> 0) t GROUP BY 1""")
def so01(d):
    both = PA.parse_combined_entry(d.clf_log, "web").unionByName(PA.parse_json_entry(d.json_log, "api"))
    return both.groupBy(c("source").alias("kind")).agg(N("*").alias("n"))
