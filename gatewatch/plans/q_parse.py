"""Parsing, text and row-level classifier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..functions import features as FE
from ..functions import ip as IP
from ..functions import parse as PA
from ..functions import patterns as PT
from ..functions import redact as RE
from ..functions import text as TX
from . import oracle_views as O
from .registry import query

AS_OF_US = 1704067920000000  # end of the squeezed 12 minutes
us = F.unix_micros

_G = r"^(\S+) - (\S+) \[([^\]]+)\] \"([^\"]+)\" (\d+) (\d+)".replace('\\"', '"')
_Q = ' "([^"]+)" "([^"]+)"'


def _ex(i, pat=None):
    return f"regexp_extract(value, '{pat or _G}', {i})"


_REQ = _ex(4)
_COMMON_SQL = f"""
SELECT event_id, {_ex(1)} AS remote_addr, nullif({_ex(2)}, '-') AS remote_user,
  epoch_us(strptime(replace({_ex(3)}, ' +0000', ''), '%d/%b/%Y:%H:%M:%S')) AS ts_us,
  split_part({_REQ}, ' ', 1) AS request_method, split_part({_REQ}, ' ', 2) AS request_uri,
  split_part({_REQ}, ' ', 3) AS request_protocol,
  CAST({_ex(5)} AS BIGINT) AS status, CAST({_ex(6)} AS BIGINT) AS body_bytes_sent"""


def _common(df, *more):
    return df.select("event_id", "remote_addr", "remote_user", us("timestamp").alias("ts_us"),
                     "request_method", "request_uri", "request_protocol", "status", "body_bytes_sent",
                     *more)


@query("p01_parse_combined", f"""{_COMMON_SQL},
  nullif({_ex(7, _G + _Q)}, '-') AS http_referer, {_ex(8, _G + _Q)} AS http_user_agent
FROM raw_log WHERE regexp_matches(value, '{_G + _Q}')""")
def p01(d):
    return _common(PA.parse_access(d.raw_log, "combined", keep=["event_id"]),
                   "http_referer", "http_user_agent")


@query("p02_parse_common", f"{_COMMON_SQL} FROM raw_log WHERE regexp_matches(value, '{_G}')")
def p02(d):
    return _common(PA.parse_access(d.raw_log, "common", keep=["event_id"]))


_T = _G + _Q + r" (\S+) (\S+)"
_T2 = _T.replace("([^", "(?:[^").replace(r"(\d+)", r"(?:\d+)")  # the check engine has nine groups


@query("p03_parse_timed", f"""{_COMMON_SQL}, try_cast({_ex(3, _T2)} AS DOUBLE) AS request_time,
  try_cast({_ex(4, _T2)} AS DOUBLE) AS upstream_response_time
FROM timed_log WHERE regexp_matches(value, '{_T}')""")
def p03(d):
    return _common(PA.parse_access(d.timed_log, "custom", keep=["event_id"]),
                   "request_time", "upstream_response_time")


@query("p04_parse_user_regex", r"""
SELECT event_id, regexp_extract(value, '^(\S+) \S+ (\S+) .*?" (\d{3}) ', 1) AS remote_addr,
  nullif(regexp_extract(value, '^(\S+) \S+ (\S+) .*?" (\d{3}) ', 2), '-') AS remote_user,
  CAST(regexp_extract(value, '^(\S+) \S+ (\S+) .*?" (\d{3}) ', 3) AS BIGINT) AS status
FROM raw_log WHERE regexp_matches(value, '^(\S+) \S+ (\S+) .*?" (\d{3}) ')""")
def p04(d):
    return PA.parse_access(d.raw_log, r'(?P<remote_addr>\S+) \S+ (?P<remote_user>\S+) .*?" (?P<status>\d{3}) ',
                           keep=["event_id"])


@query("p05_log_timestamp", r"""
SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE
  epoch_us(strptime(split_part(regexp_extract(value, '\[([^\]]+)\]', 1), ' ', 1), '%d/%b/%Y:%H:%M:%S'))
   - CASE event_id % 4 WHEN 1 THEN 28800000000 ELSE 0 END END AS ts_us FROM raw_log""")
def p05(d):
    t = F.regexp_extract("value", r"\[([^\]]+)\]", 1)
    head, k = F.split(t, " ")[0], F.col("event_id") % 4
    text = (F.when(k == 0, head).when(k == 1, F.concat(head, F.lit(" +08:00"))).when(k == 2, t)
             .otherwise(F.concat(F.lit("x"), head)))
    return d.raw_log.select("event_id", us(PA.log_timestamp(text)).alias("ts_us"))


@query("p06_split_request", """
SELECT event_id, request_method, split_part(request_uri, ' ', 1) AS request_uri,
  CASE WHEN contains(request_uri, ' ') THEN concat(substr(request_uri, instr(request_uri, ' ') + 1), ' HTTP/1.1') ELSE 'HTTP/1.1' END AS request_protocol
FROM access_log""")
def p06(d):
    raw = d.access_log.select("event_id", F.concat_ws(" ", "request_method", "request_uri",
                                                      F.lit("HTTP/1.1")).alias("request"))
    return PA.split_request(raw).select("event_id", "request_method", "request_uri", "request_protocol")


@query("p07_split_uri", r"""
SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS request_path,
  regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS request_query, regexp_extract(url, '#(.*)$', 1) AS request_fragment FROM pages""")
def p07(d):
    return PA.split_uri(d.pages.select("page_id", F.col("url").alias("request_uri"))).drop("request_uri")


@query("p08_coerce_fields", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE status END AS status,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'bob' END AS remote_user,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE CAST(0.5 AS DOUBLE) END AS request_time FROM access_log""")
def p08(d):
    e = F.col("event_id")
    raw = d.access_log.select(
        "event_id", F.when(e % 3 == 0, "x").otherwise(F.col("status").cast("string")).alias("status"),
        F.when(e % 4 == 0, "-").otherwise("bob").alias("remote_user"),
        F.when(e % 5 == 0, "-").when(e % 5 == 1, "n/a").otherwise("0.5").alias("request_time"))
    return PA.post_process(raw)


_C = r'^(\S+) - - \[([^\]]+)\] "(\S+) (\S+) (\S+)" (\d+) (\d+|-)'
_CQ = _C + ' "([^"]*)" "([^"]*)"'


def _clf_sql(pat):
    return f"""
SELECT event_id, epoch_us(strptime(replace({_ex(2, pat)}, ' +0000', ''), '%d/%b/%Y:%H:%M:%S')) AS ts_us, 'INFO' AS level,
  {_ex(1, pat)} AS ip_address, {_ex(3, pat)} AS request_method, {_ex(4, pat)} AS request_url,
  CAST({_ex(6, pat)} AS BIGINT) AS response_status, CAST(nullif({_ex(7, pat)}, '-') AS BIGINT) AS response_size"""


def _entry(df, *more):
    return df.select("event_id", us("timestamp").alias("ts_us"), "level", "ip_address",
                     "request_method", "request_url", "response_status", "response_size", *more)


@query("p09_parse_clf_generic", f"{_clf_sql(_C)} FROM clf_log WHERE regexp_matches(value, '{_C}')")
def p09(d):
    return _entry(PA.parse_clf_entry(d.clf_log, "web", keep=["event_id"]))


@query("p10_parse_combined_generic", f"""{_clf_sql(_CQ)}, {_ex(8, _CQ)} AS referer, {_ex(9, _CQ)} AS user_agent
FROM clf_log WHERE regexp_matches(value, '{_CQ}')""")
def p10(d):
    return _entry(PA.parse_combined_entry(d.clf_log, "web", keep=["event_id"]),
                  F.col("extra_fields")["referer"].alias("referer"), "user_agent")


@query("p11_parse_json_log", r"""
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE
   epoch_us(CAST(replace(coalesce(json_extract_string(value, '$.timestamp'), json_extract_string(value, '$.time'), json_extract_string(value, '$."@timestamp"')), 'Z', '') AS TIMESTAMP)) END AS ts_us,
  coalesce(json_extract_string(value, '$.level'), 'INFO') AS level,
  coalesce(json_extract_string(value, '$.ip'), json_extract_string(value, '$.remote_addr')) AS ip_address,
  json_extract_string(value, '$.method') AS request_method,
  coalesce(json_extract_string(value, '$.url'), json_extract_string(value, '$.path')) AS request_url,
  CAST(json_extract_string(value, '$.status') AS BIGINT) AS response_status, CAST(json_extract_string(value, '$.size') AS BIGINT) AS response_size,
  json_extract_string(value, '$.node') AS node, json_extract_string(value, '$.other') AS other
FROM json_log WHERE event_id % 53 <> 0""")
def p11(d):
    x = F.col("extra_fields")
    return _entry(PA.parse_json_entry(d.json_log, "api", keep=["event_id"]),
                  x["node"].alias("node"), x["other"].alias("other"))


@query("p12_parse_custom_pattern", r"""
SELECT event_id, regexp_extract(value, '^(\S+) - - \[[^\]]+\] "(\S+) (\S+) [^"]*" (\d+)', 1) AS ip_address,
  regexp_extract(value, '^(\S+) - - \[[^\]]+\] "(\S+) (\S+) [^"]*" (\d+)', 2) AS request_method,
  regexp_extract(value, '^(\S+) - - \[[^\]]+\] "(\S+) (\S+) [^"]*" (\d+)', 3) AS request_url,
  CAST(regexp_extract(value, '^(\S+) - - \[[^\]]+\] "(\S+) (\S+) [^"]*" (\d+)', 4) AS BIGINT) AS response_status,
  CAST(4 AS BIGINT) AS n_extra FROM clf_log""")
def p12(d):
    pat = r'(?P<ip>\S+) - - \[[^\]]+\] "(?P<method>\S+) (?P<url>\S+) [^"]*" (?P<status>\d+)'
    return PA.parse_custom_entry(d.clf_log, "app", pat, keep=["event_id"]).select(
        "event_id", "ip_address", "request_method", "request_url", "response_status",
        F.size("extra_fields").cast("bigint").alias("n_extra"))


def sys_events(d):
    e = TX.parse_system_log(d.system_log, F.timestamp_micros(F.lit(AS_OF_US)), keep=["event_id"])
    return e.withColumn("ts_us", us("timestamp"))


@query("p13_parse_system_log", """
SELECT event_id, ts_us, event_type, level, ip_address, message, structured FROM sys_events""")
def p13(d):
    return sys_events(d).select("event_id", "ts_us", "event_type", "level", "ip_address", "message",
                                "structured")


@query("p14_ban_reason", f"SELECT event_id, {O.BAN_REASON} AS reason FROM sys_events WHERE event_type = 'ip_banned'")
def p14(d):
    return sys_events(d).where("event_type = 'ip_banned'").select(
        "event_id", TX.ban_reason(F.col("message")).alias("reason"))


@query("p15_attack_type_label", f"SELECT event_id, {O.ATTACK_TYPE} AS attack_type FROM sys_events")
def p15(d):
    return sys_events(d).select("event_id", TX.attack_type_label(F.col("message")).alias("attack_type"))


@query("p16_attack_severity", f"SELECT event_id, {O.SEVERITY} AS severity FROM sys_events")
def p16(d):
    return sys_events(d).select("event_id", TX.attack_severity(F.col("message"), F.col("level")).alias("severity"))


@query("p17_pseudonymise_ip", """
SELECT remote_addr, substr(md5(remote_addr), 1, 16) AS short_md5, substr(sha256(concat('pepper:', remote_addr)), 1, 16) AS short_sha
FROM access_log GROUP BY remote_addr""")
def p17(d):
    ip = F.col("remote_addr")
    return d.access_log.select("remote_addr").distinct().select(
        "remote_addr", IP.pseudonym_md5(ip).alias("short_md5"),
        IP.pseudonym_sha(ip, "pepper").alias("short_sha"))


@query("p18_redact_fields", """
SELECT doc_id, '[REDACTED]' AS api_token, CASE WHEN length(text) > 1000 THEN concat(substr(text, 1, 1000), '[TRUNCATED]') ELSE text END AS body,
  lang AS lang, '[REDACTED]' AS nested_secret, CASE WHEN length(text) > 1000 THEN concat(substr(text, 1, 1000), '[TRUNCATED]') ELSE text END AS nested_body
FROM documents""")
def p18(d):
    doc = d.documents
    flat = F.create_map(F.lit("Api_Token"), F.col("source"), F.lit("body"), F.col("text"),
                        F.lit("lang"), F.col("lang"))
    nested = RE.redact_json(F.to_json(F.struct(F.struct(
        F.col("source").alias("client_secret"), F.array("text").alias("parts")).alias("outer"))))
    m = RE.redact_map(flat)
    return doc.select("doc_id", m["Api_Token"].alias("api_token"), m["body"].alias("body"),
                      m["lang"].alias("lang"),
                      F.get_json_object(nested, "$.outer.client_secret").alias("nested_secret"),
                      F.get_json_object(nested, "$.outer.parts[0]").alias("nested_body"))


@query("p19_ip_class", """
SELECT remote_addr, CASE WHEN remote_addr LIKE '10.%' OR remote_addr LIKE '192.168.%' OR remote_addr LIKE '203.0.113.%' THEN 'private' ELSE 'public' END AS ip_class
FROM access_log GROUP BY remote_addr""")
def p19(d):
    return d.access_log.select("remote_addr").distinct().select(
        "remote_addr", IP.ip_class(F.col("remote_addr")).alias("ip_class"))


@query("p20_geo_lookup", f"SELECT remote_addr, {O.COUNTRY} AS country, {O.RISK_LEVEL} AS risk_level FROM access_log GROUP BY remote_addr")
def p20(d):
    g = IP.geo_struct(F.col("remote_addr"))
    return d.access_log.select("remote_addr").distinct().select(
        "remote_addr", g["country"].alias("country"), g["risk_level"].alias("risk_level"))


@query("p21_hour_bucket", """
SELECT strftime(o_orderdate, '%Y-%m-%d %H:00') AS hour_key, count(*) AS n FROM orders GROUP BY 1""")
def p21(d):
    return d.orders.groupBy(TX.hour_bucket(F.col("o_orderdate").cast("timestamp")).alias("hour_key")).agg(
        F.count("*").alias("n"))


_ISO = """CASE WHEN ts_us % 1000000 = 0 THEN strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S') ELSE strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f') END"""
_SUM = f"""sha256(concat('{{"description": "', description, '", "event_type": "', event_type, '", "id": "', id,
  '", "source_ip": "', source_ip, '", "timestamp": "', {_ISO}, '"}}'))"""


@query("p22_event_checksum", f"SELECT id, {_SUM} AS checksum FROM sec_events")
def p22(d):
    from ..operators.audit import security_events
    return security_events(d.security_input, d.malicious_ips).select("id", "checksum")


@query("p23_verify_integrity", "SELECT id, event_id % 19 <> 0 AS intact FROM sec_events")
def p23(d):
    from ..operators.audit import security_events, verify_integrity
    e = security_events(d.security_input, d.malicious_ips)
    broken = e.withColumn("description", F.when(F.col("event_id") % 19 == 0, F.concat(
        "description", F.lit("!"))).otherwise(F.col("description")))
    return broken.select("id", verify_integrity().alias("intact"))


@query("p24_request_fingerprint", """
SELECT md5(concat(request_uri, ':', http_user_agent, ':', request_method)) AS fingerprint, count(*) AS n FROM access_log GROUP BY 1""")
def p24(d):
    return d.access_log.groupBy(PT.request_fingerprint(
        F.col("request_uri"), F.col("http_user_agent"), F.col("request_method")).alias("fingerprint")).agg(
        F.count("*").alias("n"))


@query("p25_format_duration", """
SELECT event_id, CASE WHEN s < 60 THEN concat(s, '秒') WHEN s < 3600 THEN concat(s//60, '分钟') WHEN s < 86400 THEN concat(s//3600, '小时') ELSE concat(s//86400, '天') END AS short_text,
  CASE WHEN s >= 1440 THEN concat(s//1440, '天', (s%1440)//60, '小时') WHEN s >= 60 THEN concat(s//60, '小时', s%60, '分钟') ELSE concat(s, '分钟') END AS ban_text
FROM (SELECT event_id, body_bytes_sent AS s FROM access_log) t""")
def p25(d):
    s = F.col("body_bytes_sent")
    return d.access_log.select("event_id", TX.format_duration(s).alias("short_text"),
                               TX.format_ban_minutes(s).alias("ban_text"))


_WHERE = "'服务器: Unknown', '节点ID: ' || node_id, '地区: Unknown', ''"


@query("p26_notification_text", f"""
SELECT event_id, concat('IP封禁通知 - ', ip) AS ban_title,
  concat_ws(chr(10), 'IP地址: ' || ip, '封禁原因: ' || reason, '封禁时长: ' || CASE WHEN duration_s < 60 THEN concat(duration_s, '秒') ELSE concat(duration_s//60, '分钟') END, {_WHERE}, '请注意监控该IP的后续行为。') AS ban_body,
  concat_ws(chr(10), 'IP地址: ' || ip, '解封原因: ' || reason, {_WHERE}, 'IP已从封禁列表中移除。') AS unban_body,
  concat('攻击检测 - ', reason) AS attack_title,
  concat_ws(chr(10), '事件类型: ' || reason, '服务器: Unknown', '节点ID: ' || node_id, '事件时间: Unknown', '', '详细信息:', '无详细信息') AS system_body
FROM ban_records""")
def p26(d):
    c = F.col
    b = {"ip": c("ip"), "reason": c("reason"), "duration": c("duration_s"), "node_id": c("node_id")}
    ban, unban = TX.notification_text("ban", b), TX.notification_text("unban", b)
    att = TX.notification_text("attack", {"ip": c("ip"), "type": c("reason")})
    sysn = TX.notification_text("system", {"event_type": c("reason"), "node_id": c("node_id")})
    return d.ban_records.select("event_id", ban[0].alias("ban_title"), ban[1].alias("ban_body"),
                                unban[1].alias("unban_body"), att[0].alias("attack_title"),
                                sysn[1].alias("system_body"))


@query("p28_threshold_excess", """
SELECT event_id, value > 100 AS threshold_exceeded, round((value - 100) / 100 * 100, 2) AS threshold_exceeded_percentage,
  CASE WHEN value > 100 THEN 'WARNING' ELSE 'INFO' END AS level FROM metrics""")
def p28(d):
    cols = TX.threshold_excess(F.col("value"), F.lit(100.0))
    return d.metrics.select("event_id", *[v.alias(k) for k, v in cols.items()])


@query("p29_percent_decode", """
SELECT event_id, lower(replace(request_uri, '%20', ' ')) || ' ' || CASE WHEN event_id % 3 = 0 THEN 'a+b 50% é /' ELSE '' END AS decoded FROM access_log""")
def p29(d):
    rows = d.access_log.withColumn("body", F.when(
        F.col("event_id") % 3 == 0, F.lit("A+B 50% %C3%A9 %2F")))
    return FE.decoded_text(rows, "request_uri", F.col("body"), "decoded").select("event_id", "decoded")


@query("p30_structured_message", """
SELECT event_id, concat('[ip_banned] IP ', ip, ' has been banned for ', CASE WHEN duration_s >= 60 THEN concat(duration_s//60, '小时', duration_s%60, '分钟') ELSE concat(duration_s, '分钟') END, ': ', reason,
   ' | ip=', ip, ', reason=', reason, ', duration_minutes=', duration_s, ', node_id=', node_id) AS message,
  row_number() OVER (PARTITION BY reason ORDER BY ts_us, event_id) AS event_count,
  CASE event_id % 4 WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'ERROR' ELSE 'CRITICAL' END AS attack_level,
  concat(CASE event_id % 4 WHEN 0 THEN '🟡' WHEN 1 THEN '🟠' WHEN 2 THEN '🔴' ELSE '🚨' END, ' Attack detected from IP ', ip, ': xss (severity: ', CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END, ')') AS attack_text,
  concat('IP ', ip, ' has been unbanned: ', reason) AS unban_text,
  concat('❌ System event: restart (error) in ', node_id) AS system_text
FROM ban_records""")
def p30(d):
    from ..operators.prefix import row_numbers
    c = F.col
    b = row_numbers(d.ban_records, ["reason"], "ts_us", "event_id", "event_count", slice_us=60_000_000)
    sev = F.element_at(F.array(*[F.lit(s) for s in R.SEVERITIES]), (c("event_id") % 4 + 1).cast("int"))
    fields = F.create_map(F.lit("ip"), c("ip"), F.lit("reason"), c("reason"), F.lit("duration_minutes"),
                          c("duration_s").cast("string"), F.lit("node_id"), c("node_id"))
    return b.select(
        "event_id", TX.structured_message(F.lit("ip_banned"), TX.ban_message(
            c("ip"), c("duration_s"), c("reason")), fields).alias("message"),
        "event_count", TX.severity_level(sev).alias("attack_level"),
        TX.attack_message(c("ip"), F.lit("xss"), sev).alias("attack_text"),
        TX.unban_message(c("ip"), c("reason")).alias("unban_text"),
        TX.system_message(F.lit("restart"), F.lit("error"), c("node_id")).alias("system_text"))
