"""DuckDB views the checks share.  Written with plain window functions and CASE chains."""

from __future__ import annotations

from .. import rules as R
from ..functions.regex import is_valid


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def matches(col: str, pattern: str, ic: bool = True) -> str:
    return f"regexp_matches({col}, {lit(('(?i)' if ic else '') + pattern)})"


def contains_any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(w)})" for w in words) + ")"


def case(pairs, default="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def lookup(col: str, table: dict, default: str) -> str:
    return case([(f"{col} = {lit(k)}", lit(v) if isinstance(v, str) else v) for k, v in table.items()],
                default)


REFERER = "coalesce(http_referer, '')"


def first_label(rules) -> str:
    return case([
        (f"{matches('request_uri', p)} OR {matches('http_user_agent', p)} OR {matches(REFERER, p)}",
         lit(f"{k}:{p}")) for k, on, ps in rules if on for p in ps if is_valid(p)])


PATTERN_LABEL = first_label(R.DEFAULT_ATTACK_RULES)
SENSITIVE = contains_any("lower(request_uri)", R.SENSITIVE_PATHS)
_W = "OVER (PARTITION BY remote_addr ORDER BY ts_us RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"
M10, M5, M1 = _W.format(600000000), _W.format(300000000), _W.format(60000000)

HITS = " + ".join(
    f"CASE WHEN {matches(c, p, ic)} THEN 1 ELSE 0 END"
    for _, p, ic in R.SUSPICIOUS_PATTERNS for c in ("request_uri", "http_user_agent", REFERER))


def _type_hit(kind):
    return "(" + " OR ".join(matches(c, p, ic) for k, p, ic in R.SUSPICIOUS_PATTERNS if k == kind
                             for c in ("request_uri", "http_user_agent", REFERER)) + ")"


TYPE_HITS = {k: _type_hit(k) for k in dict.fromkeys(k for k, _, _ in R.SUSPICIOUS_PATTERNS)}

RISK_LEVEL = """CASE WHEN remote_addr LIKE '10.%' OR remote_addr LIKE '192.168.%' THEN 'low'
  WHEN CAST(split_part(remote_addr,'.',1) AS INT) < 50 THEN 'medium' WHEN CAST(split_part(remote_addr,'.',1) AS INT) < 100 THEN 'low'
  WHEN CAST(split_part(remote_addr,'.',1) AS INT) < 150 THEN 'high' ELSE 'medium' END"""
COUNTRY = """CASE WHEN remote_addr LIKE '10.%' OR remote_addr LIKE '192.168.%' THEN 'Private'
  WHEN CAST(split_part(remote_addr,'.',1) AS INT) < 50 THEN 'US' WHEN CAST(split_part(remote_addr,'.',1) AS INT) < 100 THEN 'CN'
  WHEN CAST(split_part(remote_addr,'.',1) AS INT) < 150 THEN 'RU' ELSE 'Unknown' END"""

RATE_LABELS = {
    "rolling_404": ("n404 >= 20", "concat('high_404_frequency:', n404, '_in_10min')"),
    "rolling_1min": ("n_1min > 60", "concat('high_request_frequency:', n_1min, '_per_minute')"),
    "rolling_5min": ("n_5min > 200", "concat('sustained_high_frequency:', n_5min, '_in_5min')"),
    "rolling_distinct_uri": ("n_uris > 50", "concat('directory_scanning:', n_uris, '_unique_paths')"),
    "rolling_sensitive": ("n_sensitive > 5", "concat('sensitive_path_scanning:', n_sensitive, '_sensitive_paths')"),
}

_CUM = "OVER (PARTITION BY remote_addr ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def risk_sql(n="request_count", attacks="attack_count", e4="count_4xx", paths="unique_paths",
             uas="unique_agents", bans="ban_count"):
    return f"""least(least(CAST({attacks} AS DOUBLE)/{n}*100, 50)*0.3 + least(CAST({e4} AS DOUBLE)/{n}*100, 30)*0.2
  + CASE WHEN {paths}>10 THEN least(({paths}-10)*2.0, 25) ELSE 0 END*0.15
  + CASE WHEN {uas}>5 THEN least(({uas}-5)*3.0, 20) ELSE 0 END*0.1
  + CASE risk_level WHEN 'low' THEN 0 WHEN 'high' THEN 25 ELSE 10 END*0.1
  + CASE WHEN {bans}>0 THEN least({bans}*15.0, 30) ELSE 0 END*0.15, 100)"""


THREATS = {k: "(" + " OR ".join(matches("txt", p.replace(r"\$\{", r"\$\{")) for p in ps) + ")"
           for k, ps in R.THREAT_PATTERNS}

ORACLE_VIEWS = {
    "rated": f"""
SELECT *, {PATTERN_LABEL} AS pattern_label,
  count(*) FILTER (WHERE status = 404) {M10} AS n404, count(*) {M1} AS n_1min, count(*) {M5} AS n_5min,
  count(DISTINCT request_uri) {M10} AS n_uris,
  count(DISTINCT CASE WHEN {SENSITIVE} THEN request_uri END) {M10} AS n_sensitive
FROM access_log WHERE NOT (remote_addr LIKE '10.%' OR remote_addr LIKE '192.168.%')""",
    "detected": f"""
SELECT *, CASE WHEN pattern_label IS NULL THEN {case(list(RATE_LABELS.values()))} END AS frequency_label,
  coalesce(pattern_label, {case(list(RATE_LABELS.values()))}) AS attack_label
FROM rated""",
    "behaviour": f"""
SELECT *, {risk_sql()} AS risk_score FROM (
SELECT *, {RISK_LEVEL} AS risk_level, attack_label IS NOT NULL AS is_attack,
  count(*) {_CUM} AS request_count, count(attack_label) {_CUM} AS attack_count,
  count(*) FILTER (WHERE status BETWEEN 400 AND 499) {_CUM} AS count_4xx,
  count(*) FILTER (WHERE status = 404) {_CUM} AS count_404,
  count(DISTINCT nullif(request_uri, '')) {_CUM} AS unique_paths,
  count(DISTINCT nullif(http_user_agent, '')) {_CUM} AS unique_agents,
  min(ts_us) OVER (PARTITION BY remote_addr) AS first_seen_us,
  (SELECT count(*) FROM ban_records b WHERE b.ip = d.remote_addr AND b.ts_us <= d.ts_us) AS ban_count,
  CASE WHEN attack_label IS NOT NULL THEN lag(ts_us, 2) OVER (PARTITION BY remote_addr, attack_label IS NOT NULL ORDER BY ts_us, event_id) END AS third_us
FROM detected d) x""",
    "decided": f"""
SELECT *, CASE WHEN risk_score >= 30 THEN concat('风险评分过高: ', printf('%.1f', risk_score))
  WHEN attack_count >= 5 THEN concat('攻击次数过多: ', attack_count)
  WHEN is_attack AND ts_us - third_us < 60000000 THEN '短时间内频繁攻击'
  WHEN count_404 >= 20 THEN concat('404错误过多: ', count_404)
  WHEN ts_us > first_seen_us AND request_count / ((ts_us - first_seen_us)/1000000.0) * 60 > 30
    THEN concat('请求频率过高: ', printf('%.1f', request_count / ((ts_us - first_seen_us)/1000000.0) * 60), '/min')
  ELSE '未达到封禁条件' END AS ban_reason
FROM behaviour""",
    # final state of each address (all rows, allow-listed ones too)
    "ip_state": f"""
SELECT s.*, {risk_sql()} AS risk_score FROM (
SELECT a.remote_addr, any_value({RISK_LEVEL}) AS risk_level, any_value({COUNTRY}) AS country,
  min(a.ts_us) AS first_seen_us, max(a.ts_us) AS last_seen_us,
  count(*) AS request_count, count(*) FILTER (WHERE lbl IS NOT NULL) AS attack_count,
  count(*) FILTER (WHERE status BETWEEN 200 AND 299) AS count_2xx, count(*) FILTER (WHERE status BETWEEN 300 AND 399) AS count_3xx,
  count(*) FILTER (WHERE status BETWEEN 400 AND 499) AS count_4xx, count(*) FILTER (WHERE status BETWEEN 500 AND 599) AS count_5xx,
  count(DISTINCT nullif(request_uri,'')) AS unique_paths, count(DISTINCT nullif(http_user_agent,'')) AS unique_agents,
  (SELECT count(*) FROM ban_records b WHERE b.ip = a.remote_addr) AS ban_count
FROM (SELECT *, {PATTERN_LABEL} AS lbl FROM access_log) a GROUP BY a.remote_addr) s""",
    "sec_raw": f"""
SELECT *, {', '.join(f'{c} AS hit_{k}' for k, c in THREATS.items())} FROM (
  SELECT *, concat(request_path, ' ', coalesce(request_body, '')) AS txt FROM security_input) t""",
    "sec_typed": f"""
SELECT *, CASE WHEN hit_sql_injection THEN 'sql_injection' WHEN hit_xss THEN 'xss_attempt'
   WHEN hit_directory_traversal THEN 'directory_traversal' WHEN hit_command_injection THEN 'command_injection'
   WHEN given_type IN ({', '.join(lit(t) for t in R.EVENT_TYPES)}) THEN given_type
   WHEN response_status = 401 THEN 'login_failure' WHEN response_status = 403 THEN 'unauthorized_access'
   ELSE 'suspicious_activity' END AS event_type,
  CASE WHEN hit_sql_injection OR hit_command_injection THEN 'high' WHEN hit_xss OR hit_directory_traversal THEN 'medium'
   WHEN response_status >= 500 THEN 'medium' WHEN response_status >= 400 THEN 'low' ELSE 'info' END AS base_level,
  concat_ws(',', CASE WHEN hit_sql_injection THEN 'sql_injection' END, CASE WHEN hit_xss THEN 'xss' END,
   CASE WHEN hit_directory_traversal THEN 'directory_traversal' END, CASE WHEN hit_command_injection THEN 'command_injection' END) AS found,
  CAST(hit_sql_injection AS INT) + CAST(hit_xss AS INT) + CAST(hit_directory_traversal AS INT) + CAST(hit_command_injection AS INT) AS n_found,
  source_ip IN (SELECT ip FROM malicious_ips) AS bad_ip
FROM sec_raw""",
    "sec_events": f"""
SELECT id, event_id, ts_us, source_ip, node_id, event_type, coalesce(given_description, concat(event_type, ' detected')) AS description,
  CASE WHEN bad_ip THEN 'high' ELSE base_level END AS security_level,
  CASE WHEN bad_ip THEN concat_ws(',', nullif(found, ''), 'known_malicious_ip') ELSE found END AS indicators,
  CAST(least({lookup('event_type', R.THREAT_BASE_SCORES, '30')} + CASE WHEN bad_ip THEN 20 ELSE 0 END + n_found * 5
    + {lookup('base_level', R.LEVEL_SCORES, '0')}, 100) AS DOUBLE) AS threat_score,
  concat('iso27001', CASE WHEN event_type IN ({', '.join(lit(t) for t in R.PCI_EVENT_TYPES)}) THEN ',pci_dss' ELSE '' END,
    CASE WHEN event_type IN ({', '.join(lit(t) for t in R.GDPR_EVENT_TYPES)}) THEN ',gdpr' ELSE '' END) AS tags
FROM sec_typed""",
    "sys_raw": r"""
SELECT event_id, value, lower(value) AS low, regexp_matches(value, '^\{.*\}$') AS is_json,
  regexp_extract(value, '^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})', 1) AS t1,
  regexp_extract(value, '^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})', 1) AS t2,
  regexp_extract(value, '^(\w{3} \d{1,2} \d{2}:\d{2}:\d{2})', 1) AS t3
FROM system_log""",
    "sys_events": r"""
SELECT event_id, value AS raw_line, is_json AS structured,
  CASE WHEN is_json THEN epoch_us(CAST(replace(json_extract_string(value, '$.timestamp'), 'Z', '') AS TIMESTAMP))
    WHEN t1 <> '' THEN epoch_us(strptime(t1, '%Y-%m-%d %H:%M:%S')) WHEN t2 <> '' THEN epoch_us(strptime(t2, '%Y/%m/%d %H:%M:%S'))
    ELSE epoch_us(strptime(concat('2024 ', t3), '%Y %b %d %H:%M:%S')) END AS ts_us,
  CASE WHEN is_json THEN json_extract_string(value, '$.event_type')
    WHEN regexp_matches(value, '\[([^\]]+)\]') THEN regexp_extract(value, '\[([^\]]+)\]', 1)
    WHEN contains(low, 'banned') THEN 'ip_banned' WHEN contains(low, 'attack') THEN 'attack_detected'
    WHEN contains(low, 'system') THEN 'system_event' WHEN contains(low, 'performance') THEN 'performance_metric' ELSE 'unknown' END AS event_type,
  CASE WHEN is_json THEN json_extract_string(value, '$.level')
    WHEN regexp_matches(value, '- (DEBUG|INFO|WARNING|ERROR|CRITICAL) -') THEN regexp_extract(value, '- (DEBUG|INFO|WARNING|ERROR|CRITICAL) -', 1)
    WHEN contains(low, 'critical') THEN 'CRITICAL' WHEN contains(low, 'error') THEN 'ERROR' WHEN contains(low, 'warning') THEN 'WARNING'
    WHEN contains(low, 'info') THEN 'INFO' WHEN contains(low, 'debug') THEN 'DEBUG' ELSE 'INFO' END AS level,
  CASE WHEN is_json THEN json_extract_string(value, '$.ip') ELSE
    coalesce(nullif(regexp_extract(value, '\bIP\s+(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b', 1), ''),
     nullif(regexp_extract(value, '\b([0-9a-fA-F:]+::[0-9a-fA-F:]*|[0-9a-fA-F:]+:[0-9a-fA-F:]+:[0-9a-fA-F:]+)\b', 1), '')) END AS ip_address,
  CASE WHEN is_json THEN json_extract_string(value, '$.message') ELSE value END AS message
FROM sys_raw WHERE is_json OR t1 <> '' OR t2 <> '' OR t3 <> ''""",
}

_BAN_CLASS = case([(contains_any("lower(message)", ws), lit(k)) for k, ws in R.BAN_REASON_CLASSES], "'Unknown'")
_FOUND = ", ".join(
    f"CASE WHEN length(trim(regexp_extract(message, {lit('(?i)' + p)}, 1))) > 2 THEN trim(regexp_extract(message, {lit('(?i)' + p)}, 1)) END"
    for p in R.BAN_REASON_PATTERNS)
BAN_REASON = f"coalesce({_FOUND}, {_BAN_CLASS})"
ATTACK_TYPE = case([(contains_any("lower(message)", ws), lit(k)) for k, ws in R.ATTACK_TYPE_CLASSES], "'Other'")
_BASE = ("CASE WHEN lower(level) IN ('critical','fatal') THEN 'critical' WHEN lower(level)='error' THEN 'high' "
         "WHEN lower(level)='warning' THEN 'medium' ELSE 'low' END")
SEVERITY = case([
    (contains_any("lower(message)", R.SEVERITY_CRITICAL_WORDS), "'critical'"),
    (contains_any("lower(message)", R.SEVERITY_HIGH_WORDS),
     f"CASE WHEN {_BASE} IN ('low','medium') THEN 'high' ELSE {_BASE} END"),
    (contains_any("lower(message)", R.SEVERITY_MEDIUM_WORDS),
     f"CASE WHEN {_BASE} = 'low' THEN 'medium' ELSE {_BASE} END"),
    (contains_any("lower(message)", R.SEVERITY_LOW_WORDS), "'low'")], _BASE)


def _chain(name: str, rows: str, keys: str, gap: str, cols: str) -> dict[str, str]:
    """Recursive form of the greedy filters: first row, then the first row that is old enough."""
    on = " AND ".join(f"r.{k} = s.{k}" for k in keys.split(", "))
    sel = ", ".join(f"r.{x}" for x in cols.split(", "))
    # one row per key and time: the first by id
    base = f"SELECT * FROM ({rows}) q QUALIFY row_number() OVER (PARTITION BY {keys}, ts_us ORDER BY event_id) = 1"
    return {f"{name}_rows": base, f"{name}_chain": f"""
SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts_us) AS rn FROM {name}_rows) f WHERE rn = 1
UNION ALL
SELECT {cols} FROM (SELECT {sel}, row_number() OVER (PARTITION BY {', '.join('r.' + k for k in keys.split(', '))} ORDER BY r.ts_us) AS rn
  FROM {name}_chain s JOIN {name}_rows r ON {on} AND r.ts_us >= s.ts_us + {gap}) n WHERE rn = 1"""}


_ROUTES = " UNION ALL ".join(f"SELECT '{k}' AS level, '{ch}' AS channel" for k, v in R.NOTIFICATION_ROUTES.items() for ch in v)
ORACLE_VIEWS |= _chain("st01", f"""SELECT concat('attack_', split_part(label, ':', 1), '_', remote_addr) AS key, ts_us, event_id
  FROM (SELECT *, {PATTERN_LABEL} AS label FROM access_log) a WHERE label IS NOT NULL""", "key", "60000000", "key, ts_us, event_id")
ORACLE_VIEWS |= _chain("st02", "SELECT ip, ts_us, event_id, duration_s FROM ban_records", "ip", "s.duration_s * 1000000",
                       "ip, ts_us, event_id, duration_s")
ORACLE_VIEWS |= _chain("st12", """SELECT remote_addr AS ip, ts_us, event_id FROM decided
  WHERE attack_label IS NOT NULL OR ban_reason <> '未达到封禁条件'""", "ip", "120000000", "ip, ts_us, event_id")
ORACLE_VIEWS |= _chain("st04", f"SELECT channel, level, ts_us, event_id FROM notifications JOIN ({_ROUTES}) r USING (level)",
                       "channel, level", "60000000", "channel, level, ts_us, event_id")
ORACLE_VIEWS |= _chain("st04b", "SELECT level, source, ts_us, event_id FROM notifications", "level, source", "60000000",
                       "level, source, ts_us, event_id")
ORACLE_VIEWS |= {
    "st03_rows": """
SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts_us, event_id) AS rn, avg(CASE WHEN NOT is_anomaly THEN value END) OVER w AS m,
  stddev_pop(CASE WHEN NOT is_anomaly THEN value END) OVER w AS sd, CASE name WHEN 'view' THEN 20.0 WHEN 'error' THEN 50.0 ELSE 30.0 END AS initial
FROM metrics WINDOW w AS (PARTITION BY name ORDER BY ts_us, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""",
    "st03_fold": """
SELECT name, rn, event_id, value, CAST(initial AS DOUBLE) AS baseline, CAST(initial AS DOUBLE) AS threshold FROM st03_rows WHERE rn = 1
UNION ALL
SELECT r.name, r.rn, r.event_id, r.value, CASE WHEN r.rn >= 10 AND r.m IS NOT NULL THEN s.baseline * 0.95 + r.m * 0.05 ELSE s.baseline END,
  CASE WHEN r.rn >= 10 AND r.m IS NOT NULL THEN s.baseline * 0.95 + r.m * 0.05 + r.sd * 0.1 ELSE s.threshold END
FROM st03_fold s JOIN st03_rows r ON r.name = s.name AND r.rn = s.rn + 1""",
    "st05_rows": "SELECT remote_addr, event_id, ts_us, row_number() OVER (PARTITION BY remote_addr ORDER BY ts_us, event_id) AS rn FROM access_log",
    "st05_fold": """
SELECT remote_addr, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, false AS allowed, CAST([] AS BIGINT[]) AS ring FROM access_log GROUP BY 1
UNION ALL
SELECT remote_addr, rn, event_id, len(live) < 20, CASE WHEN len(live) < 20 THEN list_append(live, ts_us) ELSE live END FROM (
 SELECT r.remote_addr, r.rn, r.event_id, r.ts_us, list_filter(s.ring, lambda x: x > r.ts_us - 10000000) AS live
 FROM st05_fold s JOIN st05_rows r ON r.remote_addr = s.remote_addr AND r.rn = s.rn + 1) t""",
}
ORACLE_VIEWS["grams"] = " UNION ALL ".join(
    f"SELECT event_id, substr(lower(request_uri), i, {n}) AS g FROM (SELECT event_id, request_uri, unnest(generate_series(1, length(request_uri) - {n - 1})) AS i FROM access_log) u"
    for n in (1, 2, 3))
