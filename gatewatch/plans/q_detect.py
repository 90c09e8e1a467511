"""Request classifiers, address joins, rolling rules and address behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..functions import ip as IP
from ..functions import patterns as PT
from ..operators import addresses as AD
from ..operators import behaviour as BE
from ..operators import windows as W
from ..session import cut_lineage
from . import oracle_views as O
from .registry import query

c = lambda n: F.col(n)
HOT_ROWS = W.HOT_ROWS
SLICE = 60_000_000  # the fixture covers 12 minutes; a finer slice exercises the hand-over


def allow_networks(d):
    return AD.networks_frame(d.spark, R.DEFAULT_ALLOW_IPS + R.DEFAULT_ALLOW_NETWORKS)


def monitored(d):
    return AD.drop_configured(d.access_log, R.DEFAULT_ALLOW_IPS + R.DEFAULT_ALLOW_NETWORKS)


def detected(d):
    return W.detect(monitored(d))


def bans_by_ip(d):
    return d.ban_records.select(F.col("ip").alias("remote_addr"), "ts_us", "event_id")


def behaviour(d, bans=True):
    rows = cut_lineage(detected(d))  # read twice below
    return W.running_behaviour(rows, c("attack_label"), IP.geo_struct(c("remote_addr"))["risk_level"],
                               bans_by_ip(d) if bans else None, slice_us=SLICE)


# -- per-row classifiers -----------------------------------------------------------
_TYPES = ", ".join(f"CASE WHEN {h} THEN '{k}' END" for k, h in O.TYPE_HITS.items())


@query("f01_suspicious_request", f"""
SELECT event_id, CAST(n AS BIGINT) AS n_hits, n > 0 AS is_suspicious, attack_types,
  CAST(n * 10 + CASE WHEN status >= 400 THEN 5 ELSE 0 END + CASE WHEN body_bytes_sent > 100000 THEN 15 ELSE 0 END + CASE WHEN request_time > 30 THEN 10 ELSE 0 END AS BIGINT) AS risk_score,
  CASE WHEN status = 404 THEN 'status_404' WHEN status >= 500 THEN 'server_error' END AS status_detail
FROM (SELECT *, {O.HITS} AS n, concat_ws(',', {_TYPES}) AS attack_types FROM access_log) t""")
def f01(d):
    return PT.suspicious_request(d.access_log, max_bytes=100_000).select(
        "event_id", F.size("hits").cast("bigint").alias("n_hits"), "is_suspicious",
        F.array_join("attack_types", ",").alias("attack_types"), "risk_score", "status_detail")


@query("f02_is_bot", f"SELECT event_id, {O.contains_any('lower(http_user_agent)', R.BOT_WORDS)} AS is_bot FROM access_log")
def f02(d):
    return d.access_log.select("event_id", PT.is_bot(c("http_user_agent")).alias("is_bot"))


@query("f03_first_attack_match", f"SELECT event_id, {O.PATTERN_LABEL} AS label FROM access_log")
def f03(d):
    return d.access_log.select("event_id", PT.first_attack_match().alias("label"))


# 506 rules: numbered items, of which many begin like others, the default rules, and a few without a literal
MANY_RULES = [("item", True, [f"/p/{i}$" for i in range(997, 1, -2)]), *R.DEFAULT_ATTACK_RULES, ("digits", True, [r"^.p.\d\d?$"]),
              ("agent", True, [r"x11; v[0-2]\)"])]


@query("f03_many_rules", f"SELECT event_id, {O.first_label(MANY_RULES)} AS label FROM access_log")
def f03_many(d):
    return d.access_log.select("event_id", PT.first_attack_match(MANY_RULES).alias("label"))


@query("f04_frequency_verdict", "SELECT event_id, frequency_label, attack_label FROM detected")
def f04(d):
    return detected(d).select("event_id", "frequency_label", "attack_label")


_TOOLS = ", ".join(f"CASE WHEN contains(lower(http_user_agent), '{w}') THEN '{w}' END" for w in R.TOOL_WORDS)
_NTOOL = " + ".join(f"CASE WHEN contains(lower(http_user_agent), '{w}') THEN 10 ELSE 0 END" for w in R.TOOL_WORDS)
_UA_SCORE = f"({_NTOOL} + CASE WHEN length(http_user_agent) < 10 THEN 5 ELSE 0 END + CASE WHEN regexp_matches(http_user_agent, '[<>\"'';]') THEN 8 ELSE 0 END)"


@query("f05_ua_analysis", f"""
SELECT event_id, concat_ws(',', {_TOOLS}, CASE WHEN length(http_user_agent) < 10 THEN 'empty_or_short' END,
  CASE WHEN regexp_matches(http_user_agent, '[<>"'';]') THEN 'special_characters' END) AS indicators, CAST({_UA_SCORE} AS BIGINT) AS ua_score FROM access_log""")
def f05(d):
    u = PT.ua_analysis(c("http_user_agent"))
    return d.access_log.select("event_id", F.array_join(u["ua_indicators"], ",").alias("indicators"),
                               u["ua_score"].alias("ua_score"))


_SPECIAL = "length(regexp_replace({0}, '[^&=?#<>\"''()\\[\\]{{}}|;]', '', 'g'))"
_PCT = "(length({0}) - length(replace({0}, '%', '')))"


def _payload_sql(x):
    p, s = _PCT.format(x), _SPECIAL.format(x)
    return (f"CAST(CASE WHEN length({x}) > 1000 THEN 10 ELSE 0 END + CASE WHEN {p} > 10 THEN {p} ELSE 0 END "
            f"+ CASE WHEN {s} > length({x}) * 0.3 THEN 12 ELSE 0 END AS BIGINT)")


@query("f06_payload_analysis", f"SELECT doc_id, {_payload_sql('u')} AS payload_score FROM (SELECT doc_id, concat(text, CASE doc_id % 3 WHEN 0 THEN '?a=%41%42%43%44%45%46%47%48%49%4A%4B' WHEN 1 THEN repeat('&=?#', length(text)) ELSE '' END) AS u FROM documents) t")
def f06(d):
    k = c("doc_id") % 3
    rows = d.documents.select("doc_id", F.concat("text", F.when(k == 0, F.lit(
        "?a=%41%42%43%44%45%46%47%48%49%4A%4B")).when(k == 1, F.expr("repeat('&=?#', length(text))"))
        .otherwise("")).alias("u"))
    return rows.select("doc_id", PT.payload_analysis(c("u"))["payload_score"].alias("payload_score"))


_GAP_SQL = """SELECT *, CASE WHEN n_gaps > 0 THEN gs / n_gaps / 1000000 END AS mean_gap,
  CASE WHEN n_gaps > 1 THEN sqrt(greatest((gq - gs * gs / n_gaps) / (n_gaps - 1), 0)) / 1000000 END AS stdev_gap
  FROM (SELECT *, count(gap) OVER w AS n_gaps, CAST(sum(gap) OVER w AS DOUBLE) AS gs, CAST(sum(CAST(gap AS HUGEINT) * gap) OVER w AS DOUBLE) AS gq FROM (
  SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY remote_addr ORDER BY ts_us, event_id) AS gap FROM detected) g
  WINDOW w AS (PARTITION BY remote_addr ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) h"""


@query("f07_advanced_verdict", f"""
SELECT event_id, attack_label, CAST({_UA_SCORE} AS BIGINT) AS ua_score, CASE WHEN n_gaps >= 5 AND stdev_gap < 1 AND mean_gap < 5 THEN 15 ELSE 0 END AS timing_score,
 {_payload_sql('request_uri')} AS payload_score
FROM ({_GAP_SQL}) q
WHERE attack_label IS NOT NULL OR {_UA_SCORE} > 0 OR (n_gaps >= 5 AND stdev_gap < 1 AND mean_gap < 5) OR {_payload_sql('request_uri')} > 0""")
def f07(d):
    return W.advanced_verdict(detected(d), slice_us=SLICE).select(
        "event_id", "attack_label", "ua_score", "timing_score", "payload_score")


@query("f08_allow_list_filter", """
SELECT event_id FROM access_log WHERE NOT (remote_addr LIKE '10.%' OR remote_addr LIKE '192.168.%')""")
def f08(d):
    return monitored(d).select("event_id")


# -- joins -------------------------------------------------------------------------
_NET = r"""nets AS (SELECT DISTINCT CAST(split_part(a,'.',1) AS BIGINT)*16777216+CAST(split_part(a,'.',2) AS BIGINT)*65536+CAST(split_part(a,'.',3) AS BIGINT)*256+CAST(split_part(a,'.',4) AS BIGINT) AS lo, bits FROM (
  SELECT split_part(cidr,'/',1) AS a, coalesce(try_cast(nullif(split_part(cidr,'/',2),'') AS INT), 32) AS bits FROM networks WHERE cidr LIKE '%.%.%.%') n)"""
_NUM = "(CAST(split_part(remote_addr,'.',1) AS BIGINT)*16777216+CAST(split_part(remote_addr,'.',2) AS BIGINT)*65536+CAST(split_part(remote_addr,'.',3) AS BIGINT)*256+CAST(split_part(remote_addr,'.',4) AS BIGINT))"


@query("j01_allow_list_join", f"""
SELECT event_id FROM access_log WHERE NOT EXISTS (SELECT 1 FROM ({_NET.split('AS (', 1)[1][:-1]}) x
  WHERE {_NUM} BETWEEN lo AND lo + CAST(power(2, 32 - bits) AS BIGINT) - 1)""")
def j01(d):
    nets = AD.networks_from_text(d.networks.select("cidr").distinct())
    return AD.drop_allow_listed(d.access_log, nets).select("event_id")


@query("j02_threat_ip_join", "SELECT event_id, remote_addr IN (SELECT ip FROM malicious_ips) AS is_malicious FROM access_log")
def j02(d):
    return AD.flag_listed(d.access_log, d.malicious_ips, "remote_addr").select("event_id", "is_malicious")


@query("j03_geo_range_join", f"""
SELECT event_id, g.country, g.risk_level FROM access_log LEFT JOIN geo_ranges g ON {_NUM} BETWEEN g.lo AND g.hi""")
def j03(d):
    return AD.range_lookup(d.access_log, d.geo_ranges, "remote_addr", ["country", "risk_level"]).select(
        "event_id", "country", "risk_level")


@query("j05_ban_history_asof", """
SELECT event_id, (SELECT count(*) FROM ban_records b WHERE b.ip = a.remote_addr AND b.ts_us <= a.ts_us) AS ban_count FROM access_log a""")
def j05(d):
    return W.ban_history_asof(d.access_log, bans_by_ip(d), slice_us=SLICE).select("event_id", "ban_count")


@query("j17_allow_list_edit", """
SELECT DISTINCT cidr FROM (SELECT cidr FROM networks WHERE s_suppkey % 2 = 0 UNION SELECT cidr FROM networks WHERE s_suppkey % 3 = 0) t
WHERE cidr <> 'not a network' AND cidr NOT IN (SELECT cidr FROM networks WHERE s_suppkey % 7 = 0)""")
def j17(d):
    n = d.networks
    add = AD.networks_from_text(n.where("s_suppkey % 3 = 0"))
    cur = AD.networks_from_text(n.where("s_suppkey % 2 = 0"))
    return AD.edit_list(cur, add, n.where("s_suppkey % 7 = 0"), "cidr")


# -- rolling rules --------------------------------------------------------------------
def _rated(d):
    rows = monitored(d)
    out = W.rate_counts(rows, hot_rows=HOT_ROWS)
    for n, e in W.rate_labels().items():
        out = out.withColumn(n, e)
    return out


def _rate_query(op, label, count):
    cond, text = O.RATE_LABELS[label]

    @query(f"{op}_{label}", f"SELECT event_id, {count} AS n, CASE WHEN {cond} THEN {text} END AS label FROM rated")
    def q(d):
        return _rated(d).select("event_id", c(count).alias("n"), c(label).alias("label"))
    return q


for _op, _label, _n in (("w01", "rolling_404", "n404"), ("w02", "rolling_1min", "n_1min"),
                        ("w03", "rolling_5min", "n_5min"), ("w04", "rolling_distinct_uri", "n_uris"),
                        ("w05", "rolling_sensitive", "n_sensitive")):
    _rate_query(_op, _label, _n)


@query("w06_attack_burst", "SELECT event_id, is_attack AND coalesce(ts_us - third_us < 60000000, false) AS burst FROM behaviour")
def w06(d):
    return behaviour(d, bans=False).select("event_id", (c("is_attack") & (c("attacks_60s") >= 3)).alias("burst"))


@query("w07_regular_intervals", f"""
SELECT event_id, n_gaps, round(mean_gap, 6) AS mean_gap, round(stdev_gap, 6) AS stdev_gap, n_gaps >= 5 AND stdev_gap < 1 AND mean_gap < 5 AS suspicious FROM ({_GAP_SQL}) q""")
def w07(d):
    return W.regular_intervals(monitored(d), slice_us=SLICE).select(
        "event_id", "n_gaps", F.round("mean_gap", 6).alias("mean_gap"),
        F.round("stdev_gap", 6).alias("stdev_gap"), c("timing_suspicious").alias("suspicious"))


_B = "event_id, request_count, attack_count, count_4xx, count_404, unique_paths, unique_agents, ban_count"


@query("w08_running_behaviour", f"SELECT {_B}, round(risk_score, 6) AS risk_score FROM behaviour")
def w08(d):
    return behaviour(d).select(*_B.split(", "), F.round("risk_score", 6).alias("risk_score"))


def decided(d):
    b = behaviour(d)
    for n, e in W.ban_decision({"risk_threshold": 30}).items():
        b = b.withColumn(n, e)
    return b


@query("w09_ban_decision", "SELECT event_id, ban_reason, ban_reason <> '未达到封禁条件' AS should_ban FROM decided")
def w09(d):
    return decided(d).select("event_id", "ban_reason", "should_ban")


@query("w10_combined_verdict", """
SELECT event_id, remote_addr, coalesce(attack_label, ban_reason) AS reason FROM decided
WHERE attack_label IS NOT NULL OR ban_reason <> '未达到封禁条件'""")
def w10(d):
    return W.combined_verdict(decided(d)).select("event_id", "remote_addr", "reason")


_H = "OVER (PARTITION BY remote_addr ORDER BY ts_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)"
_HR = "hour(make_timestamp(ts_us))"
_WD = "isodow(make_timestamp(ts_us))"
HOUR_SQL = f"""
SELECT *, count(*) {_H} / 3600.0 AS behavior_request_rate, (count(*) FILTER (WHERE status >= 400) {_H}) / CAST(count(*) {_H} AS DOUBLE) AS behavior_error_rate,
  CAST(count(DISTINCT request_uri) {_H} AS DOUBLE) AS behavior_unique_paths, CAST(count(DISTINCT http_user_agent) {_H} AS DOUBLE) AS behavior_unique_user_agents,
  round(coalesce(avg(nullif(request_time, 0)) {_H}, 0), 6) AS behavior_avg_response_time,
  (count(*) FILTER (WHERE {_HR} < 6 OR {_HR} > 22) {_H}) / CAST(count(*) {_H} AS DOUBLE) AS behavior_night_requests_ratio,
  (count(*) FILTER (WHERE {_WD} >= 6) {_H}) / CAST(count(*) {_H} AS DOUBLE) AS behavior_weekend_requests_ratio FROM access_log"""
_HC = ["behavior_request_rate", "behavior_error_rate", "behavior_unique_paths", "behavior_unique_user_agents",
       "behavior_avg_response_time", "behavior_night_requests_ratio", "behavior_weekend_requests_ratio"]


@query("w11_ml_hour_window", f"SELECT event_id, {', '.join(_HC)} FROM ({HOUR_SQL}) t")
def w11(d):
    h = W.hour_features(d.access_log, hot_rows=HOT_ROWS)
    return h.select("event_id", *[F.round(x, 6).alias(x) if "time" in x else x for x in _HC])


@query("w12_attack_last_hour", """
SELECT remote_addr, round(count(*)/3600.0, 9) AS request_rate,
  coalesce(round((count(*) FILTER (WHERE lbl IS NOT NULL AND status >= 400))/nullif(CAST(count(lbl) AS DOUBLE), 0), 9), 0) AS error_rate,
  count(DISTINCT nullif(request_uri,'')) AS unique_paths, count(DISTINCT nullif(http_user_agent,'')) AS user_agent_diversity,
  round(count(DISTINCT CASE WHEN status BETWEEN 400 AND 499 THEN status END)/CAST(count(*) AS DOUBLE), 9) AS status_4xx_rate,
  round(count(lbl)/3600.0, 9) AS attack_frequency
FROM (SELECT *, """ + O.PATTERN_LABEL + """ AS lbl FROM access_log) t GROUP BY remote_addr""")
def w12(d):
    rows = d.access_log.withColumn("attack_label", PT.first_attack_match())
    f = BE.anomaly_features(rows, as_of_us=1704067920000000)
    return f.select("remote_addr", *[F.round(x, 9).alias(x) for x in ("request_rate", "error_rate")],
                    "unique_paths", "user_agent_diversity",
                    *[F.round(x, 9).alias(x) for x in ("status_4xx_rate", "attack_frequency")])


# -- behaviour of an address -----------------------------------------------------------
def ip_state(d):
    rows = d.access_log.withColumn("attack_label", PT.first_attack_match())
    return BE.ip_behaviour(rows, bans_by_ip(d))


@query("ag02_ip_detector_stats", """
SELECT remote_addr, count(*) AS total_requests, max(ts_us) AS last_request_us, count(DISTINCT request_uri) AS unique_paths, count(DISTINCT http_user_agent) AS unique_user_agents,
  count(*) FILTER (WHERE ts_us >= 1704067920000000 - 60000000) AS requests_last_1min, count(*) FILTER (WHERE ts_us >= 1704067920000000 - 300000000) AS requests_last_5min,
  count(*) FILTER (WHERE ts_us >= 1704067920000000 - 600000000) AS requests_last_10min, count(*) FILTER (WHERE ts_us >= 1704067920000000 - 3600000000) AS requests_last_60min,
  count(*) FILTER (WHERE status = 404) AS n_404, count(*) FILTER (WHERE request_method = 'POST') AS n_post
FROM access_log GROUP BY remote_addr""")
def ag02(d):
    s = BE.detector_stats(d.access_log, 1704067920000000)
    return s.select("remote_addr", "total_requests", "last_request_us", "unique_paths", "unique_user_agents",
                    *[f"requests_last_{m}min" for m in (1, 5, 10, 60)],
                    F.coalesce(F.try_element_at("status_codes", F.lit(404).cast("bigint")), F.lit(0)).alias("n_404"),
                    F.coalesce(F.try_element_at("methods", F.lit("POST")), F.lit(0)).alias("n_post"))


@query("ag03_detector_stats", """
SELECT count(DISTINCT remote_addr) AS monitored_ips, count(*) AS total_requests, 3 AS enabled_types, 7 AS enabled_patterns FROM access_log""")
def ag03(d):
    return BE.detector_totals(d.access_log)


@query("ag04_ip_behaviour", """
SELECT remote_addr, first_seen_us, last_seen_us, request_count, attack_count, count_4xx, unique_paths, unique_agents, country, ban_count FROM ip_state""")
def ag04(d):
    return ip_state(d).select("remote_addr", "first_seen_us", "last_seen_us", "request_count", "attack_count",
                              "count_4xx", "unique_paths", "unique_agents", "country", "ban_count")


@query("ag05_behaviour_summary", f"""
SELECT s.remote_addr, round(count_2xx/CAST(request_count AS DOUBLE), 6) AS rate_2xx, round(count_3xx/CAST(request_count AS DOUBLE), 6) AS rate_3xx,
  round(count_4xx/CAST(request_count AS DOUBLE), 6) AS rate_4xx, round(count_5xx/CAST(request_count AS DOUBLE), 6) AS rate_5xx,
  coalesce(string_agg(CAST(l.event_id AS VARCHAR), ',' ORDER BY l.ts_us, l.event_id), '') AS recent
FROM ip_state s LEFT JOIN (SELECT * FROM (SELECT *, {O.PATTERN_LABEL} AS lbl FROM access_log) a WHERE lbl IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY remote_addr ORDER BY ts_us DESC, event_id DESC) <= 5) l USING (remote_addr)
GROUP BY ALL""")
def ag05(d):
    rows = d.access_log.withColumn("attack_label", PT.first_attack_match())
    s = BE.behaviour_summary(ip_state(d), rows)
    return s.select("remote_addr", *[F.round(f"rate_{k}xx", 6).alias(f"rate_{k}xx") for k in (2, 3, 4, 5)],
                    F.array_join(F.transform("recent_attacks", lambda x: x["event_id"].cast("string")), ",")
                    .alias("recent"))


@query("ag06_risk_score", "SELECT remote_addr, round(risk_score, 6) AS risk_score FROM ip_state")
def ag06(d):
    return ip_state(d).select("remote_addr", F.round("risk_score", 6).alias("risk_score"))


_LISTED = "(remote_addr LIKE '10.%' OR remote_addr LIKE '192.168.%')"


@query("ag07_risk_distribution", f"""
SELECT count(*) AS total_ips, count(*) FILTER (WHERE {_LISTED}) AS whitelisted_ips, count(*) FILTER (WHERE NOT {_LISTED}) AS monitored_ips,
  CAST(sum(request_count) AS BIGINT) AS total_requests, CAST(sum(attack_count) AS BIGINT) AS total_attacks, round(sum(attack_count)/CAST(sum(request_count) AS DOUBLE), 6) AS attack_rate,
  count(*) FILTER (WHERE risk_score < 10) AS low, count(*) FILTER (WHERE risk_score >= 10 AND risk_score < 20) AS medium, count(*) FILTER (WHERE risk_score >= 20) AS high
FROM ip_state""")
def ag07(d):
    r = BE.risk_distribution(ip_state(d), allow_networks(d), bands=(10, 20))
    return r.withColumn("attack_rate", F.round("attack_rate", 6))


@query("ag08_ip_report", """
SELECT s.remote_addr, p.paths, u.agents, b.bans, st.codes FROM ip_state s
LEFT JOIN (SELECT remote_addr, string_agg(request_uri, '|' ORDER BY request_uri) AS paths FROM (SELECT DISTINCT remote_addr, request_uri FROM access_log QUALIFY dense_rank() OVER (PARTITION BY remote_addr ORDER BY request_uri) <= 20) x GROUP BY 1) p USING (remote_addr)
LEFT JOIN (SELECT remote_addr, string_agg(http_user_agent, '|' ORDER BY http_user_agent) AS agents FROM (SELECT DISTINCT remote_addr, http_user_agent FROM access_log WHERE http_user_agent <> '' QUALIFY dense_rank() OVER (PARTITION BY remote_addr ORDER BY http_user_agent) <= 10) x GROUP BY 1) u USING (remote_addr)
LEFT JOIN (SELECT ip AS remote_addr, count(*) AS bans FROM ban_records GROUP BY 1) b USING (remote_addr)
LEFT JOIN (SELECT remote_addr, string_agg(concat(status, '=', n), ',' ORDER BY status) AS codes FROM (SELECT remote_addr, status, count(*) AS n FROM access_log GROUP BY ALL) x GROUP BY 1) st USING (remote_addr)""")
def ag08(d):
    rows = d.access_log.withColumn("attack_label", PT.first_attack_match())
    r = BE.ip_report(ip_state(d), rows)
    codes = F.array_join(F.transform(F.array_sort(F.map_entries("status_codes")), lambda e: F.concat(
        e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",")
    return r.select("remote_addr", F.array_join("top_paths", "|").alias("paths"),
                    F.array_join("user_agents", "|").alias("agents"), F.nullif("ban_count", F.lit(0)).alias("bans"),
                    codes.alias("codes"))


@query("ag08_address_values", """
SELECT remote_addr, 'agent' AS dimension, http_user_agent AS value, count(*) AS n FROM access_log WHERE http_user_agent <> '' GROUP BY ALL
UNION ALL SELECT remote_addr, 'path', request_uri, count(*) FROM access_log WHERE request_uri <> '' GROUP BY ALL""")
def ag08c(d):
    return BE.address_values(d.access_log)


@query("ag08_ban_history", "SELECT event_id, ts_us, reason, duration_s FROM ban_records WHERE ip = '45.33.0.1'")
def ag08b(d):
    return BE.ban_history(d.ban_records.withColumnRenamed("ip", "remote_addr"), "45.33.0.1").drop("remote_addr")


@query("tk03_top_risky_ips", f"""
SELECT remote_addr, round(risk_score, 6) AS risk_score, attack_count, request_count FROM ip_state WHERE NOT {_LISTED} AND risk_score > 0
ORDER BY ip_state.risk_score DESC, remote_addr LIMIT 10""")
def tk03(d):
    t = BE.top_risky(ip_state(d), allow_networks(d))
    return t.select("remote_addr", F.round("risk_score", 6).alias("risk_score"), "attack_count", "request_count")
