"""Stateful folds in batch form, sources and sinks."""

from __future__ import annotations

import glob
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import functions as F

from .. import rules as R

from ..functions import parse as PA
from ..functions import patterns as PT
from ..operators import alerts as AL
from ..operators import bans as BA
from ..operators import behaviour as BE
from ..operators import gaps as GA
from ..operators import notify as NO
from ..operators import state as ST
from ..operators import tenancy as TE
from ..sources import logs as LO
from ..sources import sinks as SI
from ..session import shared_folder
from ..sources.tail import read_counts, tail_files
from ..streaming import jobs
from ..operators import windows as W
from ..functions.ip import geo_struct
from ..streaming.detect import ban_stream, detection_stream
from . import fixtures as fx
from .q_detect import allow_networks, decided, ip_state
from .q_reports import END, sec_events
from .registry import query

c = lambda n: F.col(n)
SEG = 120_000_000


def _attack_keys(d):
    a = d.access_log.withColumn("label", PT.first_attack_match()).where("label is not null")
    return a.withColumn("key", F.concat_ws("_", F.lit("attack"), F.substring_index("label", ":", 1), "remote_addr"))


@query("st01_alert_suppression", "SELECT key, ts_us FROM st01_chain")
def st01(d):
    return AL.suppress(_attack_keys(d), "key", "ts_us", "event_id", 60, SEG).select("key", "ts_us")


@query("st02_ban_intervals", "SELECT ip, ts_us AS start_us, ts_us + duration_s * 1000000 AS end_us FROM st02_chain")
def st02(d):
    return BA.ban_intervals(d.ban_records, segment_us=SEG).select("ip", "start_us", "end_us")


@query("st03_dynamic_threshold", """
SELECT event_id, round(baseline, 6) AS baseline, round(threshold, 6) AS threshold, value > threshold AS exceeded FROM st03_fold""")
def st03(d):
    t = AL.dynamic_thresholds(d.metrics, {"view": 20.0, "error": 50.0}, fallback=30.0, block=1000, slice_us=60_000_000)
    return t.select("event_id", F.round("baseline", 6).alias("baseline"), F.round("threshold", 6).alias("threshold"), "exceeded")


@query("w13_baseline_stats", "SELECT event_id, round(m, 6) AS mean, round(sd, 6) AS deviation FROM st03_rows WHERE rn >= 10 AND m IS NOT NULL")
def w13(d):
    b = GA.baseline_statistics(d.metrics, "name", "ts_us", "event_id", "value", "is_anomaly", 1000, 60_000_000)
    return b.where("_on").select("event_id", F.round("_m", 6).alias("mean"), F.round("_sd", 6).alias("deviation"))


def in_time_order(rows, folder, batches, ts="ts_us"):
    """``rows`` as a stream of ``batches`` files, the next one holding the next stretch of time.  Files are written by one
    task each, whose rows many derive; small row groups let many tasks read one."""
    t0, t1 = rows.agg(F.min(ts), F.max(ts)).first()
    for i in range(batches):
        lo, hi = (t0 + (t1 + 1 - t0) * k // batches for k in (i, i + 1)) if t0 is not None else (0, 0)
        rows.where((c(ts) >= lo) & (c(ts) < hi)).repartition(1).write.mode("append").option("parquet.block.size", 8 << 20).parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _new_folder(d, name):
    return f"{shared_folder(d.spark)}/{name}-{uuid.uuid4().hex}"


def detection_job(d, batches=3):
    """The whole path as a stream: store, judge, analyse, decide, record.  Requests and the bans known from elsewhere come as
    one stream, in ``batches`` micro batches; each writes what it stored, its verdicts and its ban records."""
    folder = _new_folder(d, "detection")
    cols = ["remote_addr", "event_id", "ts_us", "request_uri", "status", "http_user_agent", "http_referer", "node_id"]
    rows = d.access_log.select(*cols, F.lit(False).alias("is_ban"))
    known = d.ban_records.select(c("ip").alias("remote_addr"), "event_id", "ts_us")
    source = in_time_order(rows.unionByName(known.withColumn("is_ban", F.lit(True)), allowMissingColumns=True), f"{folder}/in", batches)
    judged = detection_stream(source.where("not is_ban"), R.DEFAULT_ALLOW_IPS + R.DEFAULT_ALLOW_NETWORKS, bans=source.where("is_ban"),
                              rules={"risk_threshold": 30}, risk_level=geo_struct(c("remote_addr"))["risk_level"])
    sinks = jobs.Sinks(folder, {
        "requests": lambda b: b.select("event_id", "remote_addr", "ts_us", "request_count", "count_404", "risk_score"),
        "verdicts": lambda b: W.combined_verdict(b).select("event_id", "remote_addr", "ts_us", "reason"),
        "bans": lambda b: BA.ban_records(W.combined_verdict(b).withColumn("node_id", F.lit(None).cast("string")), 120)})
    jobs.start(judged, f"{folder}/state", sinks, every=None).awaitTermination()
    return folder, sinks


@query("st12_detection_stream", """
SELECT event_id, coalesce(attack_label, ban_reason) AS reason FROM decided WHERE attack_label IS NOT NULL OR ban_reason <> '未达到封禁条件'""")
def st12(d):
    return detection_job(d)[1].read(d.spark, "verdicts").select("event_id", "reason")


@query("st12_stored_requests", "SELECT event_id, request_count, count_404, round(risk_score, 6) AS risk_score FROM decided")
def st12b(d):
    return detection_job(d)[1].read(d.spark, "requests").select("event_id", "request_count", "count_404", F.round("risk_score", 6).alias("risk_score"))


@query("st12_bans", "SELECT ip, ts_us FROM st12_chain")
def st12c(d):
    """A second stream follows the ban records that the first one writes: an address is banned once until its ban ends."""
    folder, sinks = detection_job(d)
    records = sinks.read(d.spark, "bans").select("ip", "ts_us", "event_id", "duration_s")
    jobs.start(ban_stream(in_time_order(records, f"{folder}/triggers", 2)), f"{folder}/ban_state",
               jobs.table_sink(f"{folder}/started"), every=None).awaitTermination()
    return d.spark.read.parquet(f"{folder}/started").where("action = 'ban'").select("ip", "ts_us")


def _sent(d):
    return NO.rate_limited(NO.route_notifications(d.notifications, ["email", "dingtalk", "wechat"]))


@query("st04_notify_rate_limit", "SELECT channel, level, ts_us FROM st04_chain")
def st04(d):
    return _sent(d).select("channel", "level", "ts_us")


@query("st04_by_source", "SELECT event_id, event_id IN (SELECT event_id FROM st04b_chain) AS sent FROM notifications")
def st04b(d):
    return NO.rate_limited_by_source(d.notifications).select("event_id", "sent")


@query("ag33_notifier_statistics", "SELECT channel, level, max(ts_us) AS last_sent_us, count(*) AS n FROM st04_chain GROUP BY 1, 2")
def ag33(d):
    return NO.notifier_statistics(_sent(d))


@query("st05_sliding_rate_limiter", "SELECT event_id, allowed, 20 - len(ring) AS remaining FROM st05_fold WHERE event_id IS NOT NULL")
def st05(d):
    return GA.sliding_limit(d.access_log, ["remote_addr"], "ts_us", "event_id", 20, 10_000_000).select(
        "event_id", "allowed", "remaining")


@query("st06_ip_counters_ttl", """
SELECT substr(sha256(concat('pepper:', remote_addr)), 1, 16) AS ip_hash, min(ts_us) AS first_us, max(ts_us) AS last_seen_us, count(*) AS request_count, count(*) FILTER (WHERE status >= 400) AS error_count
FROM (SELECT *, sum(new) OVER (PARTITION BY remote_addr ORDER BY ts_us, event_id) AS sid FROM (
  SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY remote_addr ORDER BY ts_us, event_id) < 20000000 THEN 0 ELSE 1 END AS new FROM access_log) a) b GROUP BY remote_addr, sid""")
def st06(d):
    return ST.counters_ttl(d.access_log, 20, "pepper").select("ip_hash", "first_us", "last_seen_us", "request_count", "error_count")


@query("st08_state_eviction", f"SELECT remote_addr FROM access_log WHERE ts_us >= {END} - 60000000 GROUP BY 1")
def st08(d):
    return ST.evict_idle(ip_state(d), "last_seen_us", END, 60).select("remote_addr")


@query("st10_node_heartbeat", f"""
SELECT node_id, max(ts_us) AS last_heartbeat_us, arg_max(host, (ts_us, event_id)) AS host, max(ts_us) >= {END} - 30000000 AS online FROM heartbeats GROUP BY 1""")
def st10(d):
    return ST.node_registry(d.heartbeats, END, 30).select("node_id", "last_heartbeat_us", "host", "online")


@query("st11_micro_batch", "SELECT 'requests' AS sink, 4 AS flushes, count(*) AS n FROM access_log")
def st11(d):
    """Flushes are micro batches: the ledger of a stream that took the log in four."""
    ledger = sink_job(d)[1].ledger(d.spark).where("sink = 'requests'")
    return ledger.groupBy("sink").agg(F.count("*").alias("flushes"), F.sum("rows").alias("n"))


@query("st13_retrain_trigger", f"""
SELECT count(*) AS samples, count(*) >= 100 AND (count(*) >= 1000 OR 90000 >= 86400) AS retrain FROM access_log""")
def st13(d):
    return ST.retrain_needed(d.access_log, 90_000)


# -- sources and sinks -------------------------------------------------------------
def _append(lines, folder, sizes):
    """Each node appends its lines to its own file, as an agent's machine does.  A task that runs again cuts the file back first."""
    def write(rows):
        by_node = {}
        for r in rows:
            f = by_node.get(r.node)
            if f is None:
                path = f"{folder}/{r.node}.log"
                f = by_node[r.node] = open(path, "r+b" if os.path.exists(path) else "w+b")
                f.truncate(sizes.get(path, 0))
                f.seek(0, os.SEEK_END)
            f.write(r.value.encode() + b"\n")
        for f in by_node.values():
            f.close()

    lines.repartition("node").foreachPartition(write)
    return {p: os.path.getsize(p) for p in glob.glob(f"{folder}/*.log")}


def tail_job(d):
    """Four rounds of lines: there before the start (not read), added, added after all files were rotated, added.  The stream
    stops after each round and starts again from its checkpoint."""
    folder = _new_folder(d, "tail")
    if urlparse(folder).scheme not in ("", "file"):
        raise ValueError("log files are followed by path: spark.checkpoint.dir must be a mounted folder here")
    local = urlparse(folder).path
    os.makedirs(f"{local}/log")
    lines = d.raw_log.select("value", F.concat(F.lit("node-"), c("event_id") % 4).alias("node"), (c("event_id") % 10).alias("turn"))
    written = [lines.where("turn < 5"), lines.where("turn = 5 or turn = 6"), lines.where("turn = 7"), lines.where("turn > 7")]
    sizes = {}
    for i, part in enumerate(written):
        if i == 2:  # rotated: the files begin anew
            sizes = {}
        sizes = _append(part, f"{local}/log", sizes)
        stream = tail_files(d.spark, f"{local}/log/*.log", split=1 << 16).where(F.trim("value") != "")
        jobs.start(stream, f"{folder}/state", jobs.table_sink(f"{folder}/lines"), every=None).awaitTermination()
    return d.spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/lines")


@query("s01_tail_log_stream", """
SELECT concat('node-', event_id % 4) AS node, count(*) AS lines, CAST(sum(strlen(value)) AS BIGINT) AS bytes FROM raw_log WHERE event_id % 10 >= 5 GROUP BY 1""")
def s01(d):
    return read_counts(tail_job(d)).select(F.regexp_extract("file", r"([^/]+)\.log$", 1).alias("node"), "lines", "bytes")


@query("s01_tailed_lines", "SELECT value, count(*) AS n FROM raw_log WHERE event_id % 10 >= 5 GROUP BY 1")
def s01b(d):
    return tail_job(d).groupBy("value").agg(F.count("*").alias("n"))


@query("s02_batch_envelope", "SELECT event_id, node_id, remote_addr, request_uri, status FROM access_log")
def s02(d):
    return LO.flatten_envelopes(LO.make_envelopes(d.access_log)).select(
        "event_id", "node_id", "remote_addr", "request_uri", "status")


@query("s03_file_source", f"""
SELECT event_id, request_url FROM (SELECT event_id, regexp_extract(value, '"(\\S+) (\\S+) ', 2) AS request_url,
  epoch_us(strptime(replace(regexp_extract(value, '\\[([^\\]]+)\\]', 1), ' +0000', ''), '%d/%b/%Y:%H:%M:%S')) AS ts_us FROM clf_log) t WHERE ts_us >= {END} - 500000000""")
def s03(d):
    lines = d.clf_log
    since = F.timestamp_micros(F.lit(END - 500_000_000))
    return LO.parse_entries(lines, "combined", "web", since=since, keep=["event_id"]).select("event_id", "request_url")


def _entry_list(d):
    e = LO.parse_entries(d.clf_log, "combined", "web", keep=["event_id"])
    return e.select((-c("event_id")).alias("position"), F.to_json(F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "source", "level", "message",
        "ip_address", "user_agent", "request_method", "request_url", "response_status", "response_size",
        "extra_fields")).alias("value"))


@query("s04_list_source", "SELECT -event_id AS position, remote_addr AS ip_address, status AS response_status FROM access_log")
def s04(d):
    return LO.read_entry_list(_entry_list(d)).select("position", "ip_address", "response_status")


def _unreachable(b):
    raise ConnectionError("no such host")


def sink_job(d, most=3000):
    """The log as a stream of four micro batches to four sinks: all requests, errors, a list of the newest, and one that fails."""
    folder = _new_folder(d, "sinks")
    source = in_time_order(d.access_log, f"{folder}/in", 4)
    sinks = jobs.Sinks(folder, {
        "requests": lambda b: b.select("event_id", "node_id", "status"), "newest": lambda b: b.select("event_id", "ts_us"),
        "errors": lambda b: b.where("status >= 400").select("event_id", "status"), "lost": _unreachable},
        ["requests", "errors", "newest", "lost", "unknown"], {"newest": (most, "ts_us", "event_id")})
    jobs.start(source, f"{folder}/state", sinks, every=None).awaitTermination()
    return folder, sinks


@query("s05_capped_list_sink", "SELECT event_id FROM access_log ORDER BY ts_us DESC, event_id DESC LIMIT 3000")
def s05(d):
    return sink_job(d)[1].read(d.spark, "newest").select("event_id")


@query("s06_multi_source_union", """
SELECT source, request_url, count(*) AS n FROM (
 SELECT 'web' AS source, replace(request_uri, ' ', '%20') AS request_url FROM access_log UNION ALL SELECT 'api', request_uri FROM access_log WHERE event_id % 53 <> 0) t GROUP BY 1, 2""")
def s06(d):
    u, _ = LO.read_all_sources({"web": lambda: PA.parse_combined_entry(d.clf_log, "web"),
                                "api": lambda: PA.parse_json_entry(d.json_log, "api"),
                                "lost": lambda: d.spark.read.text(d.sf_dir + "/no-such-file"),
                                "broken": lambda: d.clf_log.select(F.raise_error(F.lit("unreadable")).cast("string").alias("value"))}, _new_folder(d, "sources"))
    return u.groupBy("source", "request_url").agg(F.count("*").alias("n"))


@query("s07_fan_out_sink", """
SELECT 'requests' AS sink, event_id FROM access_log UNION ALL SELECT 'errors', event_id FROM access_log WHERE status >= 400""")
def s07(d):
    """What the sinks hold afterwards; the failing one is without effect on them."""
    sinks = sink_job(d)[1]
    return sinks.read(d.spark, "requests").select(F.lit("requests").alias("sink"), "event_id").unionByName(
        sinks.read(d.spark, "errors").select(F.lit("errors").alias("sink"), "event_id"))


@query("s07_sink_results", """
SELECT sink, batches, ok, CASE WHEN ok THEN n END AS n FROM (
 SELECT 'requests' AS sink, 4 AS batches, true AS ok, count(*) AS n FROM access_log UNION ALL
 SELECT 'errors', 4, true, count(*) FILTER (WHERE status >= 400) FROM access_log UNION ALL SELECT 'lost', 4, false, count(*) FROM access_log) t""")
def s07b(d):
    ledger = sink_job(d)[1].ledger(d.spark).where("sink <> 'newest'")
    return ledger.groupBy("sink").agg(F.count("*").alias("batches"), F.bool_and("ok").alias("ok"), F.sum("rows").alias("n"))


@query("s08_access_log_sink", "SELECT event_id, node_id, CAST(strftime(make_timestamp(ts_us), '%Y-%m-%d') AS VARCHAR) AS date FROM access_log")
def s08(d):
    return SI.access_log_rows(d.access_log, END).select("event_id", "node_id", c("date").cast("string").alias("date"))


@query("s09_dead_letter_replay", "SELECT event_id, value FROM raw_log WHERE NOT regexp_matches(value, '\" \\d+ \\d+ \"')")
def s09(d):
    return PA.rejected_lines(d.raw_log, "combined").select("event_id", "value")


@query("s09_replayable", "SELECT event_id FROM json_log WHERE event_id % 53 <> 0 AND event_id % 5 < 3")
def s09b(d):
    letters = SI.dead_letters(d.json_log, END).withColumn("retry_count", (c("event_id") % 5).cast("int"))
    return SI.replayable(letters).select("event_id")


@query("s10_threat_list_source", "SELECT ip FROM malicious_ips")
def s10(d):
    lines = d.malicious_ips.select(F.concat(F.lit("  "), "ip", F.lit("\t")).alias("value")).unionByName(
        d.malicious_ips.select(F.lit("  ").alias("value")))
    return LO.clean_list(lines).withColumnRenamed("value", "ip")


@query("s11_ban_sink", "SELECT event_id, remote_addr AS ip, coalesce(attack_label, ban_reason) AS reason, 'pending' AS status FROM decided WHERE attack_label IS NOT NULL OR ban_reason <> '未达到封禁条件'")
def s11(d):
    from ..operators.windows import combined_verdict
    return BA.ban_records(combined_verdict(decided(d))).select("event_id", "ip", "reason", "status")


@query("s12_audit_sink", """
SELECT id, CASE WHEN indicators = '' THEN '[]' ELSE concat('["', replace(indicators, ',', '","'), '"]') END AS threat_indicators, concat('["', replace(tags, ',', '","'), '"]') AS compliance_tags FROM sec_events""")
def s12(d):
    return SI.audit_rows(sec_events(d)).select("id", "threat_indicators", "compliance_tags")


@query("s13_format_log_line", """
SELECT event_id, concat(remote_addr, ' - - [', strftime(make_timestamp(ts_us), '%d/%b/%Y:%H:%M:%S'), ' +0000] "', request_method, ' ', replace(request_uri, ' ', '%20'), ' HTTP/1.1" ', status, ' ',
  CASE WHEN event_id % 101 = 0 OR body_bytes_sent = 0 THEN '-' ELSE CAST(body_bytes_sent AS VARCHAR) END) AS clf,
 CASE WHEN event_id % 101 = 0 OR body_bytes_sent = 0 THEN NULL ELSE body_bytes_sent END AS json_size, http_user_agent <> '' AS has_agent, coalesce(http_referer, '') AS json_referer FROM access_log""")
def s13(d):
    e = LO.parse_entries(d.clf_log, "combined", "web", keep=["event_id"])
    j = PA.format_entry_json(e).withColumnRenamed("value", "js")
    out = PA.format_entry_clf(j)
    g = lambda k: F.get_json_object("js", k)
    return out.select("event_id", c("value").alias("clf"), g("$.size").try_cast("bigint").alias("json_size"),
                      g("$.user_agent").isNotNull().alias("has_agent"), g("$.referer").alias("json_referer"))


@query("s14_export_behaviour", "SELECT remote_addr, request_count, attack_count FROM ip_state WHERE NOT (remote_addr LIKE '10.%' OR remote_addr LIKE '192.168.%') ORDER BY risk_score DESC, remote_addr LIMIT 50")
def s14(d):
    return BE.top_risky(ip_state(d), allow_networks(d), 50).select("remote_addr", "request_count", "attack_count")


@query("s15_export_alerts", f"SELECT event_id FROM alerts WHERE ts_us BETWEEN {END} - 300000000 AND {END} - 100000000")
def s15(d):
    return SI.in_range(d.alerts, END - 300_000_000, END - 100_000_000).select("event_id")


@query("s16_export_perf", f"SELECT (SELECT count(*) FROM metrics WHERE ts_us >= {END} - 300000000) AS metrics_count, (SELECT count(*) FROM spans WHERE duration IS NOT NULL AND start_us >= {END} - 300000000) AS spans_count")
def s16(d):
    return SI.export_performance(d.metrics, d.spans, END - 300_000_000)[2]


@query("s17_training_io", "SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'sql_injection' ELSE 'normal' END AS label, CAST(length(request_uri) AS DOUBLE) AS url_length FROM access_log")
def s17(d):
    f = d.access_log.withColumn("url_length", F.length("request_uri")).withColumn(
        "y", F.when(c("event_id") % 23 == 0, "sql_injection").otherwise("normal"))
    s = SI.training_samples(f, "y", ["url_length"])
    return s.select("event_id", "label", c("features")["url_length"].alias("url_length"))


@query("s18_tenant_store", """
SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 'operator' ELSE role END AS role FROM users""")
def s18(d):
    u = d.users.withColumn("updated_us", c("created_us"))
    ch = u.where("user_id % 4 = 0").withColumn("role", F.lit("operator")).withColumn("updated_us", c("created_us") + 5)
    old = u.where("user_id % 4 = 1").withColumn("role", F.lit("stale")).withColumn("updated_us", c("created_us") - 5)
    return TE.merge_latest(u, ch.unionByName(old), "user_id", "updated_us").select("user_id", "role")


@query("s18_create_user", """
SELECT user_id FROM (SELECT r.user_id, t.max_users, (SELECT count(*) FROM users o WHERE o.tenant_id = r.tenant_id AND o.user_id % 2 = 0) + row_number() OVER (PARTITION BY r.tenant_id ORDER BY r.created_us, r.user_id) AS n
 FROM users r JOIN tenants t USING (tenant_id) WHERE r.user_id % 2 = 1) x WHERE n <= max_users""")
def s18b(d):
    u = d.users
    return TE.accept_users(u.where("user_id % 2 = 0"), u.where("user_id % 2 = 1"), d.tenants).select("user_id")
