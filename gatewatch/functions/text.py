"""System-log lines, keyword classes and message texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from .parse import strip
from .patterns import lookup
from .regex import any_word, java_pattern, let, settle

_ISO_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
_SLASH_LINE = r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})"
_SYSLOG_LINE = r"^(\w{3} \d{1,2} \d{2}:\d{2}:\d{2})"
_EVENT = r"\[([^\]]+)\]"
_V4 = r"\bIP\s+(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
_V6 = r"\b([0-9a-fA-F:]+::[0-9a-fA-F:]*|[0-9a-fA-F:]+:[0-9a-fA-F:]+:[0-9a-fA-F:]+)\b"
_LEVEL = r"- (DEBUG|INFO|WARNING|ERROR|CRITICAL) -"
_MESSAGE = r'"message":\s*"([^"]+)"'


def _first_group(text: Column, pattern: str) -> Column:
    """First match, NULL when there is none (the group itself cannot match nothing)."""
    return F.nullif(F.regexp_extract(text, java_pattern(pattern), 1), F.lit(""))


def parse_system_log(df: DataFrame, as_of: Column, line: str = "value", keep=()) -> DataFrame:
    """JSON or plain system-log lines to events; lines without a readable time are dropped.

    ``as_of`` supplies the year of syslog-style times and the time of JSON lines without one.
    A line that opens with a bracketed time is never readable, and a line without a bracketed
    type that says "unbanned" is typed as a ban: both are rules of the format, kept on purpose.
    """
    t, low, m = F.col("_t"), F.col("_low"), F.col("_m")
    df = df.withColumn("_t", strip(F.col(line))).where(t != "").withColumn("_low", F.lower(t)).withColumn(
        "_m", F.when(t.startswith("{") & t.endswith("}"), F.from_json(t, "map<string,string>")))
    is_json = m.isNotNull()
    raw = m["timestamp"]
    json_ts = F.coalesce(
        F.when(raw.contains("T"), F.try_to_timestamp(F.regexp_replace(raw, "Z$", "+00:00")))
         .otherwise(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm:ss"))), as_of)
    iso, slash, syslog = (_first_group(t, p) for p in (_ISO_LINE, _SLASH_LINE, _SYSLOG_LINE))
    plain_ts = (F.when(iso.isNotNull(), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd HH:mm:ss")))
                 .when(slash.isNotNull(), F.try_to_timestamp(slash, F.lit("yyyy/MM/dd HH:mm:ss")))
                 .when(syslog.isNotNull(), F.try_to_timestamp(
                     F.concat(F.year(as_of).cast("string"), F.lit(" "), syslog),
                     F.lit("yyyy MMM d HH:mm:ss"))))
    etype = F.coalesce(_first_group(t, _EVENT), *[F.when(low.contains(w), F.lit(e))
                                                  for w, e in R.SYSTEM_EVENT_WORDS], F.lit("unknown"))
    level = F.coalesce(_first_group(t, _LEVEL), *[F.when(low.contains(v.lower()), F.lit(v))
                                                  for v in R.LOG_LEVELS], F.lit("INFO"))
    ip = F.coalesce(_first_group(t, _V4), _first_group(t, _V6))
    some = lambda k: F.nullif(m[k], F.lit(""))
    # a key that is present with null stays null, a missing key takes the default
    pick = lambda k, d: F.when(F.map_contains_key(m, k), m[k]).otherwise(d)
    out = settle(df, list(keep), {
        "timestamp": F.when(is_json, json_ts).otherwise(plain_ts),
        "event_type": F.when(is_json, pick("event_type", F.lit("unknown"))).otherwise(etype),
        "level": F.when(is_json, pick("level", F.lit("INFO"))).otherwise(level),
        "ip_address": F.when(is_json, F.coalesce(some("ip"), m["ip_address"])).otherwise(ip),
        "message": F.when(is_json, pick("message", t)).otherwise(F.coalesce(_first_group(t, _MESSAGE), t)),
        "raw_line": t, "structured": is_json, "data": m})
    return out.where(F.col("timestamp").isNotNull())


def _classes(text: Column, classes, default: str) -> Column:
    out = None
    for label, words in classes:
        hit = any_word(text, words)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def ban_reason(message: Column) -> Column:
    """An explicit reason of more than two characters, else a keyword class."""
    def explicit(msg, p):
        got = strip(F.regexp_extract(msg, java_pattern(p, True), 1))
        return let(got, lambda g: F.when(F.length(g) > 2, g))

    def pick(msg):
        found = [explicit(msg, p) for p in R.BAN_REASON_PATTERNS]
        return F.when(msg == "", "Unknown").otherwise(F.coalesce(
            *found, let(F.lower(msg), lambda low: _classes(low, R.BAN_REASON_CLASSES, "Unknown"))))

    return let(F.coalesce(strip(message), F.lit("")), pick)


def attack_type_label(message: Column) -> Column:
    msg = F.coalesce(message, F.lit(""))
    return F.when(strip(msg) == "", "Other").otherwise(
        let(F.lower(msg), lambda low: _classes(low, R.ATTACK_TYPE_CLASSES, "Other")))


def attack_severity(message: Column, level: Column) -> Column:
    """Level gives the base; critical words win, high and medium words only lift, low words force."""
    low, lev = F.lower(message), F.lower(level)
    base = (F.when(lev.isin("critical", "fatal"), "critical").when(lev == "error", "high")
             .when(lev == "warning", "medium").otherwise("low"))
    return (F.when(message.isNull() | level.isNull(), "medium")
             .when(any_word(low, R.SEVERITY_CRITICAL_WORDS), "critical")
             .when(any_word(low, R.SEVERITY_HIGH_WORDS),
                   F.when(base.isin("low", "medium"), "high").otherwise(base))
             .when(any_word(low, R.SEVERITY_MEDIUM_WORDS),
                   F.when(base == "low", "medium").otherwise(base))
             .when(any_word(low, R.SEVERITY_LOW_WORDS), "low").otherwise(base))


def hour_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:00")


def format_duration(seconds: Column) -> Column:
    """Whole units, rounded down."""
    u = R.DURATION_UNITS
    unit = lambda d, name: F.concat(F.floor(seconds / d).cast("string"), F.lit(u[name]))
    return (F.when(seconds < 60, unit(1, "second")).when(seconds < 3600, unit(60, "minute"))
             .when(seconds < 86400, unit(3600, "hour")).otherwise(unit(86400, "day")))


def format_ban_minutes(minutes: Column) -> Column:
    """Minutes with a remainder: days and hours, or hours and minutes."""
    u = R.DURATION_UNITS
    s = lambda c: F.floor(c).cast("string")
    return (F.when(minutes >= 1440, F.concat(s(minutes / 1440), F.lit(u["day"]),
                                             s((minutes % 1440) / 60), F.lit(u["hour"])))
             .when(minutes >= 60, F.concat(s(minutes / 60), F.lit(u["hour"]),
                                           (minutes % 60).cast("string"), F.lit(u["minute"])))
             .otherwise(F.concat(minutes.cast("string"), F.lit(u["minute"]))))


def ban_message(ip: Column, minutes: Column, reason: Column) -> Column:
    return F.concat(F.lit("IP "), ip, F.lit(" has been banned for "), format_ban_minutes(minutes),
                    F.lit(": "), reason)


def unban_message(ip: Column, reason: Column) -> Column:
    return F.concat(F.lit("IP "), ip, F.lit(" has been unbanned"),
                    F.coalesce(F.concat(F.lit(": "), F.nullif(reason, F.lit(""))), F.lit("")))


def attack_message(ip: Column, attack: Column, severity: Column) -> Column:
    return F.concat(lookup(severity, R.SEVERITY_MARK, ""), F.lit(" Attack detected from IP "), ip,
                    F.lit(": "), attack, F.lit(" (severity: "), severity, F.lit(")"))


def system_message(event: Column, status: Column, component: Column) -> Column:
    return F.concat(lookup(status, R.STATUS_MARK, ""), F.lit(" System event: "), event, F.lit(" ("),
                    status, F.lit(")"), F.coalesce(F.concat(F.lit(" in "), component), F.lit("")))


def severity_level(severity: Column) -> Column:
    return lookup(severity, R.SEVERITY_LOG_LEVEL, "INFO")


def status_level(status: Column) -> Column:
    return lookup(status, R.STATUS_LOG_LEVEL, "INFO")


def structured_message(etype: Column, message: Column, fields: Column) -> Column:
    """``[type] message | k=v, k=v``; the bar only when there are fields."""
    pairs = F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(
        e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None")))), ", ")
    head = F.concat(F.lit("["), etype, F.lit("] "), message)
    return F.when(F.coalesce(F.size(fields), F.lit(0)) > 0, F.concat(head, F.lit(" | "), pairs)) \
            .otherwise(head)


def threshold_excess(value: Column, threshold: Column) -> dict[str, Column]:
    exceeded = F.coalesce(value > threshold, F.lit(False))
    return {"threshold_exceeded": exceeded,
            "threshold_exceeded_percentage": F.when(
                threshold > 0, F.round((value - threshold) / threshold * 100, 2)),
            "level": F.when(exceeded, "WARNING").otherwise("INFO")}


def system_event_level(etype: Column) -> Column:
    low = F.lower(etype)
    return (F.when(low.contains("error") | low.contains("fail"), "error")
             .when(low.contains("warn"), "warning").otherwise("info"))


def notification_text(kind: str, d: dict[str, Column]) -> tuple[Column, Column]:
    """(title, body) of the ban, unban, attack and system templates.  ``d`` holds the fields."""
    g = lambda k, dflt="Unknown": F.coalesce(d[k], F.lit(dflt)) if k in d else F.lit(dflt)
    line = lambda label, c: F.concat(F.lit(label + ": "), c)
    where = [line("服务器", g("hostname")), line("节点ID", g("node_id")), line("地区", g("region"))]
    if kind == "ban":
        title = F.concat(F.lit("IP封禁通知 - "), d["ip"])
        body = [line("IP地址", d["ip"]), line("封禁原因", d["reason"]),
                line("封禁时长", format_duration(d["duration"])), *where, F.lit(""),
                F.lit("请注意监控该IP的后续行为。")]
    elif kind == "unban":
        title = F.concat(F.lit("IP解封通知 - "), d["ip"])
        body = [line("IP地址", d["ip"]), line("解封原因", d["reason"]), *where, F.lit(""),
                F.lit("IP已从封禁列表中移除。")]
    elif kind == "attack":
        title = F.concat(F.lit("攻击检测 - "), g("type"))
        body = [line("攻击IP", g("ip")), line("攻击类型", g("type")), line("攻击路径", g("path")),
                line("用户代理", g("user_agent")), line("服务器", g("server")),
                line("检测时间", g("timestamp")), F.lit(""), F.lit("建议立即检查服务器安全状态。")]
    else:
        title = F.concat(F.lit("系统事件 - "), d["event_type"])
        body = [line("事件类型", d["event_type"]), line("服务器", g("server")),
                line("节点ID", g("node_id")), line("事件时间", g("timestamp")), F.lit(""),
                F.lit("详细信息:"), g("message", "无详细信息")]
    return title, F.concat_ws("\n", *body)
