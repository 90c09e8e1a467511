"""Per-row request classifiers, generated from the rule tables."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from .factors import factors, first_rule
from .regex import any_word, can_combine, count_chars, is_valid, java_pattern, let, search

_FIELDS = [("URI", "request_uri"), ("User-Agent", "http_user_agent"), ("Referer", "http_referer")]
#: Rule sets up to this length are tried rule by rule behind one combined match.
FEW_RULES = 40
_HIT = "array<struct<attack_type:string,field:string,pattern:string>>"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _maybe(patterns: list[str]) -> Column:
    """One combined match per field: false means that no single pattern matches any field.  Patterns must not name
    groups or refer to them, as combining shifts group numbers."""
    both = java_pattern("|".join(f"(?:{p})" for p in patterns), True)
    out = F.lit(False)
    for _, c in _FIELDS:
        out = out | _text(c).rlike(both)
    return out


def suspicious_hits() -> Column:
    """Every (type, field, pattern) that matches.  Clean rows cost one combined match."""
    cells = [F.when(search(_text(col), pat, ic),
                    F.struct(F.lit(kind).alias("attack_type"), F.lit(label).alias("field"),
                             F.lit(pat).alias("pattern")))
             for kind, pat, ic in R.SUSPICIOUS_PATTERNS for label, col in _FIELDS]
    return (F.when(_maybe([p for _, p, _ in R.SUSPICIOUS_PATTERNS]), F.array_compact(F.array(*cells)))
             .otherwise(F.lit(None).cast(_HIT)))


def suspicious_request(df, max_bytes: int = 10 * 1024 * 1024, max_seconds: float = 30.0):
    """Adds hits, attack_types, is_suspicious, risk_score and the status / size / time details."""
    status = F.coalesce(F.col("status"), F.lit(200))
    large = F.coalesce(F.col("body_bytes_sent"), F.lit(0)) > max_bytes
    slow = F.coalesce(F.col("request_time"), F.lit(0.0)) > max_seconds
    n = F.coalesce(F.size("hits"), F.lit(0))
    return (df.withColumn("hits", F.coalesce(suspicious_hits(), F.array().cast(_HIT)))
              .withColumn("attack_types",
                          F.array_distinct(F.transform("hits", lambda h: h["attack_type"])))
              .withColumn("is_suspicious", n > 0)
              .withColumn("risk_score", (n * 10 + F.when(status >= 400, 5).otherwise(0)
                                         + F.when(large, 15).otherwise(0)
                                         + F.when(slow, 10).otherwise(0)).cast("bigint"))
              .withColumn("status_detail", F.when(status == 404, "status_404")
                          .when(status >= 500, "server_error"))
              .withColumn("large_response", large).withColumn("slow_request", slow))


def is_bot(ua: Column) -> Column:
    return any_word(F.lower(F.coalesce(ua, F.lit(""))), R.BOT_WORDS)


def first_attack_match(attack_rules=None) -> Column:
    """Label ``type:pattern`` of the first hit: rule order, then pattern, then uri / ua / referer.

    All fields of one pattern share a label, so field order cannot change the result and the
    fields are matched side by side.  Unusable patterns are skipped.
    """
    rules = [(k, p) for k, on, ps in (attack_rules or R.DEFAULT_ATTACK_RULES) if on
             for p in ps if is_valid(p)]
    if not rules:
        return F.lit(None).cast("string")
    if len(rules) > FEW_RULES or not all(can_combine(p) for _, p in rules):
        return _first_of_many(rules)
    return F.when(_maybe([p for _, p in rules]), F.coalesce(*[F.when(_any_field(p), F.lit(f"{k}:{p}")) for k, p in rules]))


def _any_field(pattern: str) -> Column:
    return (search(_text("request_uri"), pattern, True) | search(_text("http_user_agent"), pattern, True)
            | search(_text("http_referer"), pattern, True))


def _first_of_many(rules: list[tuple[str, str]]) -> Column:
    """Rules with factors are tried where a factor occurs.  Of the rest, those that combine are tried where their
    combined match succeeds, and rules with back-references always."""
    patterns = {i: p for i, (_, p) in enumerate(rules)}
    needs = {i: f for i, p in patterns.items() if (f := factors(p))}
    rest = [i for i in patterns if i not in needs]
    plain = [i for i in rest if can_combine(patterns[i])]

    def number(of: list[int]) -> Column:
        return F.coalesce(*[F.when(_any_field(patterns[i]), F.lit(i)) for i in of])

    found = []
    if needs:
        found.append(first_rule([_text(col) for _, col in _FIELDS], {i: patterns[i] for i in needs}, needs))
    if plain:
        found.append(F.when(_maybe([patterns[i] for i in plain]), number(plain)))
    if len(plain) < len(rest):
        found.append(number([i for i in rest if i not in plain]))
    labels = F.from_json(F.lit(json.dumps([f"{k}:{p}" for k, p in rules])), "array<string>")
    return F.get(labels, F.least(*found) if len(found) > 1 else found[0])


def ua_analysis(ua: Column) -> dict[str, Column]:
    """Tool words, empty or short text, markup characters."""
    ua = F.coalesce(ua, F.lit(""))
    low = F.lower(ua)
    tools = F.filter(F.array(*[F.lit(w) for w in R.TOOL_WORDS]), lambda w: F.contains(low, w))
    short = F.length(ua) < 10
    marks = ua.rlike("[<>\"';]")
    found = F.array_compact(F.array(F.when(short, F.lit("empty_or_short")),
                                    F.when(marks, F.lit("special_characters"))))
    score = F.size(tools) * 10 + F.when(short, 5).otherwise(0) + F.when(marks, 8).otherwise(0)
    return {"ua_indicators": F.concat(tools, found), "ua_score": score.cast("bigint"),
            "ua_suspicious": score > 0}


def payload_analysis(uri: Column) -> dict[str, Column]:
    uri = F.coalesce(uri, F.lit(""))
    pct = count_chars(uri, "%")
    dense = count_chars(uri, R.PAYLOAD_SPECIALS) > F.length(uri) * F.lit(0.3)
    long = F.length(uri) > 1000
    score = (F.when(long, 10).otherwise(0) + F.when(pct > 10, pct).otherwise(0)
             + F.when(dense, 12).otherwise(0))
    return {"payload_features": F.array_compact(F.array(
                F.when(long, F.lit("long_uri")), F.when(pct > 10, F.lit("excessive_encoding")),
                F.when(dense, F.lit("high_special_char_density")))),
            "payload_score": score.cast("bigint"), "payload_suspicious": score > 0}


def is_sensitive(uri: Column) -> Column:
    return any_word(F.lower(uri), R.SENSITIVE_PATHS)


def threat_indicators(path: Column, body: Column) -> Column:
    """Types whose patterns occur in ``path + ' ' + body``."""
    text = F.concat(F.coalesce(path, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))

    def found(t: Column) -> Column:
        cells = []
        for kind, pats in R.THREAT_PATTERNS:
            hit = search(t, pats[0], True)
            for p in pats[1:]:
                hit = hit | search(t, p, True)
            cells.append(F.when(hit, F.lit(kind)))
        return F.array_compact(F.array(*cells))

    return let(text, found)


def event_type(indicators: Column, given: Column, status: Column) -> Column:
    out = None
    for ind, etype in R.INDICATOR_EVENT_TYPE:
        hit = F.array_contains(indicators, ind)
        out = F.when(hit, etype) if out is None else out.when(hit, etype)
    return (out.when(given.isin(R.EVENT_TYPES), given)
               .when(status == 401, "login_failure").when(status == 403, "unauthorized_access")
               .otherwise("suspicious_activity"))


def security_level(indicators: Column, status: Column) -> Column:
    has = lambda *w: F.arrays_overlap(indicators, F.array(*[F.lit(x) for x in w]))
    return (F.when(has("sql_injection", "command_injection"), "high")
             .when(has("xss", "directory_traversal"), "medium")
             .when(status >= 500, "medium").when(status >= 400, "low").otherwise("info"))


def compliance_tags(etype: Column) -> Column:
    return F.array_compact(F.array(
        F.lit("iso27001"), F.when(etype.isin(R.PCI_EVENT_TYPES), F.lit("pci_dss")),
        F.when(etype.isin(R.GDPR_EVENT_TYPES), F.lit("gdpr"))))


def lookup(col: Column, table: dict, default) -> Column:
    """A small fixed table as CASE WHEN."""
    out = None
    for k, v in table.items():
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return out.otherwise(F.lit(default))


def threat_score(etype: Column, malicious: Column, indicators: Column, level: Column) -> Column:
    s = (lookup(etype, R.THREAT_BASE_SCORES, R.THREAT_DEFAULT_SCORE)
         + F.when(malicious, 20).otherwise(0) + F.size(indicators) * 5
         + lookup(level, R.LEVEL_SCORES, 0))
    return F.least(s, F.lit(100)).cast("double")


def _json_text(c: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def iso_text(ts: Column) -> Column:
    """ISO time; the fraction is left out when it is zero."""
    return F.when(F.unix_micros(ts) % 1000000 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")) \
            .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def event_checksum(id_: Column, etype: Column, ts: Column, ip: Column, description: Column) -> Column:
    """sha256 over the sorted-key JSON of the five identifying fields."""
    quoted = lambda c: let(_json_text(c), lambda j: F.when(
        j.rlike(r"^\p{ASCII}*$"), j).otherwise(
            F.array_join(F.transform(F.sequence(F.lit(1), F.length(j)),
                                     lambda i: _escape(F.substr(j, i, F.lit(1)))), "")))
    doc = F.concat(F.lit('{"description": '), quoted(description), F.lit(', "event_type": '),
                   quoted(etype), F.lit(', "id": '), quoted(id_), F.lit(', "source_ip": '),
                   quoted(ip), F.lit(', "timestamp": "'), iso_text(ts), F.lit('"}'))
    return F.sha2(doc, 256)


def _escape(ch: Column) -> Column:
    """One character as JSON escapes unless ASCII; UTF-16 units, so pairs for the upper planes."""
    units = F.hex(F.encode(ch, "UTF-16BE"))
    esc = F.lower(F.regexp_replace(units, "(.{4})", r"\\u$1"))
    return F.when(ch.rlike(r"^\p{ASCII}*$"), ch).otherwise(esc)


def request_fingerprint(uri: Column, ua: Column, method: Column) -> Column:
    return F.md5(F.concat_ws(":", uri, ua, method))
