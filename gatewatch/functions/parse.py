"""Log lines to typed columns.

Each parser is a projection over one string column, so a scan, a stream and a
test frame all use the same expressions and stay inside generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regex import java_pattern, match_groups, named_groups, settle

_HEAD = r'(\S+) - (\S+) \[([^\]]+)\] "([^"]+)" (\d+) (\d+)'
_QUOTED = r' "([^"]+)" "([^"]+)"'
# format name -> (pattern, column per group)
FORMATS = {
    "common": (_HEAD, ["remote_addr", "remote_user", "time_local", "request", "status",
                       "body_bytes_sent"]),
    "combined": (_HEAD + _QUOTED, ["remote_addr", "remote_user", "time_local", "request", "status",
                                   "body_bytes_sent", "http_referer", "http_user_agent"]),
    "custom": (_HEAD + _QUOTED + r" (\S+) (\S+)",
               ["remote_addr", "remote_user", "time_local", "request", "status",
                "body_bytes_sent", "http_referer", "http_user_agent", "request_time",
                "upstream_response_time"]),
}


# every character Python's str.strip() removes
WHITESPACE = "".join(chr(i) for r in (range(9, 14), range(28, 33), (0x85, 0xA0, 0x1680), range(0x2000, 0x200B),
                                      (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)) for i in r)


def strip(c: Column) -> Column:
    """Trim all whitespace, not only blanks."""
    return F.btrim(c, F.lit(WHITESPACE))


def _matched(df: DataFrame, line: str, pattern: str, n: int) -> DataFrame:
    """Lines that start with the pattern, as ``_t`` (stripped text) and ``_g`` (its groups)."""
    java = java_pattern(f"^(?:{pattern})")
    d = df.withColumn("_t", strip(F.col(line))).where(F.col("_t").rlike(java))
    return d.withColumn("_g", match_groups(F.col("_t"), pattern, n))


def extract_groups(df: DataFrame, line: str, pattern: str, names: dict[str, int],
                   keep: list[str] = ()) -> DataFrame:
    """Keep lines whose start matches; one column per wanted group.  ``pattern`` has no ``^``."""
    d = _matched(df, line, pattern, re.compile(pattern).groups)
    d = settle(d, list(keep), {"_g": F.col("_g")})
    return d.select(*keep, *[F.col("_g")[i - 1].alias(n) for n, i in names.items()])


def parse_access(df: DataFrame, fmt: str = "combined", line: str = "value",
                 keep: list[str] = ()) -> DataFrame:
    """Access log of a named format, or of any pattern with named groups; bad lines are dropped."""
    if fmt in FORMATS:
        pattern, cols = FORMATS[fmt]
        names = {c: i + 1 for i, c in enumerate(cols)}
    else:
        pattern, names = named_groups(fmt)
    return post_process(extract_groups(df, line, pattern, names, list(keep)))


def rejected_lines(df: DataFrame, fmt: str = "combined", line: str = "value") -> DataFrame:
    """The lines ``parse_access`` drops, blank ones apart: the quarantine side."""
    pattern = FORMATS[fmt][0] if fmt in FORMATS else named_groups(fmt)[0]
    text = strip(F.col(line))
    return df.where((text != "") & ~text.rlike(java_pattern("^" + pattern)))


def post_process(df: DataFrame) -> DataFrame:
    """Derived request columns and typed numbers for whichever columns the format has."""
    have = set(df.columns)
    if "time_local" in have:
        df = df.withColumn("timestamp", log_timestamp(F.col("time_local")))
    if "request" in have:
        df = split_request(df)
    for c in ("status", "body_bytes_sent"):
        if c in have:
            df = df.withColumn(c, F.col(c).try_cast("bigint"))
    for c in ("request_time", "upstream_response_time"):
        if c in have:
            df = df.withColumn(c, F.col(c).try_cast("double"))
    for c in ("remote_user", "http_referer"):
        if c in have:
            df = df.withColumn(c, F.nullif(F.col(c), F.lit("-")))
    return df


def log_timestamp(c: Column) -> Column:
    """``27/Aug/2023:10:30:45 +0800``, with or without the zone; NULL when neither fits."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("d/MMM/yyyy:HH:mm:ss Z")),
                      F.try_to_timestamp(c, F.lit("d/MMM/yyyy:HH:mm:ss XXX")),
                      F.try_to_timestamp(c, F.lit("d/MMM/yyyy:HH:mm:ss")))


def split_request(df: DataFrame, request: str = "request") -> DataFrame:
    """Method, uri and protocol; what follows the second blank is protocol, raw blanks included."""
    piece = lambda i: F.coalesce(F.try_element_at("_p", F.lit(i)), F.lit(""))
    df = df.withColumn("_p", F.split(F.col(request), " ", 3)).withColumns(
        {"request_method": piece(1), "request_uri": piece(2), "request_protocol": piece(3)}).drop("_p")
    return split_uri(df)


def uri_parts(uri: Column) -> dict[str, Column]:
    """path / query / fragment of a URI reference; parameters are cut off the last path segment."""
    plain = uri.startswith("/") & ~uri.startswith("//")
    scheme = F.when(uri.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), F.regexp_replace(uri, "^[^:]*:", "")).otherwise(uri)
    rest = F.when(plain, uri).otherwise(F.regexp_replace(scheme, r"^//[^/?#]*", ""))
    after = lambda t, ch: F.when(t.contains(ch), F.substr(t, F.locate(ch, t) + F.lit(1))).otherwise("")
    head = F.substring_index(rest, "#", 1)
    path = F.substring_index(head, "?", 1)
    return {
        "request_path": F.when(path.contains(";"), F.regexp_replace(path, r";[^/]*$", "")).otherwise(path),
        "request_query": after(head, "?"),
        "request_fragment": after(rest, "#"),
    }


def split_uri(df: DataFrame, uri: str = "request_uri") -> DataFrame:
    """The three parts, NULL where the uri is empty."""
    for name, c in uri_parts(F.col(uri)).items():
        df = df.withColumn(name, F.when(F.col(uri) != "", c))
    return df


# -- entries of the generic model -------------------------------------------------
ENTRY_COLUMNS = ["timestamp", "source", "level", "message", "ip_address", "user_agent",
                 "request_method", "request_url", "response_status", "response_size",
                 "extra_fields"]
_CLF = r'(\S+) - - \[([^\]]+)\] "(\S+) (\S+) (\S+)" (\d+) (\d+|-)'


def _entry(df: DataFrame, source: str, keep, **cols) -> DataFrame:
    empty = F.lit(None).cast("map<string,string>")
    defaults = {c: F.lit(None).cast("string") for c in ENTRY_COLUMNS}
    defaults.update(source=F.lit(source), level=F.lit("INFO"), extra_fields=empty,
                    timestamp=F.lit(None).cast("timestamp"),
                    response_status=F.lit(None).cast("bigint"),
                    response_size=F.lit(None).cast("bigint"))
    defaults.update(cols)
    return df.select(*keep, *[defaults[c].alias(c) for c in ENTRY_COLUMNS])


def parse_clf_entry(df: DataFrame, source: str, line: str = "value", keep=()) -> DataFrame:
    """``ip - - [ts] "m u p" status size`` to entries; an unreadable time is NULL."""
    return _clf(df, source, line, keep, _CLF, combined=False)


def parse_combined_entry(df: DataFrame, source: str, line: str = "value", keep=()) -> DataFrame:
    """As above plus referer (extra field) and user agent, both possibly empty."""
    return _clf(df, source, line, keep, _CLF + r' "([^"]*)" "([^"]*)"', combined=True)


def _clf(df, source, line, keep, pattern, combined):
    g = lambda i: F.col("_g")[i - 1]
    extra = {}
    if combined:
        extra = {"user_agent": g(9), "extra_fields": F.create_map(F.lit("referer"), g(8))}
    d = _matched(df, line, pattern, 9 if combined else 7)
    return _entry(d, source, keep,
                  timestamp=F.coalesce(F.try_to_timestamp(g(2), F.lit("d/MMM/yyyy:HH:mm:ss Z")),
                                       F.try_to_timestamp(g(2), F.lit("d/MMM/yyyy:HH:mm:ss XXX"))),
                  message=F.col("_t"), ip_address=g(1), request_method=g(3), request_url=g(4),
                  response_status=g(6).try_cast("bigint"),
                  response_size=F.nullif(g(7), F.lit("-")).try_cast("bigint"), **extra)


_KNOWN_KEYS = ["timestamp", "time", "@timestamp", "level", "message", "ip", "remote_addr",
               "user_agent", "method", "url", "path", "status", "size"]


def parse_json_entry(df: DataFrame, source: str, line: str = "value", keep=()) -> DataFrame:
    """JSON lines; the first *present* alias wins even when it is null; bad JSON is dropped."""
    text = F.col("_t")
    d = df.withColumn("_t", strip(F.col(line))).where(text.startswith("{"))
    d = d.withColumn("_m", F.from_json(text, "map<string,string>")).where("_m is not null")
    m = F.col("_m")

    def pick(default, *keys):
        out = default
        for k in reversed(keys):
            out = F.when(F.map_contains_key(m, k), m[k]).otherwise(out)
        return out

    null = F.lit(None).cast("string")
    known = F.array(*[F.lit(k) for k in _KNOWN_KEYS])
    return _entry(d, source, keep,
                  timestamp=F.try_to_timestamp(
                      F.regexp_replace(pick(null, "timestamp", "time", "@timestamp"), "Z$", "+00:00")),
                  level=pick(F.lit("INFO"), "level"), message=pick(text, "message"),
                  ip_address=pick(null, "ip", "remote_addr"), user_agent=pick(null, "user_agent"),
                  request_method=pick(null, "method"), request_url=pick(null, "url", "path"),
                  response_status=pick(null, "status").try_cast("bigint"),
                  response_size=pick(null, "size").try_cast("bigint"),
                  extra_fields=F.map_filter(m, lambda k, v: ~F.array_contains(known, k)))


def parse_custom_entry(df: DataFrame, source: str, pattern: str, line: str = "value",
                       as_of: Column | None = None, keep=()) -> DataFrame:
    """A configured pattern with named groups; all groups also become extra fields."""
    positional, names = named_groups(pattern)
    d = _matched(df, line, positional, re.compile(positional).groups)
    got = {n: F.col("_g")[i - 1] for n, i in names.items()}
    null = F.lit(None).cast("string")
    return _entry(d, source, keep,
                  timestamp=as_of if as_of is not None else F.lit(None).cast("timestamp"),
                  message=F.col("_t"), ip_address=got.get("ip", null),
                  user_agent=got.get("user_agent", null), request_method=got.get("method", null),
                  request_url=got.get("url", null),
                  response_status=got.get("status", null).try_cast("bigint"),
                  extra_fields=F.create_map(*[x for n, c in got.items() for x in (F.lit(n), c)]))


ENTRY_PARSERS = {
    "common": parse_clf_entry, "combined": parse_combined_entry, "nginx": parse_combined_entry,
    "apache": parse_combined_entry, "json": parse_json_entry,
}


def format_entry_json(df: DataFrame) -> DataFrame:
    """Entries as JSON lines: optional fields only when they hold something, extras merged in."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    nonzero = lambda c: F.when(F.col(c) != 0, F.col(c))
    base = F.to_json(F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "source",
        "level", "message", some("ip_address").alias("ip"), some("user_agent").alias("user_agent"),
        some("request_method").alias("method"), some("request_url").alias("url"),
        nonzero("response_status").alias("status"), nonzero("response_size").alias("size")))
    extra = F.to_json("extra_fields")
    merged = F.concat(F.expr("left(_b, length(_b) - 1)"), F.lit(","), F.expr("substring(_x, 2)"))
    return (df.withColumn("_b", base).withColumn("_x", extra)
              .withColumn("value", F.when(F.coalesce(F.size("extra_fields"), F.lit(0)) > 0, merged)
                          .otherwise(F.col("_b"))).drop("_b", "_x"))


def format_entry_clf(df: DataFrame) -> DataFrame:
    """Entries as CLF lines, ``-`` for what is missing (a zero status or size counts as missing)."""
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))
    num = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)).cast("string"), F.lit("-"))
    return df.withColumn("value", F.concat(
        dash("ip_address"), F.lit(" - - ["), F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss Z"),
        F.lit('] "'), dash("request_method"), F.lit(" "), dash("request_url"),
        F.lit(' HTTP/1.1" '), num("response_status"), F.lit(" "), num("response_size")))
