"""The main path as one plan: raw line -> row -> allow-list -> verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.parse import parse_access
from ..operators.addresses import drop_configured
from ..operators.windows import detect
from . import fixtures as fx
from . import oracle_views as O
from .registry import query

_LINE = r'^(\S+) - \S+ \[([^\]]+)\] "(\S*) (\S*)[^"]*" (\d+) \d+ "[^"]+" "([^"]+)"'


def requests_from_lines(lines: DataFrame) -> DataFrame:
    """Parsed lines in the shape the detection operators take."""
    rows = parse_access(lines, "combined", keep=["event_id"])
    return rows.where("timestamp is not null").withColumn("ts_us", F.unix_micros("timestamp")).drop("timestamp")


def verdicts(lines: DataFrame) -> DataFrame:
    """Lines to requests with their verdict: one scan, one shuffle on (address, time slice)."""
    rows = drop_configured(requests_from_lines(lines), R.DEFAULT_ALLOW_IPS + R.DEFAULT_ALLOW_NETWORKS)
    # only what the rules read goes through the shuffle
    return detect(rows.select("event_id", "remote_addr", "ts_us", "request_method", "request_uri", "status",
                              "http_user_agent", "http_referer"))


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(fx.view(spark, sf_dir, "raw_log"))
    kind = F.coalesce(F.substring_index("attack_label", ":", 1), F.lit("clean"))
    return v.groupBy("remote_addr", kind.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


# log lines carry whole seconds, so rows of one second see each other
_ROWS = f"""SELECT event_id, regexp_extract(value, '{_LINE}', 1) AS remote_addr,
  epoch_us(strptime(replace(regexp_extract(value, '{_LINE}', 2), ' +0000', ''), '%d/%b/%Y:%H:%M:%S')) AS ts_us, regexp_extract(value, '{_LINE}', 4) AS request_uri,
  CAST(regexp_extract(value, '{_LINE}', 5) AS BIGINT) AS status, regexp_extract(value, '{_LINE}', 6) AS http_user_agent, '' AS http_referer
 FROM raw_log WHERE regexp_matches(value, '{_LINE}')"""
_LABEL = O.case(list(O.RATE_LABELS.values()))


@query("e1_log_line_to_verdict", f"""
SELECT remote_addr, coalesce(split_part(coalesce(pattern_label, {_LABEL}), ':', 1), 'clean') AS verdict, count(*) AS n FROM (
 SELECT *, {O.PATTERN_LABEL} AS pattern_label, count(*) FILTER (WHERE status = 404) {O.M10} AS n404, count(*) {O.M1} AS n_1min, count(*) {O.M5} AS n_5min,
  count(DISTINCT request_uri) {O.M10} AS n_uris, count(DISTINCT CASE WHEN {O.SENSITIVE} THEN request_uri END) {O.M10} AS n_sensitive
 FROM ({_ROWS}) r WHERE NOT (remote_addr LIKE '10.%' OR remote_addr LIKE '192.168.%')) t GROUP BY 1, 2""")
def e1(d):
    return verdict_counts(d.spark, d.sf_dir)
