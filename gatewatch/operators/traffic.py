"""Traffic summaries and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from .prefix import attach_row


def traffic_summary(rows: DataFrame, suspicious: Column) -> DataFrame:
    """AG01 totals.  ``bot_requests`` keeps the published 0, ``bot_requests_seen`` really counts."""
    n, s = F.count(F.lit(1)), F.count_if(suspicious)
    return rows.agg(n.alias("total_requests"), F.countDistinct("remote_addr").alias("unique_ips"),
                    s.alias("suspicious_requests"), F.lit(0).cast("bigint").alias("bot_requests"),
                    F.count_if(P.is_bot(F.col("http_user_agent"))).alias("bot_requests_seen"),
                    (s / F.greatest(n, F.lit(1)) * 100).alias("suspicious_rate"))


def dimension_counts(rows: DataFrame, dims: dict[str, str]) -> DataFrame:
    """Counts by several columns in one pass: (dimension, key, n)."""
    cells = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(c).cast("string").alias("key"))
                      for n, c in dims.items()])
    return rows.select(F.explode(cells).alias("_d")).groupBy("_d").agg(
        F.count(F.lit(1)).alias("n")).select("_d.*", "n")


def top_n(rows: DataFrame, col: str, n: int | None = 10, out: str = "n") -> DataFrame:
    """Most frequent values, ties in value order; ``n=None`` ranks them all."""
    t = rows.groupBy(col).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), col)
    return t if n is None else t.limit(n)


def page(rows: DataFrame, order: list, limit: int, page_no: int = 1) -> DataFrame:
    """One page of an ordered list (``offset`` + ``limit`` over one ordering)."""
    return rows.orderBy(*order).offset((page_no - 1) * limit).limit(limit)


def today(rows: DataFrame, as_of_us: int, out: str) -> DataFrame:
    """AG23: rows since the midnight before ``as_of``."""
    day = 86_400_000_000
    start = as_of_us - as_of_us % day
    return rows.agg(F.count_if((F.col("ts_us") >= start) & (F.col("ts_us") <= as_of_us)).alias(out))


def attacks_by_dimension(attacks: DataFrame, as_of_us: int, period: str, group_by: str) -> DataFrame:
    """AG30: attacks of the last hour / day / week / month by type, ip, country or hour."""
    span = {"hour": 1, "day": 24, "week": 168, "month": 720}[period] * 3_600_000_000
    col = {"type": F.col("attack_type"), "ip": F.col("remote_addr"), "country": F.col("country"),
           "hour": F.hour(F.timestamp_micros("ts_us")).cast("string")}[group_by]
    return (attacks.where((F.col("ts_us") >= as_of_us - span) & (F.col("ts_us") <= as_of_us))
            .groupBy(col.alias("key")).agg(F.count(F.lit(1)).alias("n")))


def platform_totals(requests: DataFrame, attacks: Column, bans: DataFrame) -> DataFrame:
    """AG34: one row of totals; each side is aggregated to one row before they meet."""
    r = requests.agg(F.count(F.lit(1)).alias("total_requests"), F.count_if(attacks).alias("total_attacks"),
                     F.countDistinct("node_id").alias("active_nodes"))
    return attach_row(r, bans.agg(F.countDistinct("ip").alias("banned_ips")))
