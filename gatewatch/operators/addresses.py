"""Joins of addresses with networks, geo ranges and threat lists."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ip import network_range, v4_number, v6_hex
from .prefix import attach_row

NETWORK_DDL = "cidr string, family int, lo string, hi string"


def is_network(text: str, strict: bool = False) -> bool:
    try:
        network_range(text, strict)
        return True
    except ValueError:
        return False


def networks_frame(spark: SparkSession, entries: list[str], strict: bool = False,
                   stop_at_bad: bool = False) -> DataFrame:
    """Configured addresses and CIDR texts as ranges.  Bad entries are skipped; with
    ``stop_at_bad`` the first bad one also ends the list (the strict reading)."""
    out = []
    for e in entries:
        if not is_network(e, strict):
            if stop_at_bad:
                break
            continue
        fam, lo, hi = network_range(e, strict)
        out.append((e, fam, str(lo), str(hi)))
    return spark.createDataFrame(out, NETWORK_DDL)


def networks_from_text(df: DataFrame, cidr: str = "cidr") -> DataFrame:
    """A table of IPv4 CIDR texts to ranges, in expressions (host bits are masked off)."""
    addr = F.substring_index(F.col(cidr), "/", 1)
    bits = F.coalesce(F.try_element_at(F.split(F.col(cidr), "/"), F.lit(2)).try_cast("int"), F.lit(32))
    size = F.pow(F.lit(2.0), F.lit(32) - bits).cast("bigint")
    num = v4_number(addr)
    lo = num - F.pmod(num, size)
    return (df.where(num.isNotNull() & bits.between(0, 32))
            .select(*df.columns, F.lit(4).alias("family"), lo.cast("string").alias("lo"),
                    (lo + size - 1).cast("string").alias("hi")))


_LEFT, _RIGHT = "shiftright(lo + shiftleft(1L, k) - 1, k)", "shiftright(hi + 1, k)"


def _blocks(ranges: DataFrame) -> DataFrame:
    """The aligned blocks of 2^_lev IPv4 addresses that make up each range, at most two of a size: (_lev, _blk) is an
    equi key."""
    cell = "named_struct('lev', k, 'blk', {}, 'ok', " + f"{_LEFT} < {_RIGHT} and " + "{} % 2 = 1)"
    cells = f"array({cell.format(_LEFT, _LEFT)}, {cell.format(_RIGHT + ' - 1', _RIGHT)})"
    blocks = F.expr(f"filter(flatten(transform(sequence(0, 32), k -> {cells})), x -> x.ok)")
    r = ranges.where("family = 4").withColumns({"lo": F.col("lo").cast("bigint"), "hi": F.col("hi").cast("bigint")})
    return (r.withColumn("_b", F.explode(blocks)).withColumns({"_lev": F.col("_b.lev"), "_blk": F.col("_b.blk")}).drop("_b"))


def _at_levels(addresses: DataFrame, blocks: DataFrame) -> DataFrame:
    """Addresses (number ``_n``) once per block size that occurs, as (_lev, _blk)."""
    levels = blocks.agg(F.collect_set("_lev").alias("_levels"))  # one row of at most 33 numbers
    return (attach_row(addresses, levels).withColumn("_lev", F.explode("_levels")).drop("_levels")
            .withColumn("_blk", F.expr("shiftright(_n, _lev)")))


def _is_v6(col: str) -> Column:
    return F.col(col).contains(":")


def network_join(rows: DataFrame, networks: DataFrame, ip: str, how: str) -> DataFrame:
    """``left_semi`` / ``left_anti`` of rows against networks.

    Distinct addresses are matched to ranges, then joined back by address: a busy address is
    looked up once, and no side is broadcast unless Spark finds it small enough at run time.
    """
    listed = listed_addresses(rows, networks, ip)
    return rows.join(listed, ip, how)


def listed_addresses(rows: DataFrame, networks: DataFrame, ip: str) -> DataFrame:
    """Distinct addresses of ``rows`` that fall in a network."""
    a = rows.select(ip).distinct()
    n4 = _blocks(networks.select("family", "lo", "hi")).select("_lev", "_blk")
    four = _at_levels(a.withColumn("_n", v4_number(F.col(ip))).where("_n is not null"), n4)
    hit4 = four.join(n4, ["_lev", "_blk"], "left_semi").select(ip)
    n6 = _v6_blocks(networks.select("family", "lo", "hi")).select("_pre")
    hit6 = _at_lengths(a, ip, n6).join(n6, "_pre", "left_semi").select(ip)
    return hit4.unionByName(hit6).distinct()


def _v6_blocks(ranges: DataFrame) -> DataFrame:
    """The blocks of addresses with common leading hex digits (``_pre``) that make up each IPv6 range, any range of two
    32-digit texts.  Where the ends part, the digits between them are whole blocks; below, the digits behind those of ``lo`` and
    before those of ``hi``."""
    digit = lambda x, d: F.instr(F.lit("0123456789abcdef"), F.substring(x, d, 1)) - 1
    blocks = lambda head, lo, hi: F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda x: F.concat(
        head, F.lower(F.hex(x))))).otherwise(F.array().cast("array<string>"))
    six = ranges.where("family = 6")
    common = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(32)), lambda i: F.expr("left(lo, 0)").isNotNull()
                                  & (F.col("lo").substr(F.lit(1), i) == F.col("hi").substr(F.lit(1), i))))
    six = six.withColumns({"_c": common, "_a": F.length(F.rtrim(F.translate("lo", "0", " "))), "_b": F.length(F.rtrim(F.translate("hi", "f", " ")))})
    lo, hi, c, part = F.col("lo"), F.col("hi"), F.col("_c"), lambda x, n: F.substring(x, F.lit(1), n)
    spine = lambda end, one: F.when(end >= c + 2, F.flatten(F.transform(F.sequence(c + 2, end), one))).otherwise(
        F.array().cast("array<string>"))
    both = F.concat(
        F.array(part(lo, F.greatest(F.col("_a"), c + 1)), part(hi, F.greatest(F.col("_b"), c + 1))),
        blocks(part(lo, c), digit(lo, c + 1) + 1, digit(hi, c + 1) - 1),
        spine(F.col("_a"), lambda d: blocks(part(lo, d - 1), digit(lo, d) + 1, F.lit(15))),
        spine(F.col("_b"), lambda d: blocks(part(hi, d - 1), F.lit(0), digit(hi, d) - 1)))
    whole = (F.col("_a") <= c) & (F.col("_b") <= c)
    return six.withColumn("_pre", F.explode(F.when(whole, F.array(part(lo, c))).otherwise(both))).drop("_a", "_b", "_c")


def _at_lengths(addresses: DataFrame, ip: str, blocks: DataFrame) -> DataFrame:
    """IPv6 addresses once per block length that occurs, as ``_pre``."""
    lengths = blocks.agg(F.collect_set(F.length("_pre")).alias("_lens"))  # one row of at most 33 numbers
    six = addresses.where(_is_v6(ip)).withColumn("_h", v6_hex(F.col(ip))).where("_h is not null")
    return attach_row(six, lengths).withColumn("_len", F.explode("_lens")).withColumn("_pre", F.expr("left(_h, _len)")).drop("_lens", "_len", "_h")


def drop_allow_listed(rows: DataFrame, networks: DataFrame, ip: str = "remote_addr") -> DataFrame:
    """Rows whose address is not on the list; a text that is no address is not on it."""
    return network_join(rows, networks, ip, "left_anti")


#: Entries of a configured list that are written into the plan, and those that may be sent to all executors (some
#: 60 bytes each); a longer list is joined by the distinct addresses.
LITERALS, SENT = 1_000, 200_000


def drop_configured(rows: DataFrame, entries: list[str], ip: str = "remote_addr", strict: bool = False,
                    stop_at_bad: bool = False) -> DataFrame:
    """F08 for a list that lives in the configuration, of any length, for tables and streams.

    The rows are not shuffled: a short list is a filter (one hashed set per prefix length that occurs, at most 33 for
    IPv4; hexadecimal digits for IPv6), a longer one is broadcast, its size being known.  Only a list of over ``SENT``
    entries is a join: of the distinct addresses for a table, of the rows for a stream.
    """
    four: dict[int, set] = {}
    six: dict[int, set] = {}
    for e in entries:
        if not is_network(e, strict):
            if stop_at_bad:
                break
            continue
        net = ipaddress.ip_network(e, strict=False)
        first = int(net.network_address)
        if net.version == 4:
            four.setdefault(net.prefixlen, set()).add(first >> (32 - net.prefixlen))
        else:
            digits = -(-net.prefixlen // 4)
            base = first >> (128 - 4 * digits)
            for i in range(1 << (4 * digits - net.prefixlen)):
                six.setdefault(digits, set()).add(f"{base + i:0{digits}x}" if digits else "")
    keys = [(F.shiftright(v4_number(F.col(ip)), 32 - bits), sorted(k), "bigint") for bits, k in sorted(four.items())]
    keys += [(F.when(_is_v6(ip), F.left(v6_hex(F.col(ip)), F.lit(digits))), sorted(k), "string") for digits, k in sorted(six.items())]
    size = sum(len(k) for _, k, _ in keys)
    if size <= LITERALS:
        listed = [F.coalesce(e.isin(k), F.lit(False)) for e, k, _ in keys]
        return rows.where(~reduce(Column.__or__, listed)) if listed else rows
    spark = rows.sparkSession
    if size > SENT and not rows.isStreaming:
        a = rows.select(ip).distinct()
        listed = [a.join(spark.createDataFrame([(x,) for x in k], f"_net {t}"), e == F.col("_net"), "left_semi") for e, k, t in keys]
        return rows.join(reduce(DataFrame.unionByName, listed).distinct(), ip, "left_anti")
    for e, k, t in keys:
        static = spark.createDataFrame([(x,) for x in k], f"_net {t}")
        rows = rows.join(F.broadcast(static) if size <= SENT else static, e == F.col("_net"), "left_anti")
    return rows


def range_lookup(rows: DataFrame, ranges: DataFrame, ip: str, cols: list[str]) -> DataFrame:
    """Columns of the range an address falls in, NULL when in none; IPv4 and IPv6.

    Ranges may overlap: the one that begins last counts, of those the one that ends first, of equal ones the smallest
    ``cols``.  For nested ranges that is the innermost (the longest prefix).  ``lo`` and ``hi`` as columns are the
    numbers of an IPv4 range, NULL for IPv6.
    """
    four = F.col("family") == 4
    number = lambda c: F.when(four, F.col(c).cast("bigint")) if c in ("lo", "hi") else F.col(c)
    kept = F.struct(*(number(c).alias(f"c{i}") for i, c in enumerate(cols)))
    # the order of ends as texts of one length, IPv4 numbers being brought to ten digits
    end = lambda c: F.when(four, F.lpad(F.col(c).cast("string"), 10, "0")).otherwise(F.col(c).cast("string"))
    r = ranges.select("family", F.col("lo").cast("string").alias("lo"), F.col("hi").cast("string").alias("hi"), kept.alias("_cols"), end("lo").alias("_lo"),
                      F.translate(end("hi"), "0123456789abcdef", "fedcba9876543210").alias("_hi"))
    a = rows.select(ip).distinct()
    b4, b6 = _blocks(r), _v6_blocks(r)
    at4 = _at_levels(a.withColumn("_n", v4_number(F.col(ip))).where("_n is not null"), b4)
    at6 = _at_lengths(a, ip, b6)
    hits = [at.join(b, on).select(ip, "_lo", "_hi", "_cols") for at, b, on in ((at4, b4, ["_lev", "_blk"]), (at6, b6, ["_pre"]))]
    best = F.max_by("_cols", F.struct("_lo", "_hi"))
    found = hits[0].unionByName(hits[1]).groupBy(ip, "_lo", "_hi").agg(F.min("_cols").alias("_cols")).groupBy(ip).agg(best.alias("_cols"))
    found = found.select(ip, *(F.col(f"_cols.c{i}").alias(c) for i, c in enumerate(cols)))
    return rows.join(found, ip, "left")


def flag_listed(rows: DataFrame, listed: DataFrame, ip: str, out: str = "is_malicious") -> DataFrame:
    """Membership of an address list as a flag."""
    m = listed.select(F.col(listed.columns[0]).alias(ip)).distinct().withColumn(out, F.lit(True))
    return rows.join(m, ip, "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def edit_list(current: DataFrame, add: DataFrame, remove: DataFrame, col: str) -> DataFrame:
    """Union of list and additions without the removals."""
    return (current.select(col).unionByName(add.select(col)).distinct()
            .join(remove.select(col).distinct(), col, "left_anti"))
