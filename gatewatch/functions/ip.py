"""Addresses as numbers: IPv4 as BIGINT, IPv6 as 32 hex digits (compared as text)."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from .regex import let

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4_PATTERN = f"^{_OCTET}(\\.{_OCTET}){{3}}$"


def v4_number(ip: Column) -> Column:
    """BIGINT of a dotted quad, NULL for anything else (leading zeros are not an address)."""
    p = F.split(ip, "\\.")
    n = p[0].cast("bigint") * 16777216 + p[1].cast("bigint") * 65536 \
        + p[2].cast("bigint") * 256 + p[3].cast("bigint")
    return F.when(ip.rlike(V4_PATTERN), n)


def v6_hex(ip: Column) -> Column:
    """32 hex digits of an IPv6 text, NULL when it is none.  Handles ``::`` and a dotted tail."""
    return F.when(ip.contains(":"), let(_hex_tail(F.lower(ip)), _expand))


def _hex_tail(low: Column) -> Column:
    tail = r"^(.*:)(\d+\.\d+\.\d+\.\d+)$"
    num = v4_number(F.regexp_extract(low, tail, 2))
    return F.when(low.rlike(tail), F.concat(
        F.regexp_extract(low, tail, 1), F.lower(F.hex(F.shiftright(num, 16))), F.lit(":"),
        F.lower(F.hex(num.bitwiseAND(F.lit(65535)))))).otherwise(low)


def _expand(low: Column) -> Column:
    shape = (low.rlike(r"^[0-9a-f:]+$") & ~low.rlike(r"[0-9a-f]{5}") & ~low.rlike(":::")
             & ~low.rlike("::.*::") & ~low.rlike("^:[^:]") & ~low.rlike("[^:]:$"))
    groups = lambda h: F.filter(F.split(h, ":"), lambda g: g != "")
    pad = lambda a: F.array_join(F.transform(a, lambda g: F.lpad(g, 4, "0")), "")
    halves = F.struct(groups(F.substring_index(low, "::", 1)).alias("l"),
                      F.when(low.contains("::"), groups(F.substring_index(low, "::", -1)))
                      .otherwise(F.array().cast("array<string>")).alias("r"),
                      low.contains("::").alias("gap"))

    def fill(h):
        missing = F.lit(8) - F.size(h["l"]) - F.size(h["r"])
        fits = F.when(h["gap"], missing >= 1).otherwise(missing == 0)
        return F.when(fits, F.concat(pad(h["l"]), F.repeat(F.lit("0000"), missing), pad(h["r"])))

    return F.when(shape, let(halves, fill))


def network_range(text: str, strict: bool = False):
    """(family, lo, hi) of a CIDR or address text; raises ValueError when it is neither."""
    n = ipaddress.ip_network(text, strict=strict)
    if n.version == 4:
        return 4, int(n.network_address), int(n.broadcast_address)
    return 6, f"{int(n.network_address):032x}", f"{int(n.broadcast_address):032x}"


def _in_any(value: Column, networks: list[str]) -> Column:
    out = F.lit(False)
    for text in networks:
        _, lo, hi = network_range(text)
        out = out | value.between(F.lit(lo), F.lit(hi))
    return out


def _numbers(ip: Column) -> Column:
    return F.struct(v4_number(ip).alias("v4"), v6_hex(ip).alias("v6"))


def _private(a: Column) -> Column:
    mapped = F.when(a["v6"].startswith(R.MAPPED_V4_PREFIX),
                    F.conv(F.substring(a["v6"], 25, 8), 16, 10).cast("bigint"))
    four = lambda n: _in_any(n, R.PRIVATE_V4) & ~_in_any(n, R.PRIVATE_V4_EXCEPT)
    return (F.when(a["v4"].isNotNull(), four(a["v4"]))
             .when(mapped.isNotNull(), let(mapped, four))
             .when(a["v6"].isNotNull(), _in_any(a["v6"], R.PRIVATE_V6)
                   & ~_in_any(a["v6"], R.PRIVATE_V6_EXCEPT))
             .otherwise(F.lit(False)))


def is_private(ip: Column) -> Column:
    """Special-purpose address, by the published block lists; false for text that is no address."""
    return let(_numbers(ip), _private)


def is_address(ip: Column) -> Column:
    return v4_number(ip).isNotNull() | v6_hex(ip).isNotNull()


def ip_class(ip: Column) -> Column:
    return (F.when(ip.isin("127.0.0.1", "::1"), "localhost")
             .when(is_private(ip), "private").otherwise("public"))


def geo_struct(ip: Column) -> Column:
    """Country, city, isp and risk level by the simulated octet table; NULL for a bad address."""
    mk = lambda t: F.struct(*[F.lit(v).alias(n) for n, v in
                              zip(("country", "city", "isp", "risk_level"), t)])

    def locate(a: Column) -> Column:
        first = F.shiftright(a["v4"], 24)
        by_octet = F.when(first.isin(R.GEO_PRIVATE_OCTETS), mk(R.GEO_PRIVATE))
        for lo, hi, *geo in R.GEO_OCTETS:
            by_octet = by_octet.when(first.between(lo, hi), mk(geo))
        return (F.when(a["v4"].isNull() & a["v6"].isNull(), F.lit(None))
                 .when(_private(a), mk(R.GEO_PRIVATE))
                 .when(a["v4"].isNotNull(), by_octet)
                 .otherwise(mk(R.GEO_UNKNOWN)))

    return let(_numbers(ip), locate)


def pseudonym_md5(ip: Column) -> Column:
    return F.substring(F.md5(ip), 1, 16)


def pseudonym_sha(ip: Column, salt: str) -> Column:
    """Salted form.  The salt is a deployment secret; pass the one existing tables were keyed with."""
    return F.substring(F.sha2(F.concat(F.lit(salt + ":"), ip), 256), 1, 16)
