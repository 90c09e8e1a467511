"""Configured rules, lists and bounds that the default queries do not reach."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gatewatch.functions import patterns as P
from gatewatch.functions.factors import factors
from gatewatch.functions.parse import parse_access
from gatewatch.operators import addresses, audit, bans, perf, windows

RULES = ["^curl", r"\.bak$", "^(?!/b).*zilla", "(q)w", r"(z)\1", "(?P<x>curl)", r"(?P<a>b)(?P=a)", "a|b$", r"end\Z", "([", "x{3}", r"\bcat\b",
         "(?:ab)+c", "[^/]bak", "(?i)UPPER", "(?P<n>z)+(?P=n)y", "*bad", r"\d{2,}", r"(?<=/)adm", "sel.ct"]
FIELDS = ["curl/7.68.0", "/a.bak", "/a.bak?x", "Mozilla", "/bzilla", "qw", "/zz", "bb", "xb", "bx", "the end", "xxx", "a cat", "ababc", "/bak", "zbak",
          "upper", "zzy", "12", "/adm", "select", ""]


def test_rules_match_like_python(spark):
    rows = [(i, FIELDS[i % len(FIELDS)], FIELDS[(i * 7 + 3) % len(FIELDS)], FIELDS[(i * 5 + 1) % len(FIELDS)]) for i in range(110)]
    df = spark.createDataFrame(rows, "id int, request_uri string, http_user_agent string, http_referer string")
    for rules in (RULES, RULES[::-1], ["^curl", r"\.bak$", "a|b$"], ["(q)w", "sel.ct"]):
        def python(fields):
            for p in rules:
                try:
                    c = re.compile(p, re.I)
                except re.error:
                    continue
                if any(c.search(f) for f in fields):
                    return "t:" + p
            return None
        got = {r["id"]: r["l"] for r in df.select("id", P.first_attack_match([("t", True, rules)]).alias("l")).collect()}
        assert got == {i: python(f) for i, *f in rows}


def test_factors_are_in_every_match():
    want = {"union.*select": {"select"}, "<script": {"<script"}, r"\.\./": {"../"}, "(foo|barista)x": {"foo", "barista"}, "(a|bcd)": None, "ab+c": {"ab"},
            r"\bcat\b": {"cat"}, "(?:ab)+c": {"ab"}, "(?:ab)?": None, "x{3}": None, "(?i)UPPER": {"upper"}, "foo(?!bar)baz": {"foobaz"}, "[ab]cd": {"cd"},
            "straße": {"stra"}, "(?P<a>bc)(?P=a)": {"bc"}, "a" * 30: {"a" * 16}, "": None, r"end\Z": {"end"}, "ab|": None}
    assert {p: factors(p) for p in want} == {p: w and frozenset(w) for p, w in want.items()}


def test_hundreds_of_rules_match_like_python(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abks.") for _ in range(rnd.randrange(3, 6))) for _ in range(250)]
    rules = list(dict.fromkeys([re.escape(w) + rnd.choice(["", "$", "[0-9]", ".*" + re.escape(rnd.choice(words)), "(?:x|yy)"]) for w in words]
                               + ["^" + re.escape(w) for w in words] + RULES + [r"(\d)k\1", "ks|sk9", "(?s)b.a\na", "İx", "[k]9"]))
    rnd.shuffle(rules)
    text = lambda: None if rnd.random() < .1 else "".join(rnd.choice("abks.ABKSſKıİ9\nxy") for _ in range(rnd.randrange(0, 15)))
    rows = [(i, text(), text(), text()) for i in range(1500)] + [(1500 + i, f, None, "") for i, f in enumerate(FIELDS)]
    df = spark.createDataFrame(rows, "id int, request_uri string, http_user_agent string, http_referer string")

    usable = []
    for p in rules:
        try:
            usable.append((p, re.compile(p, re.I)))
        except re.error:
            continue
    plain = {i: next((f"t:{p}" for p, c in usable if any(c.search(f or "") for f in fs)), None) for i, *fs in rows}
    got = {r["id"]: r["l"] for r in df.select("id", P.first_attack_match([("t", True, rules)]).alias("l")).collect()}
    assert got == plain and len({*got.values()}) > 60


def test_formats_with_alternation_match_at_the_start_only(spark):
    df = spark.createDataFrame([("zzz 10.0.0.1 B",), ("10.0.0.2 B",), ("10.0.0.3 A",)], "value string")
    got = parse_access(df, r"(?P<remote_addr>\S+) A|(?P<remote_user>\S+) B").collect()
    assert len(got) == 2


@pytest.mark.parametrize("n", [3, 300])
def test_allow_list_of_any_length_on_a_stream(spark, tmp_path, n):
    entries = [f"10.{i // 250}.{i % 250}.7" for i in range(n)] + ["192.168.0.0/16", "2001:db8::/33", "bad"]
    rows = [("10.0.1.7",), ("10.9.9.9",), ("192.168.3.4",), ("2001:db8:1::1",), ("2001:db8:8000::1",), ("text",), (None,)]
    spark.createDataFrame(rows, "remote_addr string").write.parquet(str(tmp_path / "in"))
    stream = addresses.drop_configured(spark.readStream.schema("remote_addr string").parquet(str(tmp_path / "in")), entries)
    q = stream.writeStream.format("memory").queryName(f"allowed{n}").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r[0] for r in spark.table(f"allowed{n}").collect()} == {"10.9.9.9", "2001:db8:8000::1", "text", None}


def test_many_hosts_in_one_network_join_by_equality(spark):
    nets = spark.range(3000).select(F.concat(F.lit("10.1."), (F.col("id") / 250).cast("int"), F.lit("."), F.col("id") % 250).alias("cidr"))
    rows = spark.range(6000).select(F.concat(F.lit("10.1."), (F.col("id") / 250).cast("int"), F.lit("."), F.col("id") % 250).alias("remote_addr"))
    assert addresses.drop_allow_listed(rows, addresses.networks_from_text(nets)).count() == 3000
    odd = spark.createDataFrame([(4, "3", "1000"), (4, "0", "0"), (4, "4294967295", "4294967295")], "family int, lo string, hi string")
    ips = ["0.0.0.0", "0.0.0.1", "0.0.0.3", "0.0.3.232", "0.0.3.233", "255.255.255.255"]
    got = addresses.range_lookup(spark.createDataFrame([(i,) for i in ips], "ip string"), odd, "ip", ["lo"])
    assert {r["ip"]: r["lo"] for r in got.collect()} == dict(zip(ips, [0, None, 3, 3, None, 4294967295]))


def test_a_ban_longer_than_any_guess(spark):
    t = [(0, 100)] + [(s, 10) for s in (81, 82, 83, 90, 101, 120)]
    df = spark.createDataFrame([("a", s * 1_000_000, i, d) for i, (s, d) in enumerate(t)], "ip string, ts_us long, event_id long, duration_s long")
    assert sorted(r["start_us"] // 1_000_000 for r in bans.ban_intervals(df).collect()) == [0, 101, 120]
    with pytest.raises(Exception, match="max_gap_us"):
        bans.ban_intervals(df, 5).collect()


def test_reports_count_everything(spark):
    e = spark.range(20_000).select(F.col("id").alias("event_id"), F.col("id").alias("ts_us"), F.array(F.lit("pci_dss")).alias("compliance_tags"),
                                   F.concat(F.lit("t"), F.col("id") % 1500).alias("event_type"))
    assert audit.compliance_report(e, "pci_dss", 0, 30_000).first()["total_events"] == 20_000
    assert perf.event_type_counts(e).count() == 1500
    assert audit.search_events(e).count() == 20_000


def test_growth_goes_on_to_the_cap(spark):
    df = spark.range(300).select(F.lit("a").alias("ip"), F.col("id").alias("start_us"), F.col("id").alias("event_id"))
    s = [r["ban_seconds"] for r in bans.escalating_bans(df, 100, 1.05, 1_000_000).orderBy("n").collect()]
    assert s[-1] == 1_000_000 and s == sorted(s) and s[60] > s[45]


def test_rows_without_an_address_are_kept(spark):
    df = spark.createDataFrame([(None, 1_000_000, 1), (None, 700_000_000, 2), ("a", 5, 3)], "remote_addr string, ts_us long, event_id long")
    df = df.withColumns({"status": F.lit(404), "http_user_agent": F.lit("u"), "request_uri": F.lit("/x")})
    out = windows.running_behaviour(df, F.lit(None).cast("string"), F.lit("low"))
    assert {(r["event_id"], r["request_count"]) for r in out.collect()} == {(1, 1), (2, 2), (3, 1)}


def test_ranges_of_both_families_nested_and_overlapping(spark):
    import ipaddress
    import random
    rnd = random.Random(9)
    ranges = []
    for i in range(60):
        if i % 2:
            a = rnd.randrange(0, 2**10) << rnd.choice([0, 4, 20])
            b = a + rnd.choice([0, 1, 15, 255, 1000, 2**rnd.randrange(21) - 1])
            ranges.append((4, str(a), str(b), f"r{i}"))
        else:
            base = 0x2001 << 112
            a = base + (rnd.randrange(0, 2**8) << rnd.choice([0, 4, 60, 100]))
            b = a + rnd.choice([0, 1, 15, 0x123456, 2**rnd.randrange(110) - 1])
            ranges.append((6, f"{a:032x}", f"{b:032x}", f"r{i}"))
    ranges += [(6, "0" * 32, "f" * 32, "all6"), (4, "5", "5", "same b"), (4, "5", "5", "same a")]
    df = spark.createDataFrame(ranges, "family int, lo string, hi string, name string")
    ips = {str(ipaddress.ip_address(int(x, 16 if f == 6 else 10) + d)) if f == 6 or int(x) + d < 2**32 else None
           for f, lo, hi, _ in ranges for x in (lo, hi) for d in (-1, 0, 1) if 0 <= int(x, 16 if f == 6 else 10) + d < 2 ** (128 if f == 6 else 32)}
    ips |= {"no address", None, "::1", "2001::", "200.1.1.1"}
    got = {r.ip: r.name for r in addresses.range_lookup(spark.createDataFrame([(x,) for x in ips], "ip string"), df, "ip", ["name"]).collect()}

    def plain(x):
        try:
            a = ipaddress.ip_address(x)
        except ValueError:
            return None
        hits = [(-int(lo, b), int(hi, b), n) for f, lo, hi, n in ranges for b in [16 if f == 6 else 10]
                if f == a.version and int(lo, b) <= int(a) <= int(hi, b)]
        return min(hits)[2] if hits else None

    assert got == {x: plain(x) for x in ips} and len({*got.values()}) > 25


def test_a_source_that_breaks_while_read_is_left_out(spark, tmp_path):
    import gzip
    from gatewatch.sources.logs import read_all_sources
    lines = "\n".join(f"line {i} {i * 7919}" for i in range(20_000)).encode()
    whole = gzip.compress(lines)
    (tmp_path / "a.gz").write_bytes(whole)
    (tmp_path / "b.gz").write_bytes(whole[:len(whole) // 2])
    (tmp_path / "c.txt").write_bytes(b"one\ntwo\n")
    read = lambda n: lambda: spark.read.text(f"{tmp_path}/{n}").selectExpr("value", "timestamp_micros(0) AS timestamp")
    rows, errors = read_all_sources({n: read(n) for n in ("a.gz", "b.gz", "c.txt", "none")}, f"{tmp_path}/stage")
    assert rows.count() == 20_002 and set(errors) == {"b.gz", "none"}


def test_sources_need_no_folder(spark, tmp_path):
    from gatewatch.sources.logs import read_all_sources
    (tmp_path / "c.txt").write_bytes(b"one\ntwo\n")
    read = lambda n: lambda: spark.read.text(f"{tmp_path}/{n}").selectExpr("value", "timestamp_micros(0) AS timestamp")
    rows, errors = read_all_sources({n: read(n) for n in ("c.txt", "none")})
    assert {r.value for r in rows.collect()} == {"one", "two"} and set(errors) == {"none"}
