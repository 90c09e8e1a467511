"""Known inputs and outputs: parsers, classifiers, address rules, texts."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from gatewatch import rules as R
from gatewatch.functions import features as FE
from gatewatch.functions import ip as IP
from gatewatch.functions import parse as PA
from gatewatch.functions import patterns as PT
from gatewatch.functions import redact as RE
from gatewatch.functions import text as TX
from gatewatch.operators import addresses as AD
from gatewatch.operators import windows as W

LINES = [
    '203.0.113.7 - - [03/Mar/2024:22:05:09 +0000] "GET /shop/list HTTP/1.1" 200 8121 "-" "Opera/9.80 (X11)"',
    '198.51.100.23 - - [03/Mar/2024:22:05:11 +0000] "PUT /cart/7 HTTP/1.1" 201 42 "http://shop.test/cart" "okhttp/4.9"',
    '203.0.113.90 - - [03/Mar/2024:22:05:40 +0000] "GET /item?ref=9 or sleep(5) HTTP/1.1" 404 0 "-" "wfuzz/3.1"',
    '  198.51.100.77 - - [03/Mar/2024:22:06:02 +0000] "GET /a/../../conf HTTP/1.1" 403 0 "-" "Wget/1.21" tail \n',
    '1.1.1.1 - - [03/Mar/2024:22:06:30 +0000] "GET / HTTP/1.1" 200 - "-" "x"',
    '1.1.1.1 - - [bad time] "GET / HTTP/1.1" 200 5 "-" "\x1fodd"', "", "nonsense"]


def one_col(spark, values, name="value"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_combined(spark):
    got = {r.remote_addr + r.request_method: r for r in PA.parse_access(one_col(spark, LINES)).collect()}
    assert len(got) == 5
    odd = got["203.0.113.90GET"]
    # raw blanks push the rest of the uri into the protocol
    assert (odd.request_uri, odd.request_protocol) == ("/item?ref=9", "or sleep(5) HTTP/1.1")
    assert (odd.request_path, odd.request_query, odd.status, odd.http_referer) == ("/item", "ref=9", 404, None)
    assert got["198.51.100.23PUT"].http_referer == "http://shop.test/cart"
    assert got["1.1.1.1GET"].timestamp is None and got["1.1.1.1GET"].http_user_agent == "\x1fodd"
    assert got["203.0.113.7GET"].time_local == "03/Mar/2024:22:05:09 +0000"
    bad = PA.rejected_lines(one_col(spark, LINES)).collect()
    assert len(bad) == 2


def test_user_pattern_must_compile(spark):
    with pytest.raises(Exception):
        PA.parse_access(one_col(spark, LINES), r"(?P<a>\S+")


@pytest.mark.parametrize("uri,want", [
    ("/a;p=1?q#f", ("/a", "q", "f")), ("/a;x/b;y", ("/a;x/b", "", "")), ("http://h:80/p?x=1?y", ("/p", "x=1?y", "")),
    ("//host/p", ("/p", "", "")), ("/p?", ("/p", "", "")), ("*", ("*", "", "")), ("/a#b#c?d", ("/a", "", "b#c?d"))])
def test_uri(spark, uri, want):
    r = PA.split_uri(one_col(spark, [uri], "request_uri")).collect()[0]
    assert (r.request_path, r.request_query, r.request_fragment) == want


def test_json_aliases(spark):
    lines = ['{"time": "2024-01-01T00:00:00Z", "remote_addr": "1.2.3.4", "path": "/x", "status": 404, "zz": 5}',
             '{"ip": null, "remote_addr": "1.2.3.4", "level": "ERROR", "message": "m"}', '{"broken": ', "[]", "text"]
    got = PA.parse_json_entry(one_col(spark, lines), "api").orderBy("level").collect()
    assert len(got) == 2
    assert got[0].ip_address is None and got[0].message == "m"
    assert got[1].request_url == "/x" and got[1].extra_fields == {"zz": "5"} and got[1].message == lines[0]


def test_system_log_rules(spark):
    as_of = F.lit("2024-05-06 00:00:00").cast("timestamp")
    lines = ["2024-01-01 00:00:01 - n1 - WARNING - [ip_banned] IP 1.2.3.4 banned: reason=x",
             "[2024-01-01 00:00:01] IP 1.2.3.4 banned", "2024/01/01 00:00:02 host unbanned fe80::1",
             "Mar 7 01:02:03 attack error", "no time", '{"event_type": "a", "ip_address": "::1"}']
    got = {r.raw_line: r for r in TX.parse_system_log(one_col(spark, lines), as_of).collect()}
    assert set(got) == {lines[0], lines[2], lines[3], lines[5]}
    # the leftmost text of address shape wins, and a time of day has that shape
    assert got[lines[2]].event_type == "ip_banned" and got[lines[2]].ip_address == "00:00:02"
    assert str(got[lines[3]].timestamp).startswith("2024-03-07") and got[lines[3]].level == "ERROR"
    assert got[lines[5]].ip_address == "::1" and got[lines[5]].level == "INFO"


def test_addresses_like_the_standard_library(spark):
    rnd = random.Random(4)
    texts = ["127.0.0.1", "::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "192.0.0.9", "192.0.0.8", "100.64.0.1", "01.2.3.4",
             "256.1.1.1", "1.2.3", "", "x", "1::2::3", "2001:20::7", "64:ff9b:1::1", "203.0.113.9", "1:2:3:4:5:6:7:8"]
    texts += [str(ipaddress.IPv4Address(rnd.getrandbits(32))) for _ in range(150)]
    texts += [str(ipaddress.IPv6Address(rnd.getrandbits(128))) for _ in range(60)]
    texts += [str(ipaddress.ip_network(n)[1]) for n in R.PRIVATE_V4 if not n.endswith("/32")]
    ip = F.col("ip")
    rows = one_col(spark, texts, "ip").select("ip", IP.v4_number(ip).alias("n"), IP.v6_hex(ip).alias("h"),
                                              IP.is_private(ip).alias("p")).collect()
    for r in rows:
        try:
            a = ipaddress.ip_address(r.ip)
        except ValueError:
            assert (r.n, r.h, r.p) == (None, None, False), r
            continue
        assert r.n == (int(a) if a.version == 4 else None), r
        assert r.h == (f"{int(a):032x}" if a.version == 6 else None), r
        assert r.p == a.is_private, r


def test_allow_list_forms_agree(spark):
    entries = ["127.0.0.1", "::1", "192.168.0.0/16", "10.0.0.0/8", "172.16.0.0/12", "2001:db8::/33", "bad/99", "fd00::/8"]
    ips = ["127.0.0.1", "192.168.1.100", "8.8.8.8", "10.0.0.1", "172.31.9.9", "172.32.0.1", "0:0:0:0:0:0:0:1", "not an ip",
           "2001:db8:7fff::1", "2001:db8:8000::1", "fd12::1", "10.bad", "127.0.0.11"]
    rows = one_col(spark, ips, "remote_addr")
    nets = [ipaddress.ip_network(e, strict=False) for e in entries if e != "bad/99"]

    def listed(t):
        try:
            return any(ipaddress.ip_address(t) in n for n in nets)
        except ValueError:
            return False
    want = {t for t in ips if not listed(t)}
    joined = AD.drop_allow_listed(rows, AD.networks_frame(spark, entries))
    plain = AD.drop_configured(rows, entries)
    assert {r[0] for r in joined.collect()} == want
    assert {r[0] for r in plain.collect()} == want
    strict = AD.drop_configured(rows, ["10.0.0.1/8", "192.168.0.0/16"], strict=True, stop_at_bad=True)
    assert strict.count() == len(ips)


def test_requests_are_classified(spark):
    rows = [("/shop?cat=7 union all select pin from cards", "Opera/9.80 (X11; Linux)", None, 200),
            ("/find?term=<script src=q.js>", "nikto/2.5", None, 404),
            ("/about/team", "Mozilla/5.0 (X11; FreeBSD amd64)", None, 200),
            ("/x", "ok agent here", "http://a/../b", 200), (r"/a\b\c\d", "agent agent", None, 500)]
    df = spark.createDataFrame(rows, "request_uri string, http_user_agent string, http_referer string, status bigint")
    df = df.withColumn("body_bytes_sent", F.lit(0)).withColumn("request_time", F.lit(31.0))
    got = PT.suspicious_request(df.withColumn("label", PT.first_attack_match())).collect()
    assert [r.label for r in got] == ["sql_injection:union.*select", "xss:<script", None, r"path_traversal:\.\./", None]
    assert [r.risk_score for r in got] == [20, 25, 10, 30, 25]
    assert got[3].attack_types == ["path_traversal", "file_inclusion"]


def test_burst_of_404_fires_at_its_threshold(spark):
    rows = [("203.0.113.40", 1709503200000000 + i * 7_000_000, i, f"/gone/{i}.txt", "feed reader 3", None, 404)
            for i in range(12)]
    df = spark.createDataFrame(rows, "remote_addr string, ts_us bigint, event_id bigint, request_uri string, "
                                     "http_user_agent string, http_referer string, status bigint")
    got = {r.event_id: r.attack_label for r in W.detect(
        df, rules={"not_found_threshold": 6, "time_window_minutes": 2}).collect()}
    assert got[4] is None and got[5] == "high_404_frequency:6_in_2min"


def test_scanner_is_banned_for_its_rate(spark):
    rows = [("203.0.113.41", 1709503200000000 + i * 1_000_000, i, p, "crawl/7", None, 404)
            for i, p in enumerate(["/vault/keys", "/ops/console", "/old/dump.tar"])]
    df = spark.createDataFrame(rows, "remote_addr string, ts_us bigint, event_id bigint, request_uri string, "
                                     "http_user_agent string, http_referer string, status bigint")
    b = W.running_behaviour(df, F.lit("scan"), F.lit("low"))
    for n, c in W.ban_decision().items():
        b = b.withColumn(n, c)
    got = {r.event_id: r for r in b.collect()}
    assert not got[0].should_ban and got[1].ban_reason == "请求频率过高: 120.0/min"
    assert got[2].ban_reason == R.BAN_TEXT["burst"] and got[2].risk_score == pytest.approx(21.0)


def test_decode_and_redact(spark):
    t = ["a%20b+c", "50%", "%C3%A9%zz", "%e4%bd%a0", "plain", "%41%"]
    from urllib.parse import unquote
    got = FE.with_percent_decoded(one_col(spark, t), "value", "d").collect()
    assert {r.value: r.d for r in got} == {x: unquote(x) for x in t}
    js = '{"Password": "x", "a": {"api_key": 1, "list": ["' + "y" * 1200 + '"]}, "n": null}'
    r = one_col(spark, [js, "no json"]).select(RE.redact_json(F.col("value")).alias("v")).collect()
    assert '"Password": "[REDACTED]"' in r[0].v and "y" * 1000 + "[TRUNCATED]" in r[0].v and r[1].v is None
    deep = "1"
    for _ in range(13):
        deep = '{"q": ' + deep + "}"
    assert "MAX_DEPTH" in one_col(spark, [deep]).select(RE.redact_json(F.col("value")).alias("v")).collect()[0].v


def test_checksum_like_json_dumps(spark):
    import datetime
    import hashlib
    import json
    rows = [("e1", "xss_attempt", datetime.datetime(2024, 1, 1, 0, 0, 1, 5), "1.2.3.4", 'say "hi" \\ 你好 🟡'),
            ("e2", "login_failure", datetime.datetime(2024, 1, 1, 0, 0, 1), "::1", "plain")]
    df = spark.createDataFrame(rows, "id string, event_type string, timestamp timestamp_ntz, source_ip string, description string")
    df = df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    from gatewatch.operators.audit import checksum
    for r, raw in zip(df.select("id", checksum().alias("c")).orderBy("id").collect(), rows):
        doc = dict(zip(("id", "event_type", "timestamp", "source_ip", "description"), raw))
        doc["timestamp"] = raw[2].isoformat()
        assert r.c == hashlib.sha256(json.dumps(doc, sort_keys=True).encode()).hexdigest()
