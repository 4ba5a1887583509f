"""Normalisers, line sources and column functions on single lines."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emberwatch.functions import net, times
from emberwatch.functions import text as X
from emberwatch.sources import arrays as A
from emberwatch.sources import lines as L
from emberwatch.sources import normalize as N
from emberwatch.sources import sinks

def ssh(message, clock="Nov  3 23:59:58", host="gate7", pid=611):
    return f"{clock} {host} sshd[{pid}]: {message}"


def sudo(message):
    return f"Jul 30 00:00:01 gate7 sudo: {message}"


def common(request, status, size="77", when="29/Feb/2024:12:00:00 -0330", who="-", rest=""):
    return f'192.0.2.61 - {who} [{when}] "{request}" {status} {size}{rest}'


def windows(**fields):
    return json.dumps({"@timestamp": "2024-02-29T15:30:00.250Z", **fields})


def netfilter(prefix, fields, host="edge"):
    return f"Dec 31 06:07:08 {host} kernel: {prefix} {fields}"


def asa(message):
    return f"Dec 31 06:07:08 edge {message}"


LINES = {
    "ssh": [
        (ssh("Failed password for wendel from 192.0.2.14 port 2222 ssh2"),
         dict(action="login", status="failure", user="wendel", src_ip="192.0.2.14", port=2222,
              host="gate7", msg="failed auth", ts=datetime(2025, 11, 3, 23, 59, 58))),
        (ssh("Failed none for invalid user from from 198.18.0.3 port 1 ssh2"),
         dict(user="from", msg="failed auth for unknown account", status="failure")),
        (ssh("Accepted password for nils.ö from 2001:db8::7 port 65535 ssh2"),
         dict(action="login", status="success", user="nils.ö", msg="password auth accepted")),
        (ssh("Invalid user  from 192.0.2.15 port 80"), None),
        (ssh("Invalid user ftp2 from 192.0.2.15 port 6001"),
         dict(action="invalid_user", status="failure", user="ftp2", port=6001)),
        (ssh("Invalid user ftp2 from 192.0.2.15"), dict(user="ftp2", port=None)),
        (ssh("error: maximum authentication attempts exceeded for wendel from 192.0.2.16 port "
             "3 ssh2 [preauth]"),
         dict(user="wendel", status="failure", msg="max auth attempts exceeded")),
        (ssh("pam_unix(sshd:auth): authentication failure; logname= uid=0 euid=0 tty=ssh ruser= "
             "rhost=192.0.2.17  user=wendel"),
         dict(status="failure", src_ip="192.0.2.17", user="wendel")),
        (ssh("pam_unix(sshd:session): session opened for user wendel(uid=1003) by (uid=0)"),
         dict(action="session_open", status="info", msg="session opened")),
        (ssh("pam_unix(sshd:session): session closed for user wendel"),
         dict(action="session_close", user="wendel")),
        (ssh("Connection closed by authenticating user ftp2 192.0.2.18 port 9 [preauth]"),
         dict(action="disconnect", user="ftp2", src_ip="192.0.2.18", port=9)),
        (ssh("Connection closed by 192.0.2.18 port 9 [preauth]"),
         dict(user=None, src_ip="192.0.2.18")),
        (ssh("Server listening on :: port 22."), None),
        (sudo("wendel : TTY=tty1 ; PWD=/srv ; USER=backup ; COMMAND=/usr/bin/rsync -a /srv /mnt"),
         dict(action="sudo", status="success", user="wendel", msg="sudo to backup",
              process="/usr/bin/rsync -a /srv /mnt")),
        (sudo("olga : command not allowed ; TTY=tty1 ; PWD=/ ; USER=root ; COMMAND=/bin/dd"), dict(action="sudo", user="olga")),
        (sudo("olga : 2 incorrect password attempts ; TTY=tty1 ; PWD=/ ; USER=root ; "
              "COMMAND=/bin/dd"), dict(action="sudo", status="failure", msg="sudo denied")),
        ("Jul 30 00:00:01 gate7 cron[40]: (root) CMD (run-parts /etc/cron.hourly)", None),
        (ssh("Accepted password for a from 192.0.2.1 port 1 ssh2", clock="Zzz  3 23:59:58"), None),
        ("gate7 has rebooted", None),
    ],
    "web": [
        (common("HEAD /robots.txt HTTP/2.0", 403, rest=' "https://ref.example/" "probe/0.1 (x)"'),
         dict(action="request", status="failure", src_ip="192.0.2.61", method="HEAD",
              path="/robots.txt", http_status=403, bytes=77, user_agent="probe/0.1 (x)",
              user=None, ts=datetime(2024, 2, 29, 15, 30))),
        (common("POST /form HTTP/1.0", 301, size="-", who="olga", rest=' "-" "-"'),
         dict(ts=datetime(2024, 2, 29, 15, 30), status="success", bytes=None, user="olga",
              user_agent=None)),
        (common("GET /p?q=%3Cb%3E%26 HTTP/1.1", 503), dict(path="/p?q=<b>&", status="error")),
        (common("GET /a b?c=d e HTTP/1.1", 500, size="0"), dict(path="/a b?c=d e", bytes=0)),
        (common("\\x03\\x00", 400), dict(method="-", path="\\x03\\x00", http_status=400)),
        (common("GET /50%-off HTTP/1.1", 200), dict(path="/50%-off")),
        (common("GET /ß%C3%9F HTTP/1.1", 200), dict(path="/ßß")),
        (common("GET / HTTP/1.1", 200, when="29/Nop/2024:12:00:00 +0000"), None),
    ],
    "windows": [
        (windows(event_id=4625, computer="PC-9", target_user="kiosk", ip="192.0.2.70"),
         dict(action="login", status="failure", event_id=4625, host="PC-9", user="kiosk",
              src_ip="192.0.2.70", msg="account failed to log on")),
        ('{"timestamp":"2024-02-29T15:30:00+02:00","EventID":" 1102 ","subject_user":"olga",'
         '"src_ip":"::1"}', dict(action="log_cleared", user="olga", src_ip=None)),
        (windows(event_id=9999, target_user="-", user="u", message="own words"),
         dict(action="wineventlog", status="info", user=None, msg="own words")),
        (windows(event_id=4624.5), dict(action="wineventlog", status="info")),
        ("[1, 2", None), (json.dumps({"event_id": 4624}), None),
        (windows(event_id="many"), None),
        (windows(event_id=4624) + ",", None),
        ('{"@timestamp":"15:30:00","event_id":4624}', None),
    ],
    "firewall": [
        (netfilter("[UFW AUDIT]", "SRC=192.0.2.1 DST=192.0.2.2"),
         dict(status="info", msg="audit ip 192.0.2.1 -> 192.0.2.2")),
        (netfilter("[UFW BLOCK]", "IN=wan0 OUT= SRC=192.0.2.80 DST=10.0.0.8 LEN=60 PROTO=UDP "
                   "SPT=5353 DPT=161"),
         dict(status="blocked", src_ip="192.0.2.80", dst_ip="10.0.0.8", port=161, proto="UDP",
              msg="block UDP 192.0.2.80 -> 10.0.0.8:161", bytes=None, host="edge")),
        (netfilter("IPTABLES ACCEPT", "SRC=192.0.2.81 SRC=192.0.2.82"),
         dict(status="allowed", src_ip="192.0.2.82", port=None)),
        (netfilter("[UFW BLOCK]", "DST=10.0.0.8 PROTO=TCP"), None),
        (asa('%ASA-4-106023: Deny udp src wan:192.0.2.83/53 dst lan:10.0.0.9/5060 by '
             'access-group "in" [0x0, 0x0]'),
         dict(status="blocked", src_ip="192.0.2.83", dst_ip="10.0.0.9", port=5060, proto="UDP")),
        (asa("%ASA-6-302014: Teardown TCP connection 7 for lan:10.0.0.9/4000 to wan:192.0.2.84/"
             "8443 duration 1:02:03 bytes 900 TCP FINs"),
         dict(status="allowed", dst_ip="192.0.2.84", port=8443, bytes=900)),
        (asa("%ASA-5-111008: User 'olga' executed the 'write' command."), None),
    ],
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [
        (name, i, i + 1, line, name)
        for name, cases in LINES.items()
        for i, (line, _) in enumerate(cases)
    ]
    lines = spark.createDataFrame(
        rows, "feed string, feed_order int, line_no bigint, line string, parser string"
    )
    return N.parse_routed(lines, 2025).cache()


def test_fields(parsed):
    got = {(r.feed, r.line_no): r.event for r in parsed.collect()}
    for name, cases in LINES.items():
        for i, (line, want) in enumerate(cases):
            event = got[(name, i + 1)]
            if want is None:
                assert event is None, line
                continue
            assert event is not None, line
            assert event.source == name and event.raw == line
            found = {k: event[k] for k in want}
            assert found == want, line


def test_sides_and_round_trip(parsed, tmp_path):
    events, skipped = N.events(parsed), N.skipped(parsed)
    total = sum(len(c) for c in LINES.values())
    assert events.count() + skipped.count() == total
    again = N.events(
        N.parse_routed(
            events.select("feed", "feed_order", "line_no", F.col("raw").alias("line"), "parser"),
            2025,
        )
    )
    assert again.exceptAll(events).count() == 0 and again.count() == events.count()
    sinks.write_events(events, str(tmp_path / "e"))
    sinks.write_skipped(skipped, str(tmp_path / "s"))
    assert events.sparkSession.read.parquet(str(tmp_path / "e")).count() == events.count()


def test_generic(spark):
    rows = [
        ('{"source": "vpn", "src_ip": "10.1.1.1", "user": "olga", "status": "denied"}',),
        (ssh("Failed password for wendel from 192.0.2.14 port 2222 ssh2"),),
        ("nothing of use",), ("\t",),
    ]
    lines = spark.createDataFrame(rows, "line string").withColumn("peer", F.lit("10.9.9.9"))
    got = [
        tuple(r) for r in N.events(N.parse_generic(lines, 2025, sender="peer"))
        .select("source", "host", "src_ip", "user", "status").collect()
    ]
    assert got == [
        ("vpn", "unknown", "10.1.1.1", "olga", "denied"),
        ("sshd", "gate7", "192.0.2.14", "wendel", "failure"),
        ("raw", "localhost", "10.9.9.9", None, None),
    ]


def test_read_lines(spark, tmp_path):
    """Line numbers count blank lines, over several files and splits."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for name in ("a", "b"):
            body = "".join(f"{name}{i}\r\n" + ("\n" if i % 7 == 0 else "") for i in range(2000))
            (tmp_path / f"{name}.log").write_bytes(body.encode() + b"\xff end")
        for name in ("a", "b"):
            got = {
                r.line_no: r.line
                for r in L.read_lines(spark, str(tmp_path / f"{name}.log"), name).collect()
            }
            want = (tmp_path / f"{name}.log").read_bytes().decode(errors="replace").split("\n")
            assert got == {
                i + 1: line.rstrip("\r") for i, line in enumerate(want) if line.strip()
            }
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_array_file(spark, tmp_path):
    items = [{"timestamp": "2024-02-29T00:00:0%dZ" % i, "event_id": 4624 + i} for i in range(3)]
    (tmp_path / "a.json").write_text(json.dumps(items))
    events = N.events(N.parse_windows(A.read_json_array(spark, str(tmp_path / "a.json"), "w")))
    assert sorted((r.line_no, r.event_id) for r in events.collect()) == [
        (1, 4624), (2, 4625), (3, 4626)
    ]


def test_classify(spark):
    rows = [(n, i, line) for n, c in LINES.items() for i, (line, _) in enumerate(c)]
    rows += [("none", 1, "hello world"), ("tie", 1, ssh("x")), ("tie", 2, '{"event_id":1}')]
    got = L.classify_feeds(
        spark.createDataFrame(rows, "feed string, line_no int, line string")
    ).collect()
    assert {r.feed: r.parser for r in got} == {
        **{n: n for n in LINES}, "none": None, "tie": "ssh"
    }


def test_functions(spark):
    one = spark.range(1)
    lit = F.lit
    got = one.select(
        *(times.human_span(lit(ms)).alias(f"s{ms}") for ms in (7, 59_000, 600_000, 61_000, 7_260_000)),
        X.template("{a} and {b}", {"a": lit(1)}.get).alias("t"),
        X.kv_last(X.words(lit("A=1 (B=2 x=B=3 BB=4 A=5")), "A").alias("a"),
        X.kv_last(X.words(lit("A=1 (B=2 x=B=3 BB=4 A=5")), "B").alias("b"),
        X.url_decode(lit("a+b%20c")).alias("u1"), X.url_decode(lit("%ff")).alias("u2"),
        net.megabytes(lit(5 * 1024 * 1024 + 52429)).alias("mb"),
        times.syslog_time(lit("Feb"), lit("31"), lit("01:02:03"), 2025).alias("roll"),
    ).first()
    assert list(got[:5]) == ["7ms", "59s", "10m", "1m1s", "2h1m"]
    assert got.t == "1 and {b}"
    assert (got.a, got.b, got.u1, got.u2, got.mb) == ("5", "2", "a b c", "%ff", "5.1")
    assert got.roll == datetime(2025, 3, 3, 1, 2, 3)
