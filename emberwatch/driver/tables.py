"""The given tables as security events and raw log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.operators.staging import spread

# Select list that reads the `events` table as security events. It is plain enough to
# mean the same to Spark and to the checking engine, which both run it.
EVENT_SELECT = [
    "ts",
    "event_id AS tie",
    "CASE event_id % 4 WHEN 0 THEN 'ssh' WHEN 1 THEN 'web' WHEN 2 THEN 'windows' "
    "ELSE 'firewall' END AS source",
    "event_type AS action",
    "CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status",
    "event_type || ' ' || props AS raw",
    "CASE (user_id + event_id) % 10 WHEN 0 THEN '10.0.3.' WHEN 1 THEN '82.102.21.' "
    "WHEN 2 THEN '103.21.245.' WHEN 3 THEN '203.0.113.' WHEN 4 THEN '198.51.100.' "
    "WHEN 5 THEN '192.168.4.' WHEN 6 THEN '45.83.223.' WHEN 7 THEN '198.18.7.' "
    "WHEN 8 THEN '172.20.1.' ELSE '159.223.9.' END || CAST(user_id % 250 AS STRING) AS src_ip",
    "CASE WHEN event_id % 3 = 0 THEN '10.10.4.' || CAST(event_id % 200 AS STRING) END AS dst_ip",
    "CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS port",
    "CAST(user_id AS STRING) AS principal",
    "'host-' || CAST(user_id % 7 AS STRING) AS host",
    "CASE WHEN event_type IN ('view', 'click') THEN '/item/' || "
    "regexp_extract(props, '[0-9]+', 0) END AS path",
    "CASE WHEN event_type = 'error' THEN 404 WHEN event_type = 'view' THEN 200 "
    "END AS http_status",
    "CAST(round(value * 100) AS BIGINT) AS cents",
    "value",
    "CASE WHEN event_id % 5 = 0 THEN 'Checked by Robot ' || CAST(user_id AS STRING) END AS msg",
]

#: Where the networks of the table made from suppliers start.
NETWORK_STARTS = ["159.223.", "10.0.", "82.102.", "198.18.", "203.0."]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table, dealt over the tasks."""
    return spread(read(spark, sf_dir, "events"), "event_id")


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table in event columns."""
    return (
        events(spark, sf_dir)
        .selectExpr(*EVENT_SELECT)
        .withColumnsRenamed({"principal": "user", "cents": "bytes"})
    )


def plain_time(rows: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the given tables have them."""
    zoned = [f.name for f in rows.schema if f.dataType.typeName() == "timestamp"]
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _numbered(events: DataFrame, feed: str, line: Column) -> DataFrame:
    return events.select(
        F.lit(feed).alias("feed"),
        F.lit(0).alias("feed_order"),
        F.col("tie").alias("line_no"),
        line.alias("line"),
    )


def _syslog(host: Column) -> Column:
    return _text(F.date_format("ts", "MMM d HH:mm:ss"), " ", host, " ")


def ssh_lines(events: DataFrame) -> DataFrame:
    """Each event as an auth.log line; signups are sudo, every 50th line is noise."""
    user, ip, port = _text("u", F.col("user")), F.col("src_ip"), F.col("port")
    unknown = F.when(F.col("tie") % 2 == 0, "invalid user ").otherwise("")
    message = (
        F.when(
            F.col("tie") % 50 == 7,
            F.lit("CRON[9]: pam_unix(cron:session): session opened for user root"),
        )
        .when(
            F.col("action") == "error",
            _text("sshd[7]: Failed password for ", unknown, user, " from ", ip, " port ",
                  port, " ssh2"),
        )
        .when(
            F.col("action") == "purchase",
            _text("sshd[7]: Accepted publickey for ", user, " from ", ip, " port ", port,
                  " ssh2: RSA SHA256:x"),
        )
        .when(
            F.col("action") == "click",
            _text("sshd[7]: pam_unix(sshd:session): session opened for user ", user,
                  " by (uid=0)"),
        )
        .when(
            F.col("action") == "view",
            _text("sshd[7]: Disconnected from authenticating user ", user, " ", ip, " port ",
                  port, " [preauth]"),
        )
        .otherwise(
            _text("sudo: ", user, " : TTY=pts/0 ; PWD=/srv ; USER=root ; USER=app ; "
                  "COMMAND=/bin/run ", port)
        )
    )
    return _numbered(events, "auth", _text(_syslog(F.col("host")), message))


def web_lines(events: DataFrame) -> DataFrame:
    """Each event as an access-log line; every 40th request is not an HTTP request."""
    code = (
        F.when(F.col("action") == "error", 503)
        .when(F.col("action") == "click", 404)
        .otherwise(200)
    )
    size = F.when(F.col("tie") % 6 == 0, F.lit("-")).otherwise(F.col("bytes").cast("string"))
    request = F.when(F.col("tie") % 40 == 3, F.lit("\\x16\\x03")).otherwise(
        _text("GET /p%2Fitem+x?k=", F.col("port"), "' OR 1=1 HTTP/1.1")
    )
    zone = F.when(F.col("tie") % 2 == 0, " +0200").otherwise(" +0000")
    user = F.when(F.col("tie") % 3 == 0, F.lit("-")).otherwise(_text("u", F.col("user")))
    line = _text(
        F.col("src_ip"), " - ", user, " [", F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), zone,
        '] "', request, '" ', code, " ", size, ' "-" "agent/', F.col("port"), '"',
    )
    return _numbered(events, "access", line)


def windows_lines(events: DataFrame) -> DataFrame:
    """Each event as a Windows JSON line; every 30th line is broken JSON."""
    number = (
        F.when(F.col("action") == "error", "4625")
        .when(F.col("action") == "purchase", "4624")
        .when(F.col("action") == "click", "4672")
        .when(F.col("action") == "view", '"5158"')
        .otherwise("1102")
    )
    principal = F.when(F.col("tie") % 4 == 0, '"target_user":"-",').otherwise(
        _text('"target_user":"u', F.col("user"), '",')
    )
    line = _text(
        '{"@timestamp":"', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), '","event_id":',
        number, ',"computer":"', F.col("host"), '",', principal, '"user":"other","ip":"',
        F.when(F.col("tie") % 7 == 0, F.lit("::1")).otherwise(F.col("src_ip")), '"',
        F.when(F.col("tie") % 30 == 11, "").otherwise("}"),
    )
    return _numbered(events, "security", line)


def netfilter_lines(events: DataFrame) -> DataFrame:
    """Each event as a UFW line; a repeated key, and a verdict per event type."""
    verdict = (
        F.when(F.col("action") == "error", "BLOCK")
        .when(F.col("action") == "view", "ALLOW")
        .when(F.col("action") == "click", "AUDIT")
        .when(F.col("action") == "purchase", "DROP")
        .otherwise("LIMIT")
    )
    source = F.when(F.col("tie") % 25 == 2, F.lit("")).otherwise(_text("SRC=", F.col("src_ip")))
    line = _text(
        _syslog(F.col("host")), "kernel: [UFW ", verdict, "] IN=eth0 OUT= ", source,
        " DST=10.10.4.22 PROTO=UDP PROTO=TCP SPT=1 DPT=", F.col("port"), " WINDOW=1024 SYN",
    )
    return _numbered(events, "ufw", line)


def asa_lines(events: DataFrame) -> DataFrame:
    """Each event as an ASA line: denies for errors, teardowns else, some unknown ids."""
    message = (
        F.when(F.col("tie") % 20 == 1, F.lit("%ASA-6-302013: Built outbound"))
        .when(
            F.col("action") == "error",
            _text("%ASA-4-106023: Deny tcp src outside:", F.col("src_ip"),
                  "/44100 dst inside:203.0.113.9/", F.col("port"), ' by access-group "a" [0x0]'),
        )
        .otherwise(
            _text("%ASA-6-302014: Teardown TCP connection 41 for inside:", F.col("src_ip"),
                  "/44112 to outside:77.83.36.19/", F.col("port"),
                  " duration 0:00:31 bytes ", F.col("bytes"), " TCP FINs")
        )
    )
    return _numbered(events, "asa", _text(_syslog(F.lit("fw-edge")), message))


def generic_lines(events: DataFrame) -> DataFrame:
    """Collector lines: JSON, syslog and raw text by turns."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    json = _text(
        '{"time":"', stamp, '","timestamp":"","hostname":"', F.col("host"), '","client_ip":"',
        F.col("src_ip"), '","username":"u', F.col("user"), '","action":"', F.col("action"),
        '","status":"', F.col("status"), '"}',
    )
    syslog = _text(
        "<34>", _syslog(F.col("host")), F.when(F.col("tie") % 2 == 0, "sshd").otherwise("app"),
        "[12]: ", F.when(F.col("action") == "error", "Failed password").otherwise("Request"),
        " for u", F.col("user"), " from ", F.col("src_ip"), " port ", F.col("port"),
    )
    line = (
        F.when(F.col("tie") % 3 == 0, json)
        .when(F.col("tie") % 3 == 1, syslog)
        .otherwise(_text("plain note ", F.col("tie")))
    )
    return _numbered(events, "collector", line)


def all_lines(events: DataFrame) -> DataFrame:
    """Every event in the format of its source, with the parser to use."""
    feeds = {
        "ssh": ssh_lines, "web": web_lines, "windows": windows_lines, "firewall": netfilter_lines,
    }
    out = None
    for order, (source, render) in enumerate(feeds.items()):
        part = render(events.filter(F.col("source") == source)).withColumns(
            {"feed_order": F.lit(order), "parser": F.lit(source)}
        )
        out = part if out is None else out.unionByName(part)
    return out
