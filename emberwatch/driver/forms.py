"""Every message form of the normalisers, rendered from the events; and the SQL for what is read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.driver import oracles as O
from emberwatch.driver import tables as T
from emberwatch.sources import normalize as N

YEAR = 2024
WINDOWS_IDS = [*N.WINDOWS_EVENTS, 9999]
WORDS = [*N.VERDICTS, "LIMIT"]


def _nth(values: list, at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))


def _read_back(parsed: DataFrame, *columns: str) -> DataFrame:
    found = N.events(parsed)
    return T.plain_time(found.select("line_no", "ts", *(F.col(c).alias(f"{c}_") for c in columns)))


def ssh_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ssh and sudo messages that `normalize_ssh` has none of, twelve by turns; the last is no event."""
    events = T.security_events(spark, sf_dir)
    user, ip, port = T._text("u", F.col("user")), F.col("src_ip"), F.col("port")
    text, peer = T._text, T._text(" from ", ip, " port ", port)
    messages = [
        text("sshd[7]: Invalid user ", user, peer),
        text("sshd[7]: Invalid user ", user, " from ", ip),
        text("sshd[7]: error: maximum authentication attempts exceeded for ", user, peer, " ssh2 [preauth]"),
        text("sshd[7]: error: maximum authentication attempts exceeded for invalid user ", user, peer, " ssh2"),
        text("sshd[7]: pam_unix(sshd:auth): authentication failure; logname= uid=0 euid=0 tty=ssh ruser= rhost=", ip, "  user=", user),
        text("sshd[7]: pam_unix(sshd:session): session closed for user ", user),
        text("sshd[7]: Connection closed by authenticating user ", user, " ", ip, " port ", port, " [preauth]"),
        text("sshd[7]: Connection closed by ", ip, " port ", port, " [preauth]"),
        text("sshd[7]: Disconnected from ", ip, " port ", port),
        text("sudo: ", user, " : 3 incorrect password attempts ; TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/run ", port),
        text("sudo[9]: ", user, " : not in the sudoers file ; TTY=pts/0 ; COMMAND=/bin/ls"),
        text("sshd[7]: Received disconnect", peer, ":11: bye"),
    ]
    message = F.lit(None).cast("string")
    for i, m in enumerate(messages):
        message = F.when(F.col("tie") % len(messages) == i, m).otherwise(message)
    lines = T._numbered(events, "auth", text(T._syslog(F.col("host")), message))
    return _read_back(N.parse_ssh(lines, YEAR), "action", "status", "user", "src_ip", "port", "process", "msg")


def windows_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All known event ids and an unknown one, with accounts and addresses in every field they may stand in."""
    events = T.security_events(spark, sf_dir)
    tie, text = F.col("tie"), T._text
    who = F.when(tie % 4 == 0, '"target_user":"-","user":"other"').when(tie % 4 == 1, text('"user":"u', F.col("user"), '"')).when(
        tie % 4 == 2, text('"subject_user":"s', F.col("user"), '"')
    ).otherwise('"subject_user":""')
    where = F.when(tie % 3 == 0, text('"src_ip":"', F.col("src_ip"), '"')).when(tie % 3 == 1, '"ip":"-"').otherwise(
        text('"ip":"', F.col("src_ip"), '","src_ip":"192.0.2.1"')
    )
    number = _nth(WINDOWS_IDS, tie).cast("string")
    named = F.when(tie % 2 == 0, text('"event_id":', number)).otherwise(text('"EventID":"', number, '"'))
    said = F.when(tie % 5 == 0, text(',"message":"said ', tie, '"')).otherwise("")
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = text('{"timestamp":"', time, '",', named, ",", who, ",", where, said, ',"process":"p.exe","computer":"', F.col("host"), '"}')
    parsed = N.parse_windows(T._numbered(events, "security", line))
    return _read_back(parsed, "action", "status", "event_id", "user", "src_ip", "msg", "process")


def firewall_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All verdicts in both spellings of the netfilter prefix, with and without a port."""
    events = T.security_events(spark, sf_dir)
    tie, text = F.col("tie"), T._text
    word = _nth(WORDS, tie)
    prefix = F.when(tie % 2 == 0, text("[UFW ", word, "] ")).otherwise(text("IPTABLES ", word, " "))
    port = F.when(tie % 3 != 0, text(" SPT=1 DPT=", F.col("port"))).otherwise("")
    line = text(T._syslog(F.col("host")), "kernel: ", prefix, "IN=eth0 OUT= SRC=", F.col("src_ip"), " DST=10.10.4.22 PROTO=UDP", port)
    parsed = N.parse_firewall(T._numbered(events, "ufw", line), YEAR)
    return _read_back(parsed, "status", "src_ip", "dst_ip", "port", "proto", "msg")


def sender_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collector lines with the address of their sender, which stands in where a line has none."""
    events = T.security_events(spark, sf_dir)
    lines = T.generic_lines(events).withColumn("sender", F.concat(F.lit("192.0.2."), F.col("line_no") % 250))
    found = N.events(N.parse_generic(lines, YEAR, sender="sender"))
    return found.select("line_no", F.col("src_ip").alias("src_ip_"))


def queries() -> dict:
    return {
        "normalize_ssh_forms": ssh_forms, "normalize_windows_ids": windows_ids,
        "normalize_verdicts": firewall_verdicts, "sender_fallback": sender_fallback,
    }


def _case(values) -> str:
    """By the event's number, counted round."""
    values = list(values)
    rows = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE tie % {len(values)} {rows} END"


def oracle_sql() -> dict[str, str]:
    quoted = lambda values: [f"'{v}'" for v in values]
    user, none, port = "'u' || principal", "NULL", "port"
    known = [N.WINDOWS_EVENTS.get(i, ("wineventlog", "info", None)) for i in WINDOWS_IDS]
    label = _case([f"'{k[2]}'" if k[2] else "NULL" for k in known])
    verdict = _case(quoted(WORDS))
    return {
        "normalize_ssh_forms": f"WITH {O.EV} SELECT tie AS line_no, {O._SEC} AS ts, "
        + _case(quoted(["invalid_user", "invalid_user", "login", "login", "login", "session_close", "disconnect", "disconnect",
                        "disconnect", "sudo", "sudo", ""])) + " AS action_, "
        + _case(quoted(["failure"] * 5 + ["info"] * 4 + ["failure"] * 3)) + " AS status_, "
        + _case([user] * 7 + [none, none, user, user, none]) + " AS user_, "
        + _case(["src_ip"] * 5 + [none] + ["src_ip"] * 3 + [none] * 3) + " AS src_ip_, "
        + _case([port, none, port, port, none, none, port, port, port, none, none, none]) + " AS port_, "
        + _case([none] * 9 + ["'/bin/run ' || port", "'/bin/ls'", none]) + " AS process_, "
        + _case(quoted(["unknown account probed"] * 2 + ["max auth attempts exceeded"] * 2 + [
            "pam authentication failure", "session closed", "connection closed", "connection closed", "disconnected",
            "sudo denied", "sudo denied", ""])) + " AS msg_ FROM ev WHERE tie % 12 <> 11",
        "normalize_windows_ids": f"WITH {O.EV} SELECT tie AS line_no, {O._SEC} AS ts, " + _case(quoted(k[0] for k in known))
        + " AS action_, " + _case(quoted(k[1] for k in known)) + " AS status_, CAST(" + _case(WINDOWS_IDS) + " AS INT) AS event_id_, "
        "CASE tie % 4 WHEN 1 THEN 'u' || principal WHEN 2 THEN 's' || principal END AS user_, CASE WHEN tie % 3 <> 1 THEN src_ip "
        f"END AS src_ip_, CASE WHEN tie % 5 = 0 THEN 'said ' || tie ELSE {label} END AS msg_, 'p.exe' AS process_ FROM ev",
        "normalize_verdicts": f"WITH {O.EV} SELECT tie AS line_no, {O._SEC} AS ts, " + _case(quoted([*N.VERDICTS.values(), "info"]))
        + " AS status_, src_ip AS src_ip_, '10.10.4.22' AS dst_ip_, CASE WHEN tie % 3 <> 0 THEN port END AS port_, 'UDP' AS proto_, "
        f"lower({verdict}) || ' UDP ' || src_ip || ' -> 10.10.4.22' || CASE WHEN tie % 3 <> 0 THEN ':' || port ELSE '' END AS msg_ FROM ev",
        "sender_fallback": f"WITH {O.EV} SELECT tie AS line_no, CASE WHEN tie % 3 < 2 THEN src_ip ELSE '192.0.2.' || (tie % 250) END "
        "AS src_ip_ FROM ev",
    }
