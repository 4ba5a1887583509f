"""Normalisers: line tables to event tables, with unusable lines kept aside.

Each parser is a narrow projection over the line: no shuffle, one regex pass per
captured form. `parse` gives every input line with a nullable `event` struct;
`events` and `skipped` read the two sides of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch import schema
from emberwatch.functions import text as X
from emberwatch.functions import times
from emberwatch.functions.text import ANY, END, NS, S, group

def _line() -> Column:
    return F.col("line")


def _event_if(usable: Column, event: Column) -> Column:
    """The event where the line is usable.

    The partition id, which is never negative, keeps the optimizer from moving filters
    on the event below the parse: a moved filter would repeat every regex it rests on.
    """
    return F.when(usable & (F.spark_partition_id() >= 0), event).alias("event")




# --- SSH and sudo ---------------------------------------------------------------

# Fixed values, here and for the other formats below: the patterns that decide whether a
# line is an event of the format at all, or is skipped.
_SYSLOG = rf"^(\w{{3}}){S}+(\d{{1,2}}){S}+(\d{{2}}:\d{{2}}:\d{{2}}){S}+({NS}+){S}+"
_SSH_HEADER = rf"{_SYSLOG}([\w.\-/]+)(?:\[(\d+)\])?:{S}*({ANY}*){END}"

_PEER = rf"({NS}+) from ({NS}+) port (\d+)"
_LEAVER = rf"(?:authenticating user ({NS}+) )?({NS}+) port (\d+)"

# The message forms, first match wins. Each is (literal start, pattern,
# action, status, user, src_ip, port, msg); '$n' is a captured group. Starts exclude
# each other except where repeated, so a line tries the patterns of one start only.
_SSH_FORMS = [
    ("Accepted ", rf"^Accepted (\w+) for (?:invalid user )?{_PEER}",
     "login", "success", "$2", "$3", "$4", "$1 auth accepted"),
    ("Failed ", rf"^Failed (\w+) for invalid user {_PEER}",
     "login", "failure", "$2", "$3", "$4", "failed auth for unknown account"),
    ("Failed ", rf"^Failed (\w+) for {_PEER}",
     "login", "failure", "$2", "$3", "$4", "failed auth"),
    ("Invalid user ", rf"^Invalid user ({NS}+) from ({NS}+)(?: port (\d+))?",
     "invalid_user", "failure", "$1", "$2", "$3", "unknown account probed"),
    ("error: maximum ",
     rf"^error: maximum authentication attempts exceeded for (?:invalid user )?{_PEER}",
     "login", "failure", "$1", "$2", "$3", "max auth attempts exceeded"),
    ("pam_unix(sshd:auth)",
     rf"^pam_unix\(sshd:auth\): authentication failure;{ANY}*rhost=({NS}+){S}+user=({NS}+)",
     "login", "failure", "$2", "$1", "", "pam authentication failure"),
    ("pam_unix(sshd:session)",
     rf"^pam_unix\(sshd:session\): session opened for user ({NS}+)",
     "session_open", "info", "$1", "", "", "session opened"),
    ("pam_unix(sshd:session)",
     rf"^pam_unix\(sshd:session\): session closed for user ({NS}+)",
     "session_close", "info", "$1", "", "", "session closed"),
    ("Connection closed by ", rf"^Connection closed by {_LEAVER}",
     "disconnect", "info", "$1", "$2", "$3", "connection closed"),
    ("Disconnected from ", rf"^Disconnected from {_LEAVER}",
     "disconnect", "info", "$1", "$2", "$3", "disconnected"),
]


def _ssh_message(rest: Column) -> Column:
    """[_, action, status, user, src_ip, port, msg] of a message, one item if unknown."""
    out = F.lit(None).cast("array<string>")
    for i, (start, pattern, *slots) in reversed(list(enumerate(_SSH_FORMS))):
        taken = X.capture(rest, pattern, *slots)
        last_of_start = all(later[0] != start for later in _SSH_FORMS[i + 1 :])
        test = rest.startswith(start) if last_of_start else rest.rlike(pattern)
        out = F.when(test, taken).otherwise(out)
    return out


# Fixed value.
_SUDO_DENIED = r"incorrect password attempt|authentication failure|not in the sudoers"


def parse_ssh(lines: DataFrame, year: int | Column) -> DataFrame:
    """OpenSSH and sudo lines. Other programs and unknown messages have no event."""
    h, prog, rest, m = (F.col(c) for c in ("_h", "_prog", "_rest", "_m"))
    is_sudo = prog.startswith("sudo")
    denied = rest.rlike(_SUDO_DENIED)
    sudo = F.array(
        F.lit(""),
        F.lit("sudo"),
        F.when(denied, "failure").otherwise("success"),
        X.extract(rest, rf"^({NS}+){S}*:"),
        F.lit(""),
        F.lit(""),
        F.when(denied, F.lit("sudo denied")).otherwise(
            F.concat(F.lit("sudo to "), F.coalesce(X.kv_last(X.words(rest), "USER"), F.lit("root")))
        ),
    )
    staged = (
        lines.withColumn("_h", X.capture(_line(), _SSH_HEADER, *X.groups(7)))
        .withColumns({"_prog": group(h, 5), "_rest": group(h, 7)})
        .withColumns(
            {
                "_ts": times.syslog_time(group(h, 1), group(h, 2), group(h, 3), year),
                "_m": F.when(is_sudo, sudo).when(
                    prog.startswith("sshd"), X.apart(rest, _ssh_message)
                ),
            }
        )
    )
    command = F.when(
        is_sudo & rest.rlike("COMMAND="),
        X.trim(X.extract(rest, rf"COMMAND=({ANY}*){END}")),
    )
    event = schema.event_struct(
        ts=F.col("_ts"),
        source=F.lit("ssh"),
        action=group(m, 1),
        status=group(m, 2),
        raw=_line(),
        host=group(h, 4),
        user=X.nonempty(group(m, 3)),
        src_ip=X.nonempty(group(m, 4)),
        port=X.safe_int(group(m, 5), "int"),
        process=command,
        msg=group(m, 6),
    )
    usable = F.col("_ts").isNotNull() & (F.size("_m") > 1)
    return staged.select(*lines.columns, _event_if(usable, event))


# --- Web access logs ------------------------------------------------------------

# Fixed values.
_COMBINED = (
    rf'^({NS}+){S}+({NS}+){S}+({NS}+){S}+\[([^\]]+)\]{S}+"([^"]*)"{S}+(\d{{3}}){S}+'
    rf'(\d+|-)(?:{S}+"([^"]*)"{S}+"([^"]*)")?'
)
_REQUEST = rf"^([A-Z]+){S}+({ANY}*?)(?:{S}+(HTTP/[\d.]+))?{END}"


def http_outcome(code: Column) -> Column:
    """Status word of an HTTP code."""
    return (
        F.when(code >= 500, "error").when(code >= 400, "failure").otherwise("success")
    )


def parse_web(lines: DataFrame) -> DataFrame:
    """NCSA combined lines; the request is one quoted blob, spaces and all."""
    h, r = F.col("_h"), F.col("_r")

    def dash(c: Column) -> Column:
        return F.nullif(X.nonempty(c), F.lit("-"))

    staged = (
        lines.withColumn("_h", X.apart(_line(), lambda c: X.capture(c, _COMBINED, *X.groups(9))))
        .withColumn("_clock", X.trim(group(h, 4)))
        .withColumn("_r", X.apart(group(h, 5), lambda c: X.capture(c, _REQUEST, *X.groups(3))))
        .withColumns(
            {
                "_ts": times.clf_time(F.col("_clock")),
                "_code": group(h, 6).try_cast("int"),
                "_method": F.coalesce(group(r, 1), F.lit("-")),
                "_path": F.coalesce(group(r, 2), group(h, 5)),
            }
        )
        .withColumn("_decoded", X.apart(F.col("_path"), X.url_decode))
    )
    event = schema.event_struct(
        ts=F.col("_ts"),
        source=F.lit("web"),
        action=F.lit("request"),
        status=http_outcome(F.col("_code")),
        raw=_line(),
        src_ip=group(h, 1),
        user=dash(group(h, 3)),
        method=F.col("_method"),
        path=F.col("_decoded"),
        http_status=F.col("_code"),
        bytes=X.safe_int(dash(group(h, 7))),
        user_agent=dash(group(h, 9)),
        msg=F.concat(
            F.col("_method"), F.lit(" "), F.col("_path"), F.lit(" -> "),
            F.col("_code").cast("string"),
        ),
    )
    return staged.select(*lines.columns, _event_if(F.col("_ts").isNotNull(), event))


# --- Windows security JSON ------------------------------------------------------

# Event id -> (action, status, label).
WINDOWS_EVENTS = {
    4624: ("login", "success", "account logged on"),
    4625: ("login", "failure", "account failed to log on"),
    4634: ("logoff", "info", "account logged off"),
    4648: ("login", "info", "logon with explicit credentials"),
    4672: ("priv_assigned", "success", "special privileges assigned to new logon"),
    4688: ("process_create", "info", "new process created"),
    4720: ("account_created", "success", "user account created"),
    4728: ("group_add", "success", "member added to security-enabled global group"),
    4732: ("group_add", "success", "member added to security-enabled local group"),
    4740: ("account_lockout", "failure", "user account locked out"),
    1102: ("log_cleared", "success", "audit log cleared"),
    7045: ("service_install", "success", "service installed"),
}
_WINDOWS_JSON = (
    "`@timestamp` string, timestamp string, event_id string, EventID string, "
    "computer string, target_user string, subject_user string, user string, "
    "ip string, src_ip string, process string, message string"
)


def json_object(text: Column, ddl: str) -> Column:
    """One JSON object as a struct, NULL unless the whole text is one valid object.

    The text is read as the only item of an array, so that trailing text is an error.
    """
    items = F.from_json(
        F.concat(F.lit("["), text, F.lit("]")),
        f"array<struct<{ddl}>>",
        {"allowSingleQuotes": "false"},
    )
    trimmed = F.btrim(text)
    shaped = F.when(trimmed.startswith("{") & trimmed.endswith("}"), items)
    return F.when(F.size(shaped) == 1, F.get(shaped, F.lit(0)))


def parse_windows(lines: DataFrame) -> DataFrame:
    """Windows Security events as JSON objects, one per line."""
    o = F.col("_o")
    table = F.create_map(
        *(
            c
            for key, (action, status, label) in WINDOWS_EVENTS.items()
            for c in (
                F.lit(key),
                F.struct(
                    F.lit(action).alias("action"),
                    F.lit(status).alias("status"),
                    F.lit(label).alias("label"),
                ),
            )
        )
    )
    number = X.trim(F.coalesce(o["event_id"], o["EventID"])).try_cast("double")
    staged = (
        lines.withColumn("_o", json_object(_line(), _WINDOWS_JSON))
        .withColumns(
            {
                "_ts": times.iso_time(
                    X.nonempty(F.coalesce(o["@timestamp"], o["timestamp"]))
                ),
                "_id": F.when(F.abs(number) < 2147483648.0, number.cast("int")),
                "_whole": number == F.floor(number),
            }
        )
        .withColumn("_known", F.when(F.col("_whole"), F.try_element_at(table, F.col("_id"))))
    )
    known = F.col("_known")
    user = F.coalesce(o["target_user"], o["user"], o["subject_user"])
    ip = F.coalesce(o["ip"], o["src_ip"])
    event = schema.event_struct(
        ts=F.col("_ts"),
        source=F.lit("windows"),
        action=F.coalesce(known["action"], F.lit("wineventlog")),
        status=F.coalesce(known["status"], F.lit("info")),
        raw=_line(),
        event_id=F.col("_id"),
        host=o["computer"],
        msg=F.coalesce(o["message"], known["label"]),
        user=F.nullif(X.nonempty(user), F.lit("-")),
        src_ip=F.when(~ip.isin("-", "::1", ""), ip),
        process=X.nonempty(o["process"]),
    )
    usable = F.col("_ts").isNotNull() & F.col("_id").isNotNull()
    return staged.select(*lines.columns, _event_if(usable, event))


# --- Firewalls ------------------------------------------------------------------

# Fixed values.
_FW_HEADER = rf"{_SYSLOG}({ANY}*){END}"
_NETFILTER = rf"^kernel:{S}*\[?(UFW|IPTABLES){S}+([A-Z]+)\]?{S}*({ANY}*){END}"
_ASA_DENY = (
    rf"%ASA-\d-106023:{S}*Deny{S}+(\w+){S}+src{S}+{NS}+:([\d.]+)/(\d+){S}+dst{S}+"
    rf"{NS}+:([\d.]+)/(\d+)"
)
_ASA_TEARDOWN = (
    rf"%ASA-\d-302014:{S}*Teardown{S}+(\w+){S}+connection{S}+\d+{S}+for{S}+{NS}+:"
    rf"([\d.]+)/(\d+){S}+to{S}+{NS}+:([\d.]+)/(\d+){S}+duration{S}+{NS}+{S}+bytes{S}+(\d+)"
)

# Netfilter verdict -> status.
VERDICTS = {
    "BLOCK": "blocked",
    "DENY": "blocked",
    "DROP": "blocked",
    "REJECT": "blocked",
    "ALLOW": "allowed",
    "ACCEPT": "allowed",
    "AUDIT": "info",
}


def verdict_status(verdict: Column) -> Column:
    """Status word of a netfilter verdict; unknown verdicts are informational."""
    out = F.lit("info")
    for word, status in VERDICTS.items():
        out = F.when(verdict == word, F.lit(status)).otherwise(out)
    return out


def parse_firewall(lines: DataFrame, year: int | Column) -> DataFrame:
    """Netfilter/UFW kernel lines, else the two ASA messages; anything else is skipped."""
    h, rest, u, m = (F.col(c) for c in ("_h", "_rest", "_u", "_m"))
    src, dst, dpt, proto = (F.col(c) for c in ("_src", "_dst", "_dpt", "_proto"))
    lit = F.lit
    netfilter = F.array(
        lit(""),
        verdict_status(group(u, 2)),
        proto,
        src,
        dst,
        dpt,
        lit(None).cast("string"),
        F.concat(
            F.lower(group(u, 2)), lit(" "), F.coalesce(proto, lit("ip")), lit(" "),
            src, lit(" -> "), F.coalesce(dst, lit("?")),
            F.coalesce(F.concat(lit(":"), X.nonempty(dpt)), lit("")),
        ),
    )

    def deny(text: Column) -> Column:
        return X.capture(
            text, rf"^{ANY}*?{_ASA_DENY}",
            "blocked", "$1", "$2", "$4", "$5", "", "deny $1 $2 -> $4:$5",
        )

    def teardown(text: Column) -> Column:
        return X.capture(
            text, rf"^{ANY}*?{_ASA_TEARDOWN}",
            "allowed", "$1", "$2", "$4", "$5", "$6", "flow closed $2 -> $4:$5 $6 bytes",
        )

    staged = (
        lines.withColumn("_h", X.capture(_line(), _FW_HEADER, *X.groups(5)))
        .withColumn("_rest", group(h, 5))
        .withColumns(
            {
                "_ts": times.syslog_time(group(h, 1), group(h, 2), group(h, 3), year),
                "_u": F.when(
                    rest.startswith("kernel:"), X.capture(rest, _NETFILTER, *X.groups(3))
                ),
            }
        )
        .withColumn("_words", X.words(group(u, 3)))
        .withColumns(
            {
                f"_{key.lower()}": X.kv_last(F.col("_words"), key)
                for key in ("SRC", "DST", "DPT", "PROTO")
            }
        )
        .withColumn(
            "_m",
            F.when(X.nonempty(src).isNotNull(), netfilter)
            .when(rest.contains("-106023:") & rest.rlike(_ASA_DENY), X.apart(rest, deny))
            .when(rest.contains("-302014:"), X.apart(rest, teardown)),
        )
    )
    event = schema.event_struct(
        ts=F.col("_ts"),
        source=lit("firewall"),
        action=lit("connection"),
        status=group(m, 1),
        raw=_line(),
        host=group(h, 4),
        proto=F.when(F.col("_src").isNotNull(), group(m, 2)).otherwise(F.upper(group(m, 2))),
        src_ip=group(m, 3),
        dst_ip=group(m, 4),
        port=X.safe_int(group(m, 5), "int"),
        bytes=X.safe_int(group(m, 6)),
        msg=group(m, 7),
    )
    usable = F.col("_ts").isNotNull() & (F.size("_m") > 1)
    return staged.select(*lines.columns, _event_if(usable, event))


# --- Generic collector lines ----------------------------------------------------

# Also the field names and words below.
_GENERIC_SYSLOG = (
    rf"^(?:<(\d{{1,3}})>)?([A-Za-z]{{3}}{S}+\d+{S}+[\d:]+|\d{{4}}-\d{{2}}-\d{{2}}T[\d:.]+Z?)"
    rf"{S}+({NS}+){S}+([^:{X.WS}\[]+)(?:\[(\d+)\])?:{S}*([^\n]*){END}"
)
_GENERIC_JSON = (
    "timestamp string, time string, source string, host string, hostname string, "
    "src_ip string, client_ip string, ip string, dst_ip string, user string, "
    "username string, action string, status string"
)
_FAILURE_WORDS = "fail|invalid|denied|error|drop"


def parse_generic(lines: DataFrame, year: int | Column, sender: str | None = None) -> DataFrame:
    """Collector lines: a JSON object, else a syslog line, else raw text.

    Every non-blank line is an event. Event time comes from the line (it is NULL when
    the line has none). `sender` names a column with the sending address, used where a
    line gives no source address.
    """
    o, h, msg = F.col("_o"), F.col("_h"), F.col("_msg")

    def either(*names: str) -> Column:
        return F.coalesce(*(X.nonempty(o[n]) for n in names))

    stamp = X.capture(
        group(h, 2), rf"^([A-Za-z]{{3}}){S}+(\d+){S}+(\d+:\d+:\d+){END}", *X.groups(3)
    )
    staged = (
        lines.withColumn("_text", X.apart(_line(), X.trim))
        .withColumn("_o", json_object(F.col("_text"), _GENERIC_JSON))
        .withColumn(
            "_h",
            F.when(
                o.isNull(),
                X.apart(
                    F.col("_text"), lambda c: X.capture(c, _GENERIC_SYSLOG, *X.groups(6))
                ),
            ),
        )
        .withColumns({"_msg": group(h, 6), "_stamp": stamp})
    )
    st = F.col("_stamp")
    is_json = o.isNotNull()
    is_syslog = F.size(h) > 1

    def pick(json: Column, syslog: Column, raw: Column) -> Column:
        return F.when(is_json, json).when(is_syslog, syslog).otherwise(raw)

    none = F.lit(None).cast("string")
    src = pick(
        either("src_ip", "client_ip", "ip"),
        X.nonempty(F.regexp_extract(msg, r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0)),
        none,
    )
    event = schema.event_struct(
        ts=pick(
            times.iso_time(either("timestamp", "time")),
            F.coalesce(
                times.syslog_time(group(st, 1), group(st, 2), group(st, 3), year),
                times.iso_time(group(h, 2)),
            ),
            F.lit(None).cast("timestamp"),
        ),
        source=pick(F.coalesce(o["source"], F.lit("json")), group(h, 4), F.lit("raw")),
        host=pick(
            F.coalesce(X.nonempty(o["host"]), o["hostname"], F.lit("unknown")),
            group(h, 3),
            F.lit("localhost"),
        ),
        src_ip=F.coalesce(src, F.col(sender)) if sender else src,
        dst_ip=F.when(is_json, o["dst_ip"]),
        user=pick(
            either("user", "username"),
            X.nonempty(
                F.regexp_extract(msg, r"\bfor (?:invalid user )?([a-zA-Z0-9_\-]+)", 1)
            ),
            none,
        ),
        action=pick(
            o["action"],
            F.when(F.contains(group(h, 4), F.lit("sshd")), "login").otherwise("traffic"),
            none,
        ),
        status=pick(
            o["status"],
            F.when(F.lower(msg).rlike(_FAILURE_WORDS), "failure").otherwise("success"),
            none,
        ),
        raw=F.col("_text"),
    )
    return staged.select(*lines.columns, _event_if(F.col("_text") != "", event))


# --- Routing --------------------------------------------------------------------

PARSERS: dict[str, Callable[..., DataFrame]] = {
    "ssh": parse_ssh,
    "web": lambda lines, year: parse_web(lines),
    "windows": lambda lines, year: parse_windows(lines),
    "firewall": parse_firewall,
}


def parse(lines: DataFrame, parser: str, year: int | Column) -> DataFrame:
    """Lines with a nullable `event`, through the named parser."""
    if parser not in PARSERS:
        raise ValueError(f"no such parser: {parser}")
    return PARSERS[parser](lines, year=year)


def parse_routed(lines: DataFrame, year: int | Column, column: str = "parser") -> DataFrame:
    """Each line through the parser named in its `parser` column, in one scan.

    Lines that name no known parser have no event. `year` is that of year-less times, also of each
    line by a column.
    """
    out = lines.withColumnRenamed("line", "_full")
    for name in PARSERS:
        own = F.when(F.col(column) == name, F.col("_full"))
        out = (
            parse(out.withColumn("line", own), name, year)
            .withColumnRenamed("event", f"_event_{name}")
            .drop("line")
        )
    return out.withColumnsRenamed({"_full": "line"}).select(
        *lines.columns, F.coalesce(*(f"_event_{name}" for name in PARSERS)).alias("event")
    )


def events(parsed: DataFrame) -> DataFrame:
    """The usable lines as events with their lineage columns."""
    lineage = [c for c in parsed.columns if c not in ("event", "line")]
    return parsed.filter(F.col("event").isNotNull()).select("event.*", *lineage)


def skipped(parsed: DataFrame) -> DataFrame:
    """The non-blank lines without an event."""
    keep = [c for c in parsed.columns if c != "event"]
    return parsed.filter(F.col("event").isNull() & ~X.blank(_line())).select(*keep)
