"""SQL that gives the same results as each query, for an engine outside Spark."""

from __future__ import annotations

from emberwatch.driver.tables import EVENT_SELECT, NETWORK_STARTS
from emberwatch.operators.geo import SHIPPED_GEO

EV = f"ev AS (SELECT {', '.join(EVENT_SELECT)} FROM events)"

# white space as the log formats mean it, inside [...]
WS = (
    r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
    r"\x{3000}\x{FEFF}"
)


def _geo() -> str:
    rows = []
    for cidr, city, country, cc, lat, lon, org in SHIPPED_GEO:
        base, bits = cidr.split("/")
        n = 0
        for octet in base.split("."):
            n = n * 256 + int(octet)
        last = n + 2 ** (32 - int(bits)) - 1
        rows.append(
            f"({n}, {last}, {bits}, '{city}', '{country}', '{cc}', {lat}, {lon}, '{org}')"
        )
    return (
        "geo AS (SELECT * FROM (VALUES " + ", ".join(rows)
        + ") g(first_ip, last_ip, bits, city, country, cc, lat, lon, org))"
    )


def _ip(column: str) -> str:
    octets = [f"CAST(split_part({column}, '.', {i}) AS BIGINT)" for i in (1, 2, 3, 4)]
    return f"((({octets[0]} * 256 + {octets[1]}) * 256 + {octets[2]}) * 256 + {octets[3]})"


PLACED = (
    "placed AS (SELECT i.src_ip AS ip, arg_max(city, bits) AS city, "
    "arg_max(country, bits) AS country, arg_max(cc, bits) AS cc, arg_max(lat, bits) AS lat, "
    "arg_max(lon, bits) AS lon, arg_max(org, bits) AS org FROM (SELECT DISTINCT src_ip FROM ev) i "
    f"JOIN geo ON {_ip('i.src_ip')} BETWEEN first_ip AND last_ip GROUP BY i.src_ip)"
)
PRIVATE = (
    r"regexp_matches({c}, '^(10\.|192\.168\.|127\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)')"
)


def _span(ms: str) -> str:
    s = f"CAST(floor(({ms}) / 1000.0 + 0.5) AS BIGINT)"
    m = f"({s} // 60)"
    return (
        f"CASE WHEN ({ms}) < 1000 THEN ({ms}) || 'ms' WHEN {s} < 60 THEN {s} || 's' "
        f"WHEN {m} < 60 THEN {m} || 'm' || CASE WHEN {s} % 60 <> 0 THEN ({s} % 60) || 's' "
        f"ELSE '' END ELSE ({m} // 60) || 'h' || ({m} % 60) || 'm' END"
    )


def _ms(a: str, b: str) -> str:
    return f"(date_diff('microsecond', {a}, {b}) // 1000)"


# --- detectors ----------------------------------------------------------------------

_TALLIES = {
    "count": "count(*)",
    "distinct": "count(DISTINCT port)",
    "total": "sum(cents)",
}
BURSTS = {
    "burst_count": ("status = 'failure'", 72, 4, "count"),
    "burst_first_event": ("status = 'failure'", 24, 1, "count"),
    "burst_distinct": ("status = 'failure'", 96, 4, "distinct"),
    "burst_sum": ("status = 'failure'", 72, 20000, "total"),
    "by_ip": ("status = 'failure'", 24, 1, "count"),
    "burst_half": ("status = 'failure' AND ts < TIMESTAMP '2024-01-16'", 72, 4, "count"),
}
SEQUENCES = {
    "sequence_two": (48, [("error", 2), ("purchase", 1)]),
    "sequence_three": (72, [("view", 1), ("click", 1), ("purchase", 1)]),
}


def _burst_ctes(name: str, key: str = "principal") -> list[str]:
    """Evidence rows `{name}_e` (k, s, ev columns) of a burst."""
    where, hours, need, mode = BURSTS[name]
    return burst_ctes(name, where, f"{hours} HOUR", need, _TALLIES[mode], key)


def burst_ctes(n: str, where: str, window: str, need: int, tally: str, key: str) -> list[str]:
    """Evidence rows `{n}_e` (k, s, ev columns): windows of events whose tally reaches the need."""
    amount, unit = window.split()
    longer = f"INTERVAL '{amount} {unit.lower()}s 1 microsecond'"
    return [
        f"{n}_h AS (SELECT {key} AS k, * FROM ev WHERE {where})",
        f"{n}_q AS (SELECT DISTINCT k, ts FROM (SELECT k, ts, {tally} OVER "
        f"(PARTITION BY k ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL {window} "
        f"FOLLOWING) AS c FROM {n}_h) WHERE c >= {need})",
        f"{n}_x AS (SELECT k, ts, min(ts) OVER (PARTITION BY k ORDER BY ts RANGE BETWEEN "
        f"{longer} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt "
        f"FROM {n}_q)",
        f"{n}_s AS (SELECT k, min(ts) AS s FROM {n}_q GROUP BY k UNION ALL "
        f"SELECT x.k, x.nxt FROM {n}_s p JOIN {n}_x x ON x.k = p.k AND x.ts = p.s "
        "WHERE x.nxt IS NOT NULL)",
        f"{n}_e AS (SELECT p.s, h.* FROM {n}_s p JOIN {n}_h h ON h.k = p.k AND h.ts "
        f"BETWEEN p.s AND p.s + INTERVAL {window})",
    ]


def _sequence_ctes(name: str) -> list[str]:
    hours, steps = SEQUENCES[name]
    return sequence_ctes(name, f"{hours} HOUR", steps)


def sequence_ctes(
    n: str, window: str, steps: list[tuple[str, int]], key: str = "principal", base: str = "ev"
) -> list[str]:
    """Evidence rows `{n}_e` (k, s, step, ev columns) of a sequence of actions."""
    kinds = ", ".join(f"'{a}'" for a, _ in steps)
    ctes = [
        f"{n}_h AS (SELECT {key} AS k, row_number() OVER (PARTITION BY {key} "
        f"ORDER BY ts, tie) AS rn, * FROM {base} WHERE action IN ({kinds}))",
    ]
    later = ", ".join(
        f"min(CASE WHEN action = '{a}' THEN rn END) OVER (PARTITION BY k ORDER BY rn ROWS "
        f"BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_{i}"
        for i, (a, _) in enumerate(steps)
    )
    nth = ", ".join(
        f"CASE WHEN action = '{a}' THEN lead(rn, {need - 1}) OVER (PARTITION BY k, action "
        f"ORDER BY rn) END AS nth_{i}"
        for i, (a, need) in enumerate(steps)
    )
    ctes.append(f"{n}_w AS (SELECT *, {later}, {nth} FROM {n}_h)")
    joins, picks = [], ["a.rn AS p0"]
    at = "a"
    for i in range(len(steps)):
        joins.append(f"JOIN {n}_w n{i} ON n{i}.k = a.k AND n{i}.rn = {at}.nth_{i}")
        if i + 1 < len(steps):
            picks.append(f"f{i + 1}.rn AS p{i + 1}")
            joins.append(
                f"JOIN {n}_w f{i + 1} ON f{i + 1}.k = a.k AND f{i + 1}.rn = n{i}.next_{i + 1}"
            )
            at = f"f{i + 1}"
    final = f"n{len(steps) - 1}"
    ctes.append(
        f"{n}_o AS (SELECT a.k, a.ts AS s, {', '.join(picks)}, {final}.rn AS e FROM {n}_w a "
        f"{' '.join(joins)} WHERE a.action = '{steps[0][0]}' AND {final}.ts <= a.ts + "
        f"INTERVAL {window})"
    )
    ctes.append(
        f"{n}_x AS (SELECT a.k, a.p0, min(b.p0) AS nxt FROM {n}_o a JOIN {n}_o b ON b.k = a.k "
        "AND b.p0 > a.e GROUP BY a.k, a.p0)"
    )
    ctes.append(
        f"{n}_c AS (SELECT k, min(p0) AS p0 FROM {n}_o GROUP BY k UNION ALL SELECT x.k, x.nxt "
        f"FROM {n}_c c JOIN {n}_x x ON x.k = c.k AND x.p0 = c.p0)"
    )
    tests = []
    for i, (a, _) in enumerate(steps):
        upto = f"h.rn < o.p{i + 1}" if i + 1 < len(steps) else "h.rn <= o.e"
        tests.append(f"(h.action = '{a}' AND h.rn >= o.p{i} AND {upto})")
    ctes.append(
        f"{n}_e AS (SELECT o.s, h.* FROM {n}_c c JOIN {n}_o o ON o.k = c.k AND o.p0 = c.p0 "
        f"JOIN {n}_h h ON h.k = o.k AND ({' OR '.join(tests)}))"
    )
    return ctes


def _evidence_ctes(name: str) -> list[str]:
    return _burst_ctes(name) if name in BURSTS else _sequence_ctes(name)


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join([EV, *ctes]) + " "


def _burst(name: str, extra: str = "") -> str:
    return _with(*_burst_ctes(name)) + (
        "SELECT k AS entity_key, min(ts) AS first_seen, max(ts) AS last_seen, "
        f"count(*) AS events{extra} FROM {name}_e GROUP BY k, s"
    )


def _sequence(name: str) -> str:
    steps = SEQUENCES[name][1]
    per = ", ".join(
        f"count(*) FILTER (action = '{a}') AS step{i + 1}" for i, (a, _) in enumerate(steps)
    )
    return _with(*_sequence_ctes(name)) + (
        "SELECT k AS entity_key, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS "
        f"events, {per}, k AS last_user FROM {name}_e GROUP BY k, s"
    )


def _pipeline() -> str:
    names = [n for n in BURSTS if n not in ("by_ip", "burst_half")] + list(SEQUENCES)
    ctes = [c for n in names for c in _evidence_ctes(n)]
    return _with(*ctes) + " UNION ALL ".join(
        f"SELECT '{n}' AS rule_id, k AS entity_key, min(ts) AS first_seen, max(ts) AS "
        f"last_seen, count(*) AS events FROM {n}_e GROUP BY k, s"
        for n in names
    )


# --- travel -------------------------------------------------------------------------

_KM = (
    "2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + "
    "pow(sin(radians({b}lon - {a}lon) / 2), 2) * cos(radians({a}lat)) * cos(radians({b}lat)))))"
)
PAIRS = [
    _geo(),
    PLACED,
    "cand AS (SELECT principal AS k, * FROM ev WHERE status = 'success' AND NOT "
    + PRIVATE.format(c="src_ip") + ")",
    "prevs AS (SELECT *, lag(ts) OVER w AS p_ts, lag(tie) OVER w AS p_tie, lag(src_ip) OVER w "
    "AS p_ip FROM cand WINDOW w AS (PARTITION BY k ORDER BY ts, tie))",
    "pairs AS (SELECT * FROM (SELECT c.*, a.city || ', ' || a.cc AS from_place, b.city || ', ' "
    "|| b.cc AS to_place, " + _KM.format(a="a.", b="b.")
    + " AS km FROM prevs c JOIN placed a ON a.ip = c.p_ip JOIN placed b ON b.ip = c.src_ip "
    "WHERE c.p_ip <> c.src_ip AND c.ts > c.p_ts AND c.ts <= c.p_ts + INTERVAL 24 HOUR) "
    "WHERE km >= 700 AND km / (date_diff('microsecond', p_ts, ts) / 3600000000.0) >= 900)",
]
_KMH = "CAST(floor(km / (date_diff('microsecond', p_ts, ts) / 3600000000.0) + 0.5) AS BIGINT)"


def pair_rows(name: str) -> str:
    """Both events of each pair, as evidence rows."""
    return (
        f"{name} AS (SELECT p.p_ts AS s, p.tie AS by_tie, e.principal AS k, e.* FROM pairs p JOIN "
        "ev e ON e.principal = p.k AND e.tie IN (p.tie, p.p_tie))"
    )


_PAIR_ROWS = pair_rows("travel_e")


# --- alerts -------------------------------------------------------------------------


def _alert_ctes(source: str, hours: int, prefix: str) -> list[str]:
    return alert_ctes(source, f"{hours} HOUR", prefix)


def alert_ctes(source: str, window: str, p: str) -> list[str]:
    """`{p}_m` matches with their alert, `{p}_k` kept evidence per alert."""
    return [
        f"{p}_r AS (SELECT k, s, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n "
        f"FROM {source} GROUP BY k, s)",
        f"{p}_g AS (SELECT *, CASE WHEN first_ts <= max(last_ts) OVER (PARTITION BY k ORDER BY "
        f"s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL {window} THEN 0 "
        f"ELSE 1 END AS opens FROM {p}_r)",
        f"{p}_i AS (SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY s) AS island FROM {p}_g)",
        f"{p}_m AS (SELECT *, min(first_ts) OVER (PARTITION BY k, island) AS alert_ts, "
        f"count(*) OVER (PARTITION BY k, island) AS n_matches, row_number() OVER (PARTITION BY "
        f"k, island ORDER BY s DESC) AS from_last FROM {p}_i)",
        f"{p}_k AS (SELECT * FROM (SELECT m.alert_ts, m.n_matches, e.*, min(e.s) OVER "
        f"(PARTITION BY e.k, m.alert_ts, e.ts, e.raw) AS holder FROM {source} e JOIN {p}_m m "
        "ON m.k = e.k AND m.s = e.s) WHERE s = holder)",
    ]


def alert_id(rule: str, key: str = "k", ts: str = "alert_ts") -> str:
    return f"'{rule}::' || {key} || '::' || (epoch_us({ts}) // 1000)"


def _listed(p: str, column: str, n: int) -> str:
    return (
        f"(SELECT string_agg(v, ', ' ORDER BY seen_at) FROM (SELECT CAST({column} AS VARCHAR) AS v, "
        f"min(ts) AS seen_at, row_number() OVER (ORDER BY min(ts)) AS rn FROM {p}_k z WHERE z.k = "
        f"a.k AND z.alert_ts = a.alert_ts AND {column} IS NOT NULL GROUP BY 1) WHERE rn <= {n})"
    )


def _alerts() -> str:
    return (
        _with(*_burst_ctes("burst_count"), *_alert_ctes("burst_count_e", 72, "a"))
        + "SELECT " + alert_id("burst_count")
        + " AS alert_id, 'burst_count' AS rule_id, 'burst count' AS rule_name, 'high' AS "
        "severity, 'T1110' AS mitre_id, k AS entity_key, k AS entity_user, min(ts) AS "
        "first_seen, max(ts) AS last_seen, count(*) AS evidence_count, max(n_matches) AS "
        "n_matches, (SELECT string_agg(source, ',' ORDER BY seen_at) FROM (SELECT source, min(ts) AS "
        "seen_at FROM a_k z WHERE z.k = a_k.k AND z.alert_ts = a_k.alert_ts GROUP BY source)) AS "
        "sources FROM a_k GROUP BY k, alert_ts"
    )


def _narrative(name: str, headline: str, last: str = "NULL") -> str:
    """Headline over alias a (rolled alert) and l (values of the last match)."""
    if name == "geo_velocity":
        ctes, source, hours = [*PAIRS, _PAIR_ROWS], "travel_e", 24
        own = "SELECT p.p_ts AS s, p.k, p.* EXCLUDE (k) FROM pairs p"
    else:
        ctes, source = _evidence_ctes(name), f"{name}_e"
        hours = BURSTS[name][1] if name in BURSTS else SEQUENCES[name][0]
        own = f"SELECT k, s, {last} FROM {source} GROUP BY k, s"
    return (
        _with(
            *ctes,
            *_alert_ctes(source, hours, "a"),
            f"own AS ({own})",
            "a AS (SELECT k, alert_ts, count(*) AS n, max(n_matches) AS n_matches, min(ts) AS "
            "first_ts, max(ts) AS last_ts, arg_max(host, ts) AS last_host FROM a_k GROUP BY k, "
            "alert_ts)",
        )
        + f"SELECT {alert_id(name, 'a.k', 'a.alert_ts')} AS alert_id, a.n AS evidence_count, "
        f"a.n_matches, {headline} AS narrative FROM a JOIN a_m m ON m.k = a.k AND m.alert_ts = "
        "a.alert_ts AND m.from_last = 1 JOIN own l ON l.k = m.k AND l.s = m.s"
    )


_ALERT_RULES = {
    "burst_count": "high", "burst_distinct": "medium", "burst_sum": "critical",
    "sequence_two": "critical", "sequence_three": "low",
}


def _many_alerts(names: list[str]) -> list[str]:
    ctes = []
    for n in names:
        hours = BURSTS[n][1] if n in BURSTS else SEQUENCES[n][0]
        ctes += [*_evidence_ctes(n), *_alert_ctes(f"{n}_e", hours, f"{n}_a")]
    rows = " UNION ALL ".join(
        f"SELECT {alert_id(n)} AS alert_id, '{n}' AS rule_id, '{n.replace('_', ' ')}' AS "
        f"rule_name, '{_ALERT_RULES[n]}' AS severity, k AS entity_key, max(ts) AS last_seen, "
        f"count(*) AS evidence_count, list(DISTINCT source) AS sources, min(ts) AS first_seen, "
        f"max(n_matches) AS n_matches FROM {n}_a_k GROUP BY k, alert_ts"
        for n in names
    )
    return [*ctes, f"al AS ({rows})"]


_RANK = (
    "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 "
    "WHEN 'low' THEN 3 ELSE 4 END"
)


# --- raw lines ----------------------------------------------------------------------

_SEC = "date_trunc('second', ts)"
_LIST = {
    "ssh": (
        "tie % 50 <> 7",
        f"{_SEC}",
        {
            "action": "CASE action WHEN 'error' THEN 'login' WHEN 'purchase' THEN 'login' WHEN "
            "'click' THEN 'session_open' WHEN 'view' THEN 'disconnect' ELSE 'sudo' END",
            "status": "CASE action WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' "
            "WHEN 'click' THEN 'info' WHEN 'view' THEN 'info' ELSE 'success' END",
            "user": "'u' || principal",
            "src_ip": "CASE WHEN action IN ('error', 'purchase', 'view') THEN src_ip END",
            "port": "CASE WHEN action IN ('error', 'purchase', 'view') THEN port END",
            "host": "host",
            "process": "CASE WHEN action = 'signup' THEN '/bin/run ' || port END",
            "msg": "CASE action WHEN 'error' THEN CASE WHEN tie % 2 = 0 THEN 'failed auth for "
            "unknown account' ELSE 'failed auth' END WHEN 'purchase' THEN 'publickey auth "
            "accepted' WHEN 'click' THEN 'session opened' WHEN 'view' THEN 'disconnected' ELSE "
            "'sudo to app' END",
        },
    ),
    "web": (
        "true",
        f"{_SEC} - CASE WHEN tie % 2 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END",
        {
            "action": "'request'",
            "status": "CASE action WHEN 'error' THEN 'error' WHEN 'click' THEN 'failure' ELSE "
            "'success' END",
            "user": "CASE WHEN tie % 3 <> 0 THEN 'u' || principal END",
            "src_ip": "src_ip",
            "method": "CASE WHEN tie % 40 = 3 THEN '-' ELSE 'GET' END",
            "path": r"CASE WHEN tie % 40 = 3 THEN '\x16\x03' ELSE '/p/item x?k=' || port || ''' "
            "OR 1=1' END",
            "http_status": "CAST(CASE action WHEN 'error' THEN 503 WHEN 'click' THEN 404 ELSE "
            "200 END AS INT)",
            "bytes": "CASE WHEN tie % 6 <> 0 THEN cents END",
            "user_agent": "'agent/' || port",
            "msg": r"CASE WHEN tie % 40 = 3 THEN '- \x16\x03' ELSE 'GET /p%2Fitem+x?k=' || port "
            "|| ''' OR 1=1' END || ' -> ' || CASE action WHEN 'error' THEN '503' WHEN 'click' "
            "THEN '404' ELSE '200' END",
        },
    ),
    "windows": (
        "tie % 30 <> 11",
        _SEC,
        {
            "action": "CASE action WHEN 'error' THEN 'login' WHEN 'purchase' THEN 'login' WHEN "
            "'click' THEN 'priv_assigned' WHEN 'view' THEN 'wineventlog' ELSE 'log_cleared' END",
            "status": "CASE action WHEN 'error' THEN 'failure' WHEN 'view' THEN 'info' ELSE "
            "'success' END",
            "user": "CASE WHEN tie % 4 <> 0 THEN 'u' || principal END",
            "src_ip": "CASE WHEN tie % 7 <> 0 THEN src_ip END",
            "host": "host",
            "event_id": "CAST(CASE action WHEN 'error' THEN 4625 WHEN 'purchase' THEN 4624 WHEN "
            "'click' THEN 4672 WHEN 'view' THEN 5158 ELSE 1102 END AS INT)",
            "msg": "CASE action WHEN 'error' THEN 'account failed to log on' WHEN 'purchase' THEN "
            "'account logged on' WHEN 'click' THEN 'special privileges assigned to new logon' "
            "WHEN 'signup' THEN 'audit log cleared' END",
        },
    ),
    "netfilter": (
        "tie % 25 <> 2",
        _SEC,
        {
            "action": "'connection'",
            "status": "CASE action WHEN 'error' THEN 'blocked' WHEN 'view' THEN 'allowed' WHEN "
            "'click' THEN 'info' WHEN 'purchase' THEN 'blocked' ELSE 'info' END",
            "src_ip": "src_ip",
            "dst_ip": "'10.10.4.22'",
            "port": "port",
            "proto": "'TCP'",
            "host": "host",
            "bytes": "CAST(NULL AS BIGINT)",
            "msg": "CASE action WHEN 'error' THEN 'block' WHEN 'view' THEN 'allow' WHEN 'click' "
            "THEN 'audit' WHEN 'purchase' THEN 'drop' ELSE 'limit' END || ' TCP ' || src_ip || "
            "' -> 10.10.4.22:' || port",
        },
    ),
    "asa": (
        "tie % 20 <> 1",
        _SEC,
        {
            "action": "'connection'",
            "status": "CASE WHEN action = 'error' THEN 'blocked' ELSE 'allowed' END",
            "src_ip": "src_ip",
            "dst_ip": "CASE WHEN action = 'error' THEN '203.0.113.9' ELSE '77.83.36.19' END",
            "port": "port",
            "proto": "'TCP'",
            "host": "'fw-edge'",
            "bytes": "CASE WHEN action <> 'error' THEN cents END",
            "msg": "CASE WHEN action = 'error' THEN 'deny tcp ' || src_ip || ' -> 203.0.113.9:' "
            "|| port ELSE 'flow closed ' || src_ip || ' -> 77.83.36.19:' || port || ' ' || cents "
            "|| ' bytes' END",
        },
    ),
    "generic": (
        "true",
        f"CASE WHEN tie % 3 < 2 THEN {_SEC} END",
        {
            "action": "CASE tie % 3 WHEN 0 THEN action WHEN 1 THEN CASE WHEN tie % 2 = 0 THEN "
            "'login' ELSE 'traffic' END END",
            "status": "CASE tie % 3 WHEN 0 THEN status WHEN 1 THEN CASE WHEN action = 'error' "
            "THEN 'failure' ELSE 'success' END END",
            "user": "CASE WHEN tie % 3 < 2 THEN 'u' || principal END",
            "src_ip": "CASE WHEN tie % 3 < 2 THEN src_ip END",
            "host": "CASE WHEN tie % 3 < 2 THEN host ELSE 'localhost' END",
        },
    ),
}
_SOURCE = {
    "ssh": "'ssh'", "web": "'web'", "windows": "'windows'", "netfilter": "'firewall'",
    "asa": "'firewall'",
    "generic": "CASE tie % 3 WHEN 0 THEN 'json' WHEN 1 THEN CASE WHEN tie % 2 = 0 THEN 'sshd' "
    "ELSE 'app' END ELSE 'raw' END",
}


def _normalized(kind: str) -> str:
    usable, ts, fields = _LIST[kind]
    columns = ", ".join(f"{sql} AS {name}_" for name, sql in fields.items())
    return (
        f"WITH {EV} SELECT tie AS line_no, {ts} AS ts, {_SOURCE[kind]} AS source, {columns} "
        f"FROM ev WHERE {usable}"
    )


# what the rendered lines of each source lose
_SKIPPED = (
    "CASE source WHEN 'ssh' THEN tie % 50 = 7 WHEN 'windows' THEN tie % 30 = 11 "
    "WHEN 'firewall' THEN tie % 25 = 2 ELSE false END"
)
_FEED = (
    "CASE source WHEN 'ssh' THEN 'auth' WHEN 'web' THEN 'access' WHEN 'windows' THEN "
    "'security' ELSE 'ufw' END"
)
_SYSLOG_TS = "strftime(ts, '%b %-d %H:%M:%S')"
_SKIPPED_LINE = (
    f"CASE source WHEN 'ssh' THEN {_SYSLOG_TS} || ' ' || host || ' CRON[9]: "
    "pam_unix(cron:session): session opened for user root' WHEN 'windows' THEN "
    "'{\"@timestamp\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '\",\"event_id\":' || CASE "
    "action WHEN 'error' THEN '4625' WHEN 'purchase' THEN '4624' WHEN 'click' THEN '4672' WHEN "
    "'view' THEN '\"5158\"' ELSE '1102' END || ',\"computer\":\"' || host || '\",' || CASE WHEN "
    "tie % 4 = 0 THEN '\"target_user\":\"-\",' ELSE '\"target_user\":\"u' || principal || "
    "'\",' END || '\"user\":\"other\",\"ip\":\"' || CASE WHEN tie % 7 = 0 THEN '::1' ELSE src_ip "
    f"END || '\"' ELSE {_SYSLOG_TS} || ' ' || host || ' kernel: [UFW ' || CASE action WHEN "
    "'error' THEN 'BLOCK' WHEN 'view' THEN 'ALLOW' WHEN 'click' THEN 'AUDIT' WHEN 'purchase' THEN "
    "'DROP' ELSE 'LIMIT' END || '] IN=eth0 OUT=  DST=10.10.4.22 PROTO=UDP PROTO=TCP SPT=1 DPT=' "
    "|| port || ' WINDOW=1024 SYN' END"
)
# status of the event a rendered line becomes
_LINE_STATUS = (
    "CASE source WHEN 'ssh' THEN CASE action WHEN 'error' THEN 'failure' WHEN 'purchase' THEN "
    "'success' WHEN 'signup' THEN 'success' ELSE 'info' END WHEN 'web' THEN CASE action WHEN "
    "'error' THEN 'error' WHEN 'click' THEN 'failure' ELSE 'success' END WHEN 'windows' THEN CASE "
    "action WHEN 'error' THEN 'failure' WHEN 'view' THEN 'info' ELSE 'success' END ELSE CASE "
    "action WHEN 'error' THEN 'blocked' WHEN 'purchase' THEN 'blocked' WHEN 'view' THEN 'allowed' "
    "ELSE 'info' END END"
)
# what the auth, access and ufw lines of the events say
_PARSED_EV = (
    "ev AS (SELECT * REPLACE (date_trunc('second', ts) - CASE WHEN source = 'web' AND tie % 2 = 0 "
    f"THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS ts, {_LINE_STATUS} AS status, CASE WHEN "
    "source = 'ssh' OR source = 'web' AND tie % 3 <> 0 THEN 'u' || principal END AS principal, "
    "CASE WHEN source = 'web' AND tie % 6 <> 0 THEN cents END AS cents, raw || tie AS raw) "
    f"FROM given WHERE source <> 'windows' AND NOT {_SKIPPED})"
)

_SQLI = (
    rf"(?i)(union[{WS}/*]+select|select[^\n\r\x{{2028}}\x{{2029}}]+from[{WS}]+information_schema|"
    rf"\bor\b[{WS}]+1[{WS}]*=[{WS}]*1|sleep[{WS}]*\([{WS}]*[0-9]|benchmark[{WS}]*\(|"
    rf"'';[{WS}]*(drop|update|insert)[{WS}])"
)
_XSS = (
    rf"(?i)(<script|<[{WS}]*img[^>]+onerror|javascript:|onload[{WS}]*=|onerror[{WS}]*=|"
    r"<svg[^>]+on)"
)
_TRAVERSAL = r"(?i)(\.\./\.\./|/etc/passwd|/proc/self/environ|c:\\windows\\win.ini)"


def _buckets(n: int, columns: str) -> str:
    return (
        f"WITH {EV}, r AS (SELECT min(epoch_us(ts)) AS lo, CASE WHEN min(ts) = max(ts) THEN "
        "min(epoch_us(ts)) + 60000000 ELSE max(epoch_us(ts)) END AS hi FROM ev), "
        f"b AS (SELECT CAST(least({n - 1}, floor((epoch_us(ts) - lo) / ((hi - lo) / {n}.0))) AS "
        "INT) AS bucket, source FROM ev, r), "
        "c AS (SELECT bucket, count(*) FILTER (source = 'ssh') AS ssh, count(*) FILTER (source = "
        "'web') AS web, count(*) FILTER (source = 'windows') AS windows, count(*) FILTER (source "
        "= 'firewall') AS firewall, count(*) AS total FROM b GROUP BY bucket), "
        f"every AS (SELECT CAST(i AS INT) AS bucket, make_timestamp(CAST(trunc(lo + i * ((hi - "
        f"lo) / {n}.0)) AS BIGINT)) AS t0, make_timestamp(CAST(trunc(lo + (i + 1) * ((hi - lo) / "
        f"{n}.0)) AS BIGINT)) AS t1 FROM range({n}) g(i), r) "
        f"SELECT bucket, {columns}, coalesce(ssh, 0) AS ssh, coalesce(web, 0) AS web, "
        "coalesce(windows, 0) AS windows, coalesce(firewall, 0) AS firewall, coalesce(total, 0) "
        "AS total FROM every LEFT JOIN c USING (bucket)"
    )


def _tie(where: str) -> str:
    return f"WITH {EV} SELECT tie FROM ev WHERE {where}"


def oracle_sql() -> dict[str, str]:
    found = {
        **{n: _burst(n) for n in ("burst_count", "burst_first_event")},
        "burst_distinct": _burst("burst_distinct", ", count(DISTINCT port) AS distinct_values"),
        "burst_sum": _burst("burst_sum", ", CAST(sum(cents) AS BIGINT) AS total"),
        **{n: _sequence(n) for n in SEQUENCES},
        "geo_velocity": _with(*PAIRS)
        + "SELECT k AS entity_key, p_ts AS first_seen, ts AS last_seen, p_ip AS from_ip, src_ip "
        "AS to_ip, from_place, to_place, CAST(floor(km + 0.5) AS BIGINT) AS km, "
        f"{_KMH} AS kmh, {_span(_ms('p_ts', 'ts'))} AS gap FROM pairs",
        "detect_pipeline": _pipeline(),
        "alerts": _alerts(),
        "alert_narratives": _narrative(
            "burst_first_event",
            "a.n || ' failures by ' || a.k || ' in ' || "
            + _span(_ms("a.first_ts", "a.last_ts")) + " || ', last on ' || a.last_host",
            "count(*) AS own_n",
        ),
        "alert_narratives_ports": _narrative(
            "burst_count",
            "a.n || ' failures by ' || a.k || ' in ' || "
            + _span(_ms("a.first_ts", "a.last_ts")) + " || ' on ports ' || "
            + _listed("a", "port", 12),
            "count(*) AS own_n",
        ),
        "alert_narratives_sum": _narrative(
            "burst_sum",
            "CAST(CAST(floor(l.total * 10 / 1048576.0 + 0.5) / 10 AS DECIMAL(30,1)) AS VARCHAR) "
            "|| ' MB, ' || l.total || ' bytes by ' || a.k || ' across ' || a.n || ' events'",
            "CAST(sum(cents) AS BIGINT) AS total",
        ),
        "alert_narratives_sequence": _narrative(
            "sequence_two",
            "l.failed || ' failures then ' || l.bought || ' purchase by ' || a.k || ' in ' || "
            + _span(_ms("a.first_ts", "a.last_ts")),
            "count(*) FILTER (action = 'error') AS failed, count(*) FILTER (action = 'purchase') "
            "AS bought",
        ),
        "alert_narratives_travel": _narrative(
            "geo_velocity",
            "a.k || ' moved from ' || l.from_place || ' to ' || l.to_place || ' in ' || "
            + _span(_ms("l.p_ts", "l.ts")) + " || ': ' || CAST(floor(l.km + 0.5) AS BIGINT) || "
            "' km, ' || CAST(floor(l.km / (date_diff('microsecond', l.p_ts, l.ts) / "
            "3600000000.0) + 0.5) AS BIGINT) || ' km/h (' || a.n || ' events)'",
        ),
        "alert_evidence": _with(*PAIRS, _PAIR_ROWS, *_alert_ctes("travel_e", 24, "a"))
        + f"SELECT {alert_id('geo_velocity')} AS alert_id, tie, raw, src_ip FROM a_k",
        "recent_evidence": _with(
            *_burst_ctes("burst_first_event"), *_alert_ctes("burst_first_event_e", 24, "a")
        )
        + f"SELECT {alert_id('burst_first_event')} AS alert_id, tie FROM (SELECT *, row_number() "
        "OVER (PARTITION BY k, alert_ts ORDER BY ts DESC, tie DESC) AS rn FROM a_k) WHERE rn <= 14",
        "alert_order": _with(*_many_alerts(list(_ALERT_RULES)))
        + "SELECT alert_id, severity, last_seen, CAST(row_number() OVER (ORDER BY "
        f"{_RANK}, last_seen DESC, alert_id) AS INT) AS place FROM al",
        "alert_search": _with(*_many_alerts(list(_ALERT_RULES)))
        + "SELECT alert_id, severity, entity_key FROM al WHERE severity IN ('critical', 'high') "
        "AND rule_id LIKE 'sequence%' AND list_has_any(sources, ['windows', 'firewall'])",
        "alert_places": _with(
            _geo(), PLACED, *_burst_ctes("by_ip", "src_ip"), *_alert_ctes("by_ip_e", 24, "a")
        )
        + f"SELECT DISTINCT {alert_id('by_ip')} AS alert_id, k AS src_ip, city, cc FROM a_k LEFT "
        "JOIN placed ON ip = k",
        "new_alerts": _with(
            *_burst_ctes("burst_count"), *_alert_ctes("burst_count_e", 72, "a"),
            *_burst_ctes("burst_half"), *_alert_ctes("burst_half_e", 72, "b"),
        )
        + f"SELECT {alert_id('burst_count')} AS alert_id, count(*) AS evidence_count FROM a_k "
        "WHERE NOT EXISTS (SELECT 1 FROM b_k WHERE b_k.k = a_k.k AND b_k.alert_ts = a_k.alert_ts)"
        " GROUP BY k, alert_ts",
        "severity_mix": _with(*_many_alerts(list(_ALERT_RULES)))
        + "SELECT severity, count(alert_id) AS alerts, round(coalesce(count(alert_id) / nullif("
        "(SELECT count(*) FROM al), 0)::DOUBLE, 0), 6) AS share FROM (VALUES ('critical'), "
        "('high'), ('medium'), ('low'), ('info')) s(severity) LEFT JOIN al USING (severity) "
        "GROUP BY severity",
        "firing_rules": _with(*_many_alerts(list(_ALERT_RULES)))
        + "SELECT rule_id, rule_name, severity, count(*) AS alerts FROM al GROUP BY ALL",
        "armed_rules": _with(*_many_alerts(["burst_count", "burst_distinct", "sequence_three"]))
        + "SELECT rule_id, count(*) AS alerts FROM al GROUP BY rule_id",
        "rolling_suppressed": _with(
            "c AS (SELECT DISTINCT principal AS k, ts, n FROM (SELECT principal, ts, count(*) "
            "OVER (PARTITION BY principal ORDER BY ts RANGE BETWEEN INTERVAL 72 HOUR PRECEDING "
            "AND CURRENT ROW) AS n FROM ev WHERE status = 'failure') WHERE n >= 4)",
            "x AS (SELECT k, ts, min(ts) OVER (PARTITION BY k ORDER BY ts RANGE BETWEEN INTERVAL "
            "'72 hours 1 microsecond' FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM c)",
            "s AS (SELECT k, min(ts) AS ts FROM c GROUP BY k UNION ALL SELECT x.k, x.nxt FROM s "
            "JOIN x ON x.k = s.k AND x.ts = s.ts WHERE x.nxt IS NOT NULL)",
        )
        + "SELECT ts AS timestamp, 'brute-force' AS rule_id, 'high' AS severity, k AS entity, "
        "'Possible brute-force attack: ' || n || ' failed attempts from ' || k AS description, "
        "n AS event_count, 'T1110' AS mitre_id FROM s JOIN c USING (k, ts)",
        "range_tally": f"WITH {EV} SELECT principal, epoch_us(ts) AS t, count(*) OVER (PARTITION "
        "BY principal ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS "
        "trailing, count(*) OVER (PARTITION BY principal ORDER BY ts RANGE BETWEEN CURRENT ROW "
        "AND INTERVAL 24 HOUR FOLLOWING) AS leading FROM ev",
        "cidr_lookup": _with(_geo(), PLACED)
        + "SELECT tie, src_ip, city, country, cc, org FROM ev LEFT JOIN placed ON ip = src_ip",
        "cidr_lookup_custom": f"WITH {EV}, c AS (SELECT s_name, s_nationkey, 12 + s_suppkey % 13 AS bits, "
        "CASE s_suppkey % 5 " + " ".join(
            f"WHEN {i} THEN {int(a) * 16777216 + int(b) * 65536}::BIGINT" for i, (a, b) in enumerate(s.split(".")[:2] for s in NETWORK_STARTS)
        ) + " END + (s_suppkey % 256) * 256 AS n FROM supplier), g AS (SELECT *, CAST(pow(2, 32 - bits) AS BIGINT) AS size "
        "FROM c), h AS (SELECT bits, n - n % size AS lo, n - n % size + size - 1 AS hi, min((s_name, "
        "CAST(s_nationkey AS VARCHAR))) AS place FROM g GROUP BY ALL), e AS (SELECT tie, CASE WHEN tie % 11 <> 0 THEN src_ip "
        f"END AS src_ip FROM ev), p AS (SELECT i.src_ip AS ip, arg_max(place, bits) AS place FROM (SELECT DISTINCT src_ip FROM e "
        f"WHERE src_ip IS NOT NULL) i JOIN h ON {_ip('i.src_ip')} BETWEEN lo AND hi GROUP BY ALL) SELECT tie, src_ip, place[1] AS "
        "city, place[2] AS country FROM e LEFT JOIN p ON ip = src_ip",
        "address_functions": f"WITH {EV} SELECT tie, {_ip('src_ip')} AS number, CASE WHEN tie % 9 "
        f"= 0 THEN NULL WHEN tie % 9 = 1 AND CAST('9' || split_part(src_ip, '.', 1) AS BIGINT) > "
        f"255 THEN NULL WHEN tie % 9 = 1 THEN {_ip(chr(39) + '9' + chr(39) + ' || src_ip')} ELSE "
        f"{_ip('src_ip')} END AS broken_number, {PRIVATE.format(c='src_ip')} AS is_private, "
        f"{_ip('src_ip')} - {_ip('src_ip')} % 1024 AS base22 FROM ev",
        "great_circle": "SELECT o_orderkey, round("
        + _KM.format(a="a_", b="b_")
        + ", 3) AS km FROM (SELECT o_orderkey, (o_orderkey * 37 % 180) - 90.0::DOUBLE AS a_lat, "
        "(o_orderkey * 37 % 360) - 180.0::DOUBLE AS a_lon, (o_custkey * 37 % 180) - 90.0::DOUBLE "
        "AS b_lat, (o_custkey * 37 % 360) - 180.0::DOUBLE AS b_lon FROM orders)",
        "time_buckets": _buckets(60, "t0, t1"),
        "time_buckets_table": _buckets(12, "t0"),
        "top_talkers": _with(_geo(), PLACED)
        + "SELECT src_ip, events, first_seen, coalesce(city || ', ' || cc || ' · ' || org, 'not "
        "in geo table') AS place FROM (SELECT src_ip, count(*) AS events, min(ts) AS first_seen "
        "FROM ev GROUP BY src_ip ORDER BY events DESC, first_seen, src_ip LIMIT 8) t LEFT JOIN "
        "placed ON ip = src_ip",
        "event_totals": f"WITH {EV} SELECT min(ts) AS first_seen, max(ts) AS last_seen, count(*) "
        "AS events, count(DISTINCT src_ip) AS addresses FROM ev",
        "address_sketches": f"WITH {EV} SELECT source, count(DISTINCT src_ip) AS exact, true AS close FROM ev GROUP BY "
        "source UNION ALL SELECT 'all', count(DISTINCT src_ip), true FROM ev",
        "events_per_source": f"WITH {EV} SELECT source, count(*) AS events FROM ev GROUP BY source",
        "event_tail": f"WITH {EV} SELECT tie, ts, source, src_ip FROM ev ORDER BY ts DESC, tie "
        "DESC LIMIT 200",
        "event_search": f"WITH {EV} SELECT tie, source, msg FROM ev WHERE source IN ('ssh', "
        "'web') AND (coalesce(lower(msg), '') LIKE '%robot 1%')",
        "predicates_equality": _tie(
            "(action = 'error' AND port = 42) OR (http_status = 200 AND principal = '7') OR "
            "path = '/item/5'"
        ),
        "predicates_not_equal": _tie(
            "coalesce(http_status, 0) <> 200 AND coalesce(dst_ip, '') <> '10.10.4.3'"
        ),
        "predicates_compare": _tie(
            "(http_status >= 404 AND port < 20) OR (cents > 9000 AND port <= 5)"
        ),
        "predicates_regex": _tie(
            "coalesce(regexp_matches(path, '^/ITEM/[1-3]+$', 'i'), false) OR (NOT coalesce("
            "regexp_matches(path, 'item', 'i'), false) AND coalesce(regexp_matches(msg, 'robot "
            "1[0-9]$', 'i'), false))"
        ),
        "predicates_contains": _tie("coalesce(lower(path) LIKE '%tem/7%', false)"),
        "predicates_in": _tie(
            "http_status IN (200, 404) AND action IN ('view', 'error') AND port IN (1, 2, 3)"
        ),
        "predicates_exists": _tie("dst_ip IS NOT NULL AND path IS NULL"),
        "predicates_logic": _tie(
            "(source = 'ssh' AND status = 'failure') OR (source = 'web' AND action NOT IN "
            "('view', 'click'))"
        ),
        "predicates_unknown_field": _tie("action = 'signup'"),
        "signature_hits": "SELECT * FROM (SELECT kind, id, "
        f"regexp_matches(path, '{_SQLI}') AS sqli, regexp_matches(path, '{_XSS}') AS xss, "
        f"regexp_matches(path, '{_TRAVERSAL}') AS traversal FROM (SELECT 'page' AS kind, page_id "
        "AS id, concat_ws(' ', url, html) AS path FROM pages UNION ALL SELECT 'document', doc_id, "
        "text FROM documents)) WHERE sqli OR xss OR traversal",
        **{f"normalize_{kind}": _normalized(kind) for kind in _LIST},
        "skipped_lines": f"WITH {EV} SELECT {_FEED} AS feed, tie AS line_no, {_SKIPPED_LINE} AS "
        f"line FROM ev WHERE {_SKIPPED}",
        "feed_stats": f"WITH {EV} SELECT {_FEED} AS feed, count(*) AS lines, count(*) FILTER (NOT "
        f"{_SKIPPED}) AS events, count(*) FILTER ({_SKIPPED}) AS skipped FROM ev GROUP BY 1",
        "funnel": f"WITH RECURSIVE {EV.replace('ev AS', 'given AS', 1)}, {_PARSED_EV}, "
        + ", ".join(_many_alerts(["burst_count", "burst_sum"])) + " "
        + f"SELECT count(*) AS lines, count(DISTINCT {_FEED}) AS feeds, count(*) FILTER ("
        f"{_SKIPPED}) AS skipped, count(*) FILTER (NOT {_SKIPPED}) AS events, CAST(2 AS BIGINT) "
        "AS armed_rules, (SELECT count(*) FROM al) AS alerts, (SELECT count(*) FROM al WHERE "
        "severity = 'critical') AS critical, (SELECT count(*) FROM al WHERE severity = 'high') AS "
        "high FROM given WHERE source <> 'windows'",
        "classify_feeds": f"WITH {EV} SELECT DISTINCT {_FEED} AS feed, source AS parser FROM ev "
        f"UNION ALL SELECT 'document ' || doc_id, NULL FROM documents WHERE regexp_matches(text, '[^{WS}]')",
        "text_lines": "SELECT CAST(doc_id AS VARCHAR) AS feed, line_no, md5(line) AS digest FROM "
        "(SELECT doc_id, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS line FROM "
        "(SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS parts FROM documents)) WHERE "
        f"regexp_matches(line, '[^{WS}]')",
        "json_array": f"WITH {EV}, g AS (SELECT *, principal || '@' || CAST(CAST(ts AS DATE) AS "
        "VARCHAR) AS feed, count(*) FILTER (tie % 30 = 11) OVER (PARTITION BY principal, "
        "CAST(ts AS DATE)) AS broken FROM ev) SELECT feed, row_number() OVER (PARTITION BY feed "
        "ORDER BY tie) AS line_no, date_trunc('second', ts) AS ts, CAST(CASE action WHEN 'error' "
        "THEN 4625 WHEN 'purchase' THEN 4624 WHEN 'click' THEN 4672 WHEN 'view' THEN 5158 ELSE "
        "1102 END AS INT) AS event_id, host FROM g WHERE broken = 0",
        "json_array_files": f"WITH {EV}, g AS (SELECT *, tie % 16 AS file, count(*) FILTER (tie % 30 "
        "= 11 AND tie % 16 % 5 = 0) OVER (PARTITION BY tie % 16) AS broken FROM ev WHERE tie % 16 % 5 "
        "= 0 OR tie % 30 <> 11) SELECT CAST(file AS VARCHAR) AS feed, row_number() OVER (PARTITION BY "
        "file ORDER BY tie) AS line_no, date_trunc('second', ts) AS ts, CAST(CASE action WHEN 'error' "
        "THEN 4625 WHEN 'purchase' THEN 4624 WHEN 'click' THEN 4672 WHEN 'view' THEN 5158 ELSE 1102 "
        "END AS INT) AS event_id FROM g WHERE broken = 0 UNION ALL SELECT DISTINCT CAST(file AS "
        "VARCHAR), 1, CAST(NULL AS TIMESTAMP), CAST(NULL AS INT) FROM g WHERE broken > 0",
        "sniff_feeds": f"WITH {EV} SELECT DISTINCT {_FEED} AS feed, source AS parser FROM ev UNION "
        "ALL SELECT 'prose', NULL",
        "attack_phases": f"WITH {EV} SELECT action AS phase, source, {_LINE_STATUS} AS status, "
        f"count(*) AS events FROM ev WHERE NOT {_SKIPPED} GROUP BY ALL",
        "union_feeds": f"WITH {EV} SELECT action AS feed, CAST(CASE action WHEN 'view' THEN 0 "
        "ELSE 2 END AS INT) AS feed_order, ts, tie FROM ev WHERE action IN ('view', 'purchase')",
        "entity_keys": f"WITH {EV} SELECT tie, principal || '|' || path AS entity_key, principal "
        "AS entity_user, path AS entity_path FROM ev WHERE path IS NOT NULL AND port IS NOT NULL",
        "time_functions": f"WITH {EV} SELECT tie, CASE WHEN tie % 10 = 0 THEN TIMESTAMP "
        "'2024-03-02 00:00:00' + (date_trunc('second', ts) - date_trunc('day', ts)) ELSE "
        "date_trunc('second', ts) END AS syslog_ts, date_trunc('second', ts) + INTERVAL 90 MINUTE "
        "AS clf_ts, date_trunc('second', ts) AS clf_bare_ts, date_trunc('millisecond', ts) AS "
        "iso_ts, true AS bad_month FROM ev",
        "human_spans": f"SELECT o_orderkey, {_span('(o_orderkey * o_orderkey % 20000000)')} AS "
        "span FROM orders",
        "text_functions": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN "
        "l_linenumber % 2 = 0 THEN l_linenumber ELSE l_suppkey END AS VARCHAR) AS dpt, CAST(NULL "
        "AS VARCHAR) AS missing, CAST(NULL AS BIGINT) AS no_int, l_partkey AS spt, CAST(CAST(round("
        "CAST(round(l_extendedprice * 100) AS BIGINT) / 1048576.0::DECIMAL(20,1), 1) AS "
        "DECIMAL(30,1)) AS VARCHAR) AS mb FROM lineitem",
        "url_decode": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(replace(url, '/', "
        "'%2F'), 'e', '%65') || '%zz' WHEN 1 THEN replace(url, '+', ' ') || ' é' WHEN 2 THEN "
        "replace(replace(url, '/', '%2F'), 'e', '%65') || '%ff' ELSE replace(url, '+', ' ') END "
        "AS decoded FROM pages",
    }
    return found
