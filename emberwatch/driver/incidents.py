"""Raw log lines of all formats at the scale of minutes, through the shipped rules; and the SQL for it.

The `events` table becomes twelve scenes, one per shipped rule: every twelfth event belongs to the
same scene, and episodes of a hundred events come at three paces, so that each rule has keys that
fire and keys that stay just below. The lines are rendered in the format of their source and parsed
again; the SQL works on the fields that the lines were made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.driver import oracles as O
from emberwatch.driver import tables as T
from emberwatch.operators.staging import staged
from emberwatch.plans import detect as D
from emberwatch.plans.rules import Burst, Sequence, Travel, shipped_rules
from emberwatch.sources import normalize as N

#: Seconds from one episode to the next.
EPISODE = 10_800

# Plain enough to mean the same to Spark and to the checking engine.
_SCENE = (
    "SELECT event_id AS tie, event_type AS kind, user_id, CAST(round(value * 100) AS BIGINT) AS money, "
    "event_id % 12 AS r, user_id % 4 AS actor, CAST(floor(event_id / 1200.0) AS BIGINT) % 2800 AS episode, "
    "CAST(floor((event_id % 1200) / 12.0) AS BIGINT) AS k FROM events"
)
_FIELDS = [
    "tie", "r",
    "1709251200 + episode * 10800 + k * (CASE episode % 3 WHEN 0 THEN 2 WHEN 1 THEN 30 ELSE 100 END) + r AS sec",
    "CASE WHEN r IN (0, 1, 7) THEN 'ssh' WHEN r = 8 THEN CASE WHEN tie % 24 < 12 THEN 'ssh' ELSE 'windows' END "
    "WHEN r IN (2, 11) THEN 'firewall' WHEN r IN (9, 10) THEN 'windows' ELSE 'web' END AS source",
    "CASE WHEN r IN (0, 1, 7) THEN 'login' WHEN r = 8 THEN CASE WHEN tie % 24 < 12 THEN 'sudo' ELSE 'priv_assigned' END "
    "WHEN r IN (2, 11) THEN 'connection' WHEN r = 9 THEN CASE kind WHEN 'error' THEN 'group_change' ELSE 'login' END "
    "WHEN r = 10 THEN CASE kind WHEN 'error' THEN 'log_cleared' ELSE 'login' END ELSE 'request' END AS action",
    "CASE WHEN r = 0 THEN CASE kind WHEN 'purchase' THEN 'success' ELSE 'failure' END WHEN r = 1 THEN 'failure' "
    "WHEN r = 2 THEN CASE kind WHEN 'purchase' THEN 'allowed' ELSE 'blocked' END WHEN r = 11 THEN 'allowed' "
    "WHEN r = 3 THEN CASE kind WHEN 'purchase' THEN 'success' ELSE 'failure' END "
    "WHEN r = 8 AND tie % 24 < 12 AND kind = 'error' THEN 'failure' ELSE 'success' END AS status",
    "CASE WHEN r = 7 THEN CASE user_id % 6 WHEN 0 THEN '82.102.20.' WHEN 1 THEN '103.21.244.' WHEN 2 THEN "
    "'45.83.220.' WHEN 3 THEN '203.0.113.' WHEN 4 THEN '10.0.0.' ELSE '198.18.77.' END || CAST(actor + 1 AS STRING) "
    "WHEN r = 8 AND tie % 24 < 12 THEN NULL "
    "ELSE '198.18.' || CAST(r AS STRING) || '.' || CAST(actor + 1 AS STRING) END AS src_ip",
    "CASE WHEN r = 2 THEN 1000 + k % 70 WHEN r = 11 THEN 443 END AS port",
    "CASE WHEN r = 0 THEN 'root' WHEN r = 1 THEN 'user' || CAST(user_id % 9 AS STRING) WHEN r = 7 THEN 'roam' || "
    "CAST(actor AS STRING) WHEN r = 8 THEN 'ops' || CAST(actor AS STRING) WHEN r = 9 THEN 'adm' || CAST(user_id % 40 AS "
    "STRING) WHEN r = 10 THEN 'sys' || CAST(actor AS STRING) END AS principal",
    "CASE WHEN r = 10 THEN 'dc-' || CAST(user_id % 30 AS STRING) WHEN r IN (3, 4, 5, 6) THEN NULL ELSE 'gate' END AS host",
    "CASE WHEN r = 3 THEN '/old/' || CAST(k % 70 AS STRING) "
    "WHEN r = 4 THEN CASE WHEN kind = 'error' AND actor < 3 THEN '/item?id=7 union select name' ELSE '/item?id=7' END "
    "WHEN r = 5 THEN CASE WHEN kind = 'error' AND actor < 3 THEN '/say?t=<script>go()</script>' ELSE '/say?t=script' END "
    "WHEN r = 6 THEN CASE WHEN kind = 'error' AND actor < 3 THEN '/get?f=../../etc/hosts' ELSE '/get?f=../hosts' END END AS path",
    "CASE WHEN r = 3 THEN CASE kind WHEN 'purchase' THEN 200 ELSE 404 END WHEN r IN (4, 5, 6) THEN 200 END AS http_status",
    "CASE WHEN r = 11 THEN money * 400 WHEN r IN (3, 4, 5, 6) THEN 512 END AS cents",
    "CASE WHEN r = 8 THEN 4672 WHEN r = 9 THEN CASE WHEN kind = 'error' THEN CASE tie % 3 WHEN 0 THEN 4728 WHEN 1 THEN "
    "4732 ELSE 4720 END ELSE 4624 END WHEN r = 10 THEN CASE kind WHEN 'error' THEN 1102 ELSE 4624 END END AS win_id",
    "CAST(tie AS STRING) AS raw",
]


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenes' fields, one row per event, with a time."""
    T.events(spark, sf_dir).createOrReplaceTempView("events")
    rows = spark.sql(f"SELECT {', '.join(_FIELDS)} FROM ({_SCENE})")
    return rows.withColumn("ts", F.timestamp_seconds("sec").cast("timestamp_ntz")).drop("sec")


def lines(rows: DataFrame) -> DataFrame:
    """Each scene's row as a line of its source's format."""
    c, text = F.col, T._text
    stamp = text(F.date_format("ts", "MMM d HH:mm:ss"), " ")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    sudo = F.when(
        c("status") == "failure", text(stamp, "gate sudo: ", c("principal"), " : 3 incorrect password attempts ; TTY=pts/0 ; "
                                       "PWD=/ ; USER=root ; COMMAND=/bin/id"),
    ).otherwise(text(stamp, "gate sudo: ", c("principal"), " : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/id"))
    ssh = F.when(c("r") == 8, sudo).otherwise(
        # the process number tells lines apart that are alike else, as `raw` does
        text(stamp, "gate sshd[", c("raw"), "]: ", F.when(c("status") == "success", "Accepted").otherwise("Failed"), " password for ",
             c("principal"), " from ", c("src_ip"), " port 50022 ssh2")
    )
    web = text(
        c("src_ip"), " - - [", F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), ' +0000] "GET ', F.replace("path", F.lit(" "), F.lit("+")),
        ' HTTP/1.1" ', c("http_status"), ' 512 "-" "agent"',
    )
    windows = text(
        '{"@timestamp":"', iso, '","event_id":', c("win_id"), ',"computer":"', c("host"), '","target_user":"', c("principal"),
        '","ip":"', c("src_ip"), '"}',
    )
    scan = text(
        stamp, "gate kernel: [UFW ", F.when(c("status") == "blocked", "BLOCK").otherwise("ALLOW"), "] IN=eth0 OUT= SRC=", c("src_ip"),
        " DST=10.0.0.9 PROTO=TCP SPT=1 DPT=", c("port"), " SYN",
    )
    flow = text(
        stamp, "gate %ASA-6-302014: Teardown TCP connection 41 for inside:", c("src_ip"), "/44112 to outside:77.83.36.19/443 "
        "duration 0:00:31 bytes ", c("cents"), " TCP FINs",
    )
    line = F.when(c("source") == "ssh", ssh).when(c("source") == "web", web).when(c("source") == "windows", windows)
    line = line.when(c("r") == 2, scan).otherwise(flow)
    return rows.select(
        F.lit("replayed").alias("feed"), F.lit(0).alias("feed_order"), c("tie").alias("line_no"), c("source").alias("parser"),
        F.year("ts").alias("year"), line.alias("line"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.events(N.parse_routed(lines(scenes(spark, sf_dir)), F.col("year"))).drop("year")


_COLUMNS = ["alert_id", "rule_id", "severity", "mitre_id", "entity_key", "first_seen", "last_seen", "evidence_count", "n_matches"]


def _shipped(*kinds: type):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = [r for r in shipped_rules() if isinstance(r.detect, kinds)]
        found, _ = D.detect(events(spark, sf_dir), rules)
        return T.plain_time(found.select(*_COLUMNS))

    return run


def shipped_near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per shipped rule: episodes of a key with events that matter to it, and those that begin an alert."""
    parsed, rules = staged(events(spark, sf_dir)), shipped_rules()
    found, _ = D.detect(parsed, rules)
    part = ["rule_id", "entity_key", "episode"]
    episode = lambda t: F.floor(t / (EPISODE * 1_000_000)).alias("episode")
    matter = D.fan_out(parsed, rules).select(*part[:2], episode(F.col("t"))).distinct()
    fired = found.select(*part[:2], episode(F.unix_micros("first_seen"))).distinct().withColumn("fired", F.lit(1))
    return matter.join(fired, part, "left").groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("episodes"), F.count("fired").alias("firing")
    )


def queries() -> dict:
    return {
        "shipped_rules": _shipped(Burst, Sequence, Travel),
        "shipped_burst_rules": _shipped(Burst),
        "shipped_sequence_rule": _shipped(Sequence),
        "shipped_travel_rule": _shipped(Travel),
        "shipped_near_misses": shipped_near_misses,
    }


# --- SQL --------------------------------------------------------------------------------

_EV = (
    f"ev AS (SELECT * EXCLUDE (sec), make_timestamp(CAST(sec * 1000000 AS BIGINT)) AS ts FROM (SELECT {', '.join(_FIELDS)} "
    f"FROM ({_SCENE}) scene) f)"
)
# rule id -> (where, key, window, need, tally)
_BURSTS = {
    "ssh-password-spray": ("source = 'ssh' AND status = 'failure'", "src_ip", "10 MINUTE", 6, "count(DISTINCT principal)"),
    "firewall-port-scan": ("source = 'firewall' AND status = 'blocked'", "src_ip", "5 MINUTE", 15, "count(DISTINCT port)"),
    "web-content-discovery": ("source = 'web' AND http_status = 404", "src_ip", "5 MINUTE", 20, "count(DISTINCT path)"),
    "web-sqli": ("path LIKE '%union select%'", "src_ip", "10 MINUTE", 1, "count(*)"),
    "web-xss": ("path LIKE '%<script%'", "src_ip", "10 MINUTE", 1, "count(*)"),
    "web-path-traversal": ("path LIKE '%../../%'", "src_ip", "10 MINUTE", 1, "count(*)"),
    "privilege-escalation-burst": (
        "action = 'priv_assigned' OR (action = 'sudo' AND status = 'success')", "principal", "5 MINUTE", 6, "count(*)"
    ),
    "admin-group-change": ("source = 'windows' AND win_id IN (4728, 4732, 4720)", "principal", "15 MINUTE", 1, "count(*)"),
    "audit-log-cleared": ("source = 'windows' AND win_id = 1102", "host", "1 HOUR", 1, "count(*)"),
    "data-exfil-volume": (
        "source = 'firewall' AND status = 'allowed' AND cents IS NOT NULL AND r = 11", "src_ip", "10 MINUTE", 20_000_000, "sum(cents)"
    ),
}
_FAILED, _ACCEPTED = "source = 'ssh' AND status = 'failure'", "source = 'ssh' AND action = 'login' AND status = 'success'"
_WINDOW = {**{n: b[2] for n, b in _BURSTS.items()}, "ssh-brute-force": "10 MINUTE", "impossible-travel": "4 HOUR"}


def _name(rule_id: str) -> str:
    return rule_id.replace("-", "_")


def _evidence(rule_id: str) -> list[str]:
    """Evidence rows `{name}_e` (k, s, event columns) of a shipped rule."""
    n = _name(rule_id)
    if rule_id in _BURSTS:
        where, key, window, need, tally = _BURSTS[rule_id]
        return O.burst_ctes(n, f"({where}) AND {key} IS NOT NULL", window, need, tally, key)
    if rule_id == "ssh-brute-force":
        steps = f"CASE WHEN {_FAILED} THEN 'failed' WHEN {_ACCEPTED} THEN 'accepted' END"
        base = f"{n}_b AS (SELECT * REPLACE ({steps} AS action) FROM ev)"
        return [base, *O.sequence_ctes(n, "10 MINUTE", [("failed", 8), ("accepted", 1)], "src_ip", f"{n}_b")]
    travel = [
        c.replace("INTERVAL 24 HOUR", "INTERVAL 4 HOUR").replace("WHERE status = 'success'", "WHERE status = 'success' AND action = 'login'")
        for c in O.PAIRS
    ]
    return [*travel, O.pair_rows(f"{n}_e")]


def _alerts_of(rule_ids: list[str]) -> list[str]:
    about = {r.id: r for r in shipped_rules()}
    ctes = [c for n in rule_ids for c in (*_evidence(n), *O.alert_ctes(f"{_name(n)}_e", _WINDOW[n], f"{_name(n)}_a"))]
    rows = " UNION ALL ".join(
        f"SELECT {O.alert_id(n)} AS alert_id, '{n}' AS rule_id, '{about[n].severity}' AS severity, '{about[n].mitre_id}' AS mitre_id, "
        "k AS entity_key, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS evidence_count, max(n_matches) AS n_matches "
        f"FROM {_name(n)}_a_k GROUP BY k, alert_ts"
        for n in rule_ids
    )
    return [_EV, *ctes, f"al AS ({rows})"]


def oracle_sql() -> dict[str, str]:
    every = [r.id for r in shipped_rules()]
    of = lambda kind: [r.id for r in shipped_rules() if isinstance(r.detect, kind)]
    alerts = lambda ids: "WITH RECURSIVE " + ", ".join(_alerts_of(ids)) + " SELECT * FROM al"
    matters = {
        **{n: (b[0], b[1]) for n, b in _BURSTS.items()},
        "ssh-brute-force": (f"({_FAILED}) OR ({_ACCEPTED})", "src_ip"),
        "impossible-travel": (
            "action = 'login' AND status = 'success' AND src_ip IS NOT NULL AND NOT " + O.PRIVATE.format(c="src_ip"), "principal"
        ),
    }
    episode = lambda ts: f"CAST(floor(epoch_us({ts}) / {EPISODE * 1_000_000}.0) AS BIGINT)"
    keys = " UNION ALL ".join(
        f"SELECT DISTINCT '{n}' AS rule_id, {key} AS k, {episode('ts')} AS episode FROM ev WHERE ({where}) AND {key} IS NOT NULL"
        for n, (where, key) in matters.items()
    )
    return {
        "shipped_rules": alerts(every),
        "shipped_burst_rules": alerts(of(Burst)),
        "shipped_sequence_rule": alerts(of(Sequence)),
        "shipped_travel_rule": alerts(of(Travel)),
        "shipped_near_misses": "WITH RECURSIVE " + ", ".join([*_alerts_of(every), f"keys AS ({keys})"])
        + " SELECT rule_id, count(*) AS episodes, count(*) FILTER ((rule_id, k, episode) IN (SELECT (rule_id, entity_key, "
        f"{episode('first_seen')}) FROM al)) AS firing FROM keys GROUP BY rule_id",
    }
