"""Window edges, folding, order, rolling alerts, and a key with most of the rows."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import brute
import pytest
from pyspark.sql import functions as F

from emberwatch.operators import blocks
from emberwatch.operators import explore as E
from emberwatch.operators import predicates as P
from emberwatch.operators.rolling import rolling_alerts
from emberwatch.plans import detect as D
from emberwatch.plans.rules import Burst, Rule
from emberwatch.sources import sinks

T0 = datetime(2025, 3, 12, 9, tzinfo=timezone.utc)
RULE = Rule(
    "test-burst", "Test burst", "high", "T1110", "Brute Force", "three in five minutes",
    "{count} failures from {src_ip} in {span}, {unknown}",
    Burst(P.eq("status", "failure"), ("src_ip",), timedelta(minutes=5), 3),
)
SCHEMA = (
    "ts timestamp, source string, action string, status string, src_ip string, raw string, "
    "feed_order int, line_no bigint"
)
CASES = {
    "run": [0, 0.5, 1, 1.5, 2, 2.5],
    "apart": [0, 0.5, 1, 40, 40.5, 41],
    "edge": [0, 2.5, 5],
    "past": [0, 2.5, 5 + 1 / 60000],
    "touch": [0, 1, 2, 7, 8, 9],
    "gap": [0, 1, 2, 7 + 1 / 60000, 8, 9],
}


def events_of(spark, times_by_ip):
    rows = [
        (T0 + timedelta(minutes=m), "windows" if i == 1 else "ssh", "login", "failure", ip,
         f"fail {m} {ip}", 0, i)
        for ip, minutes in times_by_ip.items()
        for i, m in enumerate(minutes)
    ]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def test_folding_and_edges(spark, tmp_path):
    alerts, kept = D.detect(events_of(spark, CASES), [RULE])
    found = alerts.collect()
    assert Counter(a.entity_key for a in found) == {
        "run": 1, "apart": 2, "edge": 1, "touch": 1, "gap": 2
    }
    by = {(a.entity_key, a.first_seen): a for a in found}
    first = T0.replace(tzinfo=None)
    run = by[("run", first)]
    assert (run.evidence_count, run.n_matches) == (6, 1)
    assert run.last_seen == first + timedelta(minutes=2.5)
    assert run.narrative == "6 failures from run in 2m30s, {unknown}"
    assert run.sources == ["ssh", "windows"]
    touch = by[("touch", first)]
    assert (touch.evidence_count, touch.n_matches) == (6, 2)
    assert touch.narrative.startswith("6 failures from touch in 9m")
    assert run.alert_id == f"test-burst::run::{int(T0.timestamp() * 1000)}"
    assert kept.count() == sum(a.evidence_count for a in found)
    path = str(tmp_path / "alerts")
    sinks.write_alerts(alerts.filter("entity_key = 'run'"), path)
    sinks.merge_alerts(alerts, path)
    sinks.merge_alerts(alerts, path)
    assert spark.read.parquet(path).count() == len(found)
    mix = {r.severity: (r.alerts, r.share) for r in E.severity_mix(alerts).collect()}
    assert mix["high"] == (len(found), 1.0) and mix["info"] == (0, 0.0)


def test_nothing_in_nothing_out(spark):
    none = events_of(spark, {"x": [0]}).filter("false")
    alerts, kept = D.detect(none, [RULE])
    assert alerts.count() == 0 and kept.count() == 0
    assert E.time_buckets(none).count() == 0
    assert E.severity_mix(alerts).filter("share <> 0").count() == 0


def test_buckets_of_one_instant(spark):
    rows = E.time_buckets(events_of(spark, {"x": [1], "y": [1]}), 12).collect()
    assert len(rows) == 12 and rows[0].total == 2 and sum(r.total for r in rows) == 2


@pytest.mark.parametrize("block", [250_000, 13])
def test_rolling(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", block)
    monkeypatch.setattr(blocks, "FAN", 2)
    rng = random.Random(5)
    times = {f"k{i}": [rng.randrange(0, 240) * 10 / 60 for _ in range(60)] for i in range(30)}
    got = Counter()
    for r in rolling_alerts(events_of(spark, times)).collect():
        got[(r.entity, int(r.timestamp.replace(tzinfo=timezone.utc).timestamp()), r.event_count)] += 1
    want = Counter()
    for key, minutes in times.items():
        seconds = sorted(round(m * 60) for m in minutes)
        quiet_until = None
        for i, t in enumerate(seconds):
            n = sum(1 for u in seconds[: i + 1] if u >= t - 300)
            if n >= 5 and (quiet_until is None or t > quiet_until):
                want[(key, int(T0.timestamp()) + t, n)] += 1
                quiet_until = t + 300
    assert got == want


def test_hot_key(spark, monkeypatch):
    """One key with nine tenths of the rows and no quiet time, against brute force."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 500)
    rng = random.Random(9)
    hot = [rng.randrange(0, 36_000) for _ in range(6_000)]
    rows = [("hot", t) for t in hot] + [
        (f"k{rng.randrange(50)}", rng.randrange(0, 36_000)) for _ in range(600)
    ]
    events = spark.createDataFrame(
        [(T0 + timedelta(seconds=t), "failure", ip, i) for i, (ip, t) in enumerate(rows)],
        "ts timestamp, status string, src_ip string, tie bigint",
    )
    found = D.evidence(events, [RULE]).groupBy("entity_key", "s_t").count().collect()
    got = Counter((r.entity_key, r["count"]) for r in found)
    want = Counter()
    for key in {ip for ip, _ in rows}:
        own = [dict(t=t, tie=i) for i, (ip, t) in enumerate(rows) if ip == key]
        for m in brute.bursts(own, 300, 3, len):
            want[(key, len(m))] += 1
    assert got == want
