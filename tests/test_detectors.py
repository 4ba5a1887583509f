"""Detectors against brute force on random keys, in one Spark run per detector.

Times are whole seconds over a few windows, with many ties, so that windows touch,
overlap and cross slice borders; dense keys never go quiet for a whole window.
"""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.operators import blocks, burst, kernels, membership
from emberwatch.operators import geo as G
from emberwatch.operators import predicates as P
from emberwatch.plans import detect as D
from emberwatch.plans.rules import Burst, Rule, Sequence, Step, Travel

BASE = 1_704_067_200
WITHIN = 20
SCHEMA = (
    "ts timestamp, source string, action string, status string, raw string, "
    "src_ip string, port int, user string, bytes bigint, path string, "
    "feed_order int, line_no bigint"
)
IPS = ["82.102.20.14", "103.21.244.10", "45.83.220.7", "10.1.1.1", "198.18.7.7", "82.102.21.9"]


def rule(name, detect, narrative="{count} in {span}"):
    return Rule(name, name, "high", "T1", "tag", "text", narrative, detect)


def random_rows(seed, keys=120):
    rng = random.Random(seed)
    rows = []
    for k in range(keys):
        length = rng.choice([30, 200, 600])
        n = rng.choice([3, 20, 60, 150])
        start = rng.randrange(0, 2000)
        for _ in range(n):
            rows.append(
                dict(
                    t=start + rng.randrange(length),
                    user=f"u{k}",
                    action=rng.choice("abcabx"),
                    status=rng.choice(["failure", "success"]),
                    port=rng.choice([None, 1, 2, 3, 4, 5]),
                    bytes=rng.choice([None, 0, 5, 10, 25]),
                    ip=rng.choice(IPS),
                )
            )
    for i, r in enumerate(rows):
        r["tie"] = i
        r["raw"] = f"{r['action']}{rng.randrange(4)}"
    return rows


def as_events(spark, rows):
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    return spark.createDataFrame(
        [
            (
                datetime.fromtimestamp(BASE + r["t"], timezone.utc), "ssh", r["action"],
                r["status"], r["raw"], r["ip"], r["port"], r["user"], r["bytes"], None, 0,
                r["tie"],
            )
            for r in shuffled
        ],
        SCHEMA,
    )


def by_key(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["user"]].append(r)
    return out


def got_evidence(rows):
    """(rule, key) -> list of matches, each a list of ties in order."""
    out = defaultdict(list)
    for r in rows.groupBy(*D.MATCH).agg(
        F.sort_array(F.collect_list(F.struct("t", "tie"))).alias("rows")
    ).collect():
        out[(r.rule_id, r.entity_key)].append([x.tie for x in r.rows])
    return {k: sorted(v) for k, v in out.items()}


def ties(matches):
    return sorted([r["tie"] for r in m] for m in matches)


W = timedelta(seconds=WITHIN)
FAIL = P.eq("status", "failure")
BURSTS = {
    "count4": (Burst(FAIL, ("user",), W, 4), 4, len),
    "count1": (Burst(FAIL, ("user",), W, 1), 1, len),
    "ports3": (
        Burst(FAIL, ("user",), W, 3, distinct="port"), 3,
        lambda rs: len({r["port"] for r in rs if r["port"] is not None}),
    ),
    "bytes50": (
        Burst(FAIL, ("user",), W, 50, total="bytes"), 50,
        lambda rs: sum(r["bytes"] or 0 for r in rs),
    ),
}
SEQUENCES = {
    "ab": [("a", 1), ("b", 1)],
    "a3b": [("a", 3), ("b", 1)],
    "a2b2c": [("a", 2), ("b", 2), ("c", 1)],
    "abc2": [("a", 1), ("b", 1), ("c", 2)],
    "only_a2": [("a", 2)],
}


def sequence_rules():
    return [
        rule(
            name,
            Sequence(
                ("user",), W,
                tuple(Step(f"s{i}", P.eq("action", a), n) for i, (a, n) in enumerate(steps)),
            ),
        )
        for name, steps in SEQUENCES.items()
    ]


@pytest.fixture(params=["whole", "blocks"])
def cut(request, monkeypatch):
    """Keys solved whole, and keys of over 25 rows cut into blocks that meet two at a time."""
    if request.param == "blocks":
        monkeypatch.setattr(blocks, "BLOCK_ROWS", 25)
        monkeypatch.setattr(blocks, "FAN", 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_bursts(spark, seed, cut):
    rows = random_rows(seed)
    rules = [rule(name, d) for name, (d, _, _) in BURSTS.items()]
    got = got_evidence(D.evidence(as_events(spark, rows), rules))
    want = {}
    for name, (_, need, tally) in BURSTS.items():
        for key, own in by_key(rows).items():
            found = brute.bursts([r for r in own if r["status"] == "failure"], WITHIN, need, tally)
            if found:
                want[(name, key)] = ties(found)
    assert got == want


@pytest.mark.parametrize("seed", [3, 4])
def test_sequences(spark, seed, cut):
    rows = random_rows(seed)
    got = got_evidence(D.evidence(as_events(spark, rows), sequence_rules()))
    want = {}
    for name, steps in SEQUENCES.items():
        tests = [(lambda r, a=a: r["action"] == a, n) for a, n in steps]
        for key, own in by_key(rows).items():
            found = brute.sequences(own, WITHIN, tests)
            if found:
                want[(name, key)] = ties(found)
    assert got == want


def test_steps_that_share_events(spark, cut):
    rows = random_rows(5)
    either = P.one_of("action", ["a", "b"])
    detect = Sequence(("user",), W, (Step("x", either, 2), Step("y", P.eq("action", "b"), 2)))
    got = got_evidence(D.evidence(as_events(spark, rows), [rule("s", detect)]))
    tests = [(lambda r: r["action"] in "ab", 2), (lambda r: r["action"] == "b", 2)]
    want = {
        ("s", k): ties(found)
        for k, own in by_key(rows).items()
        if (found := brute.sequences(own, WITHIN, tests))
    }
    assert got == want


def place(ip):
    import ipaddress

    best = None
    for cidr, _, _, _, lat, lon, _ in G.SHIPPED_GEO:
        net = ipaddress.ip_network(cidr)
        if ipaddress.ip_address(ip) in net and (best is None or net.prefixlen > best[0]):
            best = (net.prefixlen, (lat, lon))
    return best and best[1]


def test_travel(spark, cut):
    rows = random_rows(6)
    detect = Travel(FAIL, ("user",), W, 700, 100_000)
    got = got_evidence(D.evidence(as_events(spark, rows), [rule("t", detect)]))
    want = {}
    for key, own in by_key(rows).items():
        kept = [r for r in own if r["status"] == "failure" and not r["ip"].startswith("10.")]
        found = brute.travels(kept, WITHIN, 700, 100_000, 3600, place)
        if found:
            want[("t", key)] = ties(found)
    assert want and got == want


def test_alerts(spark, cut):
    rows = random_rows(7, keys=60)
    rules = [
        rule("count4", BURSTS["count4"][0], "{count} from {user} in {span} {ports}"),
        *sequence_rules(),
        rule("t", Travel(FAIL, ("user",), W, 700, 100_000)),
    ]
    alerts, kept = D.detect(as_events(spark, rows), rules)
    found = alerts.collect()
    got = {(a.rule_id, a.entity_key): [] for a in found}
    for a in found:
        got[(a.rule_id, a.entity_key)].append(
            (int(a.first_seen.replace(tzinfo=timezone.utc).timestamp()) - BASE,
             int(a.last_seen.replace(tzinfo=timezone.utc).timestamp()) - BASE,
             a.evidence_count, a.n_matches)
        )
    want = defaultdict(list)
    for key, own in by_key(rows).items():
        fails = [r for r in own if r["status"] == "failure"]
        sets = {"count4": brute.bursts(fails, WITHIN, 4, len)}
        for name, steps in SEQUENCES.items():
            tests = [(lambda r, a=a: r["action"] == a, n) for a, n in steps]
            sets[name] = brute.sequences(own, WITHIN, tests)
        public = [r for r in fails if not r["ip"].startswith("10.")]
        sets["t"] = brute.travels(public, WITHIN, 700, 100_000, 3600, place)
        for name, matches in sets.items():
            for group in brute.fold(matches, WITHIN):
                rows_ = brute.merged(group)
                want[(name, key)].append(
                    (rows_[0]["t"], max(m[-1]["t"] for m in group), len(rows_), len(group))
                )
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    counts = {r.alert_id: r["count"] for r in kept.groupBy("alert_id").count().collect()}
    assert counts == {a.alert_id: a.evidence_count for a in found}


def followed(maps, entry):
    """Bound by bound: the first one above the entry gives the way out."""
    for bounds, outs in maps:
        entry = next((o for b, o in zip(bounds, outs) if b > entry), entry)
    return entry


def test_composed_maps():
    rng = random.Random(6)
    for _ in range(200):
        maps, low = [], 0
        for _ in range(rng.randrange(1, 6)):
            bounds = sorted(rng.sample(range(low, low + 30), rng.randrange(1, 8)))
            outs = sorted(b + rng.randrange(0, 20) for b in bounds)
            maps.append((np.array(bounds), np.array(outs)))
            low = bounds[0] + rng.randrange(0, 25)
        hi, out = blocks.composed(maps)
        assert (np.diff(hi) > 0).all() and (len(maps) == 1 or (np.diff(out) != 0).all())
        for entry in range(-1, low + 60):
            assert blocks.through(hi, out, np.array([entry]))[0] == followed(maps, entry)


def test_pointer_doubling():
    rng = random.Random(7)
    for m in (0, 1, 5, 60):
        following = np.array([rng.randrange(i + 1, m + 1) for i in range(m)], dtype=np.int64)
        for first in range(m + 1):
            want, at = [], first
            while at < m:
                want.append(at)
                at = following[at]
            assert kernels.chain(following, first).tolist() == want
        ends = kernels.chain_ends(following)
        assert [kernels.chain(following, i)[-1] for i in range(m)] == ends.tolist()


def test_million_ticks_of_one_key(spark, monkeypatch):
    """A key that never goes quiet, with a million distinct times, in blocks of 20,000."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 20_000)
    n, w = 1_000_000, 20_000_000
    at = F.col("id") * 700_000 + F.pmod(F.hash("id"), F.lit(699_999))
    hits = spark.range(n).select(
        F.lit("r").alias("rule_id"), F.lit("k").alias("entity_key"), F.lit(w).cast("long").alias("w"),
        F.lit(30).cast("long").alias("need"), F.lit(False).alias("counts_values"), at.cast("long").alias("t"),
        F.lit(None).cast("string").alias("counted"), F.lit(1).cast("long").alias("amount"),
    )
    found = burst.labels(hits, blocks.hot_keys(hits))
    got = found.groupBy("s_t").agg(F.count(F.lit(1)).alias("n")).toPandas().set_index("s_t").n.to_dict()
    t = np.sort(np.array([r.t for r in hits.select("t").collect()]))
    last = np.searchsorted(t, t + w, side="right")
    want, i = {}, 0
    while i < n:
        if last[i] - i >= 30:
            want[t[i]] = last[i] - i
            i = last[i]
        else:
            i += 1
    assert len(want) > 1_000 and got == want


def test_hot_key_inside_eight_windows(spark, monkeypatch):
    """All rows of a key in eight windows, with ties: several tasks, the same bursts and sequences."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 300)
    rng = random.Random(12)
    rows = [
        dict(t=rng.randrange(8 * WITHIN), user="hot", action=rng.choice("abcabx"), status="failure",
             port=rng.choice([None, *range(9)]), bytes=rng.randrange(30), ip="82.102.20.14")
        for _ in range(4_000)
    ]
    for i, r in enumerate(rows):
        r["tie"], r["raw"] = i, str(i)
    events = as_events(spark, rows)
    rules = [*(rule(name, d) for name, (d, _, _) in BURSTS.items()), *sequence_rules()]
    hits = D.fan_out(events, rules)
    assert blocks.hot_keys(hits).count() == len(rules)
    got = got_evidence(D.evidence(events, rules))
    want = {(n, "hot"): ties(brute.bursts(rows, WITHIN, need, tally)) for n, (_, need, tally) in BURSTS.items()}
    for name, steps in SEQUENCES.items():
        tests = [(lambda r, a=a: r["action"] == a, n) for a, n in steps]
        want[(name, "hot")] = ties(brute.sequences(rows, WITHIN, tests))
    assert got == want
    pieces, most = blocks._pieces(
        hits.filter("rule_id = 'count1'").withColumn("w", F.lit(WITHIN * 10**6).cast("long"))
        .repartitionByRange(6, "rule_id", "entity_key", "t").withColumn("block", F.spark_partition_id())
    )
    assert most >= 5 and pieces.count() == most


def test_bitmap_keeps_members(spark):
    rows = spark.range(5_000).select("id", F.concat(F.lit("k"), F.col("id") % 100).alias("key"))
    marks = membership.bitmap(rows.filter("id % 10 = 3"), ["id", "key"])
    kept = {r.id for r in membership.maybe_in(rows, ["id", "key"], marks).collect()}
    members = set(range(3, 5_000, 10))
    assert members <= kept and len(kept) < len(members) + 100


def test_many_labels_take_the_bitmap(spark, monkeypatch):
    rows = random_rows(1)
    rules = [rule(name, d) for name, (d, _, _) in BURSTS.items()] + sequence_rules()
    want = got_evidence(D.evidence(as_events(spark, rows), rules))
    monkeypatch.setattr(D, "MANY_BYTES", 0)
    assert got_evidence(D.evidence(as_events(spark, rows), rules)) == want


def test_no_order_is_an_error(spark):
    events = as_events(spark, random_rows(1, keys=2)).drop("line_no")
    with pytest.raises(ValueError, match="tie"):
        D.fan_out(events, sequence_rules())
