"""Batch and stream agree, whatever the micro-batches and however late the rows."""

import random
from datetime import timedelta

import test_detectors as TD
from pyspark.sql import functions as F

from emberwatch.plans import detect as D
from emberwatch.plans.rules import Travel, shipped_rules
from emberwatch.sources import lines as L
from emberwatch.sources import normalize as N
from emberwatch.streaming import ingest
from emberwatch.streaming.detector import StreamDetector


def test_matches_equal_batch(spark, tmp_path):
    rows = TD.random_rows(11, keys=40)
    text = "{count} in {span} from {user} on {ports} {paths} {distinct} {sum}"
    rules = [
        *(TD.rule(n, d, text) for n, (d, _, _) in TD.BURSTS.items()),
        *TD.sequence_rules(),
        TD.rule("t", Travel(TD.FAIL, ("user",), TD.W, 700, 100_000), "{from} to {to} in {gap}, {km} at {kmh}"),
    ]
    # a last row far in the future lets every span settle
    flush = dict(rows[0], t=100_000, user="flush", tie=len(rows), status="success", action="z")
    events = TD.as_events(spark, [*rows, flush])
    batch_alerts, kept = D.detect(events, rules)
    want = TD.got_evidence(kept)
    rng = random.Random(2)
    late = 40
    arrival = sorted(rows, key=lambda r: r["t"] + rng.random() * late) + [flush]
    detector = StreamDetector(rules, str(tmp_path / "state"), timedelta(seconds=late))
    cuts = [0, len(rows) // 3, 2 * len(rows) // 3, len(arrival)]
    source = tmp_path / "in"
    source.mkdir()
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = TD.as_events(spark, arrival[a:b])
        part.coalesce(1).write.parquet(str(source / f"part{i}"))
        stream = spark.readStream.schema(part.schema).parquet(str(source / "part*"))
        query = detector.start(stream, str(tmp_path / "checkpoint"), availableNow=True)
        query.awaitTermination()
        assert query.exception() is None
    got = TD.got_evidence(detector.evidence(spark))
    assert got == want
    columns = [
        "alert_id", "evidence_count", "n_matches", "narrative", "first_seen", "last_seen", "sources",
        F.to_json("entity"),
    ]
    want = sorted(batch_alerts.select(*columns).collect())
    assert sorted(detector.alerts(spark).select(*columns).collect()) == want
    assert sorted(detector.alerts(spark, settled=False).select(*columns).collect()) == want


def test_lines_stream_through_their_parsers(spark, tmp_path):
    source = tmp_path / "steps"
    source.mkdir()
    steps = [
        ("Recon", "firewall", "Mar 12 12:05:00 w kernel: [UFW BLOCK] SRC=1.2.3.4 DST=5.6.7.8 DPT=21"),
        ("Access", "ssh", "Mar 12 12:06:00 w sshd[1]: Failed password for a from 1.2.3.4 port 1 ssh2"),
        ("Access", "ssh", "Mar 12 12:06:00 w sshd[1]: Failed password for a from 1.2.3.4 port 1 ssh2"),
        ("Access", "ssh", "noise"),
    ]
    spark.createDataFrame(steps, "phase string, parser string, line string").coalesce(
        1
    ).write.json(str(source / "a"))
    lines = ingest.stream_steps(spark, str(source / "*"))
    events = ingest.without_repeats(ingest.stream_events(lines, 2025), "1 hour")
    query = (
        events.writeStream.format("memory").queryName("steps_out")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {(r.phase, r.source, r["count"]) for r in
           spark.table("steps_out").groupBy("phase", "source").count().collect()}
    assert got == {("Recon", "firewall", 1), ("Access", "ssh", 1)}


def test_text_stream(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.log").write_text(
        '1.2.3.4 - - [12/Mar/2025:08:40:02 +0000] "GET / HTTP/1.1" 404 10 "-" "-"\r\nnoise\n'
    )
    lines = ingest.stream_lines(spark, str(tmp_path / "t"), "access")
    query = (
        ingest.stream_events(lines, 2025, "web").select("feed", F.col("http_status"))
        .writeStream.format("memory").queryName("text_out")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("text_out").collect()] == [("access", 404)]


def test_lines_of_one_second_keep_their_order(spark, tmp_path):
    """Eight failures and then a success in one second, and a success first, however rows are split and dealt."""
    source = tmp_path / "logs"
    source.mkdir()

    def lines(ip, accepted_at):
        stamp = "Mar 12 12:06:00 w sshd[1]:"
        out = [f"{stamp} Failed password for a from {ip} port {i} ssh2" for i in range(8)]
        out.insert(accepted_at, f"{stamp} Accepted password for a from {ip} port 9 ssh2")
        return "\n".join(out) + "\n"

    (source / "a.log").write_text(lines("9.9.9.1", 8) + lines("9.9.9.2", 0) + lines("9.9.9.3", 7))
    (source / "b.log").write_text(lines("9.9.9.4", 8))
    (source / "z.log").write_text("Mar 14 12:06:00 w sudo: z : TTY=pts/0 ; USER=root ; COMMAND=/bin/id\n")
    rules = [r for r in shipped_rules() if r.id == "ssh-brute-force"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        stream = ingest.stream_lines(spark, str(source), "auth", feed_order=3)
        dealt = ingest.stream_events(stream, 2025, "ssh").repartition(7, F.xxhash64("raw"))
        detector = StreamDetector(rules, str(tmp_path / "found"), timedelta(minutes=5))
        detector.start(dealt, str(tmp_path / "c"), availableNow=True).awaitTermination()
        batch = N.events(N.parse_ssh(L.read_lines(spark, str(source), "auth"), 2025))
        found, kept = D.detect(batch, rules)
        got = {r.entity_key: (r.evidence_count, r.narrative) for r in detector.alerts(spark).collect()}
        assert {k: n for k, (n, _) in got.items()} == {"9.9.9.1": 9, "9.9.9.4": 9}
        assert got == {r.entity_key: (r.evidence_count, r.narrative) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_numbers_of_rows_in_splits():
    import pyarrow as pa

    def batch(rows):
        return pa.RecordBatch.from_pydict({"_file": [r[0] for r in rows], "_start": [r[1] for r in rows]})

    parts = [[("a", 0)] * 3, [("a", 0)] * 2 + [("a", 9)] * 2, [], [("a", 9)], [("b", 0), ("c", 0), ("c", 0)], [("c", 0), ("a", 0)]]
    got = [r for b in ingest._numbered(iter([batch(p) for p in parts])) for r in b.column("_row").to_pylist()]
    assert got == [0, 1, 2, 3, 4, 0, 1, 2, 0, 0, 1, 2, 0]
