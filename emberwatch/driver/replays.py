"""The given tables played back through files, streams and sinks; and the SQL for what must come out."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.driver import oracles as O
from emberwatch.driver import queries as Q
from emberwatch.driver import tables as T
from emberwatch.functions import text as X
from emberwatch.operators.staging import shared_folder, staged
from emberwatch.plans import detect as D
from emberwatch.sources import lines as L
from emberwatch.sources import normalize as N
from emberwatch.sources import sinks
from emberwatch.streaming import ingest
from emberwatch.streaming.detector import StreamDetector

#: Lines of a log file at most; more go to further files of the same log.
FILE_LINES = 1 << 20
#: An event long after all others lets a stream settle everything before it.
_LAST = "TIMESTAMP '2199-01-01 00:00:00'"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.security_events(spark, sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _parts(spark: SparkSession) -> int:
    """Parts of the state of a replay this size: one per core at most."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _written(rows: DataFrame, name: str) -> DataFrame:
    """What a stream has written once it has read all its files."""
    spark = rows.sparkSession
    out, setting = _folder(spark, name), "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, _parts(spark))
    try:
        query = (
            rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(spark, "checkpoint"))
            .trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(setting, before)
    query.awaitTermination()
    return spark.read.parquet(out)


def _with_last(events: DataFrame) -> DataFrame:
    """The events and one long after them that no rule knows."""
    last = events.limit(1).withColumns({"ts": F.expr(_LAST), "action": F.lit("end"), "status": F.lit("info")})
    return events.unionByName(last)


def _replayed(spark: SparkSession, batches: list[DataFrame], files: int = 1):
    """The batches as a file stream: so many files each, in this order, one batch per micro-batch.

    Rows are dealt to several files, and ordered in them, by a hash. A batch of too few rows for its files
    takes some of the next one's.
    """
    folder = _folder(spark, "stream")
    for rows in batches:
        place = F.xxhash64("tie")
        dealt = rows.coalesce(1) if files == 1 else rows.repartition(files, place).sortWithinPartitions(place)
        dealt.write.mode("append").parquet(folder)
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", files).parquet(folder)


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a stream in four micro-batches, the rows of each shuffled by a hash."""
    rules = [Q.demo_rules()[n] for n in ("burst_count", "burst_sum", "sequence_two")]
    events = staged(_events(spark, sf_dir))
    ends = events.agg(F.min(F.unix_seconds("ts")).alias("a"), F.max(F.unix_seconds("ts")).alias("b")).first()
    if ends.a is None:
        return spark.createDataFrame([], "alert_id string, rule_id string, severity string, evidence_count bigint, n_matches bigint")
    part = F.least(F.floor((F.unix_seconds("ts") - ends.a) * 4 / (ends.b - ends.a + 1)), F.lit(3))
    batches = [events.where(part == k) for k in range(4)]
    stream = _replayed(spark, [*batches, _with_last(events).where(F.col("action") == "end")], _parts(spark))
    detector = StreamDetector(rules, _folder(spark, "detected"), timedelta(days=9))
    query = detector.start(stream, _folder(spark, "checkpoint"), _parts(spark), availableNow=True)
    query.awaitTermination()
    return detector.alerts(spark).select("alert_id", "rule_id", "severity", "evidence_count", "n_matches")


def tied_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences among events that share the time of their day, in rows dealt out by a hash."""
    rule = Q.demo_rules()["sequence_two"]
    events = T.security_events(spark, sf_dir).withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    rows = D.evidence(events.repartition(16, F.xxhash64("tie")), [rule])
    return rows.select("entity_key", "tie", F.timestamp_micros("t").cast("timestamp_ntz").alias("ts"))


def stream_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of one folder as a stream; the place of each among the lines of its file and second."""
    events = T.security_events(spark, sf_dir)
    folder = _folder(spark, "logs")
    logs = 4
    log = lambda n: F.pmod(n, F.lit(logs))
    run = lambda n: F.floor(n / (logs * FILE_LINES))
    runs = (events.agg(F.max(run(F.col("tie")))).first()[0] or 0) + 1
    # the text carries the number of its line, by which the result can be told
    text = F.concat("line", F.lit(" #"), F.lpad(F.col("line_no").cast("string"), 12, "0"))
    rows = T.ssh_lines(events).select("line_no", text.alias("value"), log(F.col("line_no")).alias("file"), run(F.col("line_no")).alias("run"))
    # a task writes one file
    rows.repartitionById(logs * runs, (F.col("run") * logs + F.col("file")).cast("int")).sortWithinPartitions(
        "file", "run", "line_no"
    ).select("value", "file", "run").write.partitionBy("file", "run").text(folder)
    lines = ingest.stream_lines(spark, f"{folder}/*/*", "auth")
    number = F.substring("line", -12, 12).cast("bigint")
    found = _written(lines, "lines").select(number.alias("line_no"), "tie", F.shiftright("tie", ingest.PLACE_BITS).alias("code"))
    found = found.withColumns({"file": log(F.col("line_no")), "run": run(F.col("line_no"))})
    # positions of a file in order, as the numbers in its lines are
    file = ["code", "file", "run"]
    placed = found.withColumn("before", F.lag("line_no").over(Window.partitionBy(*file).orderBy("tie")))
    # the first line of a file follows the last one of the file before it
    lasts = found.groupBy(*file).agg(F.max_by("line_no", "tie").alias("last")).select(
        *file, F.lag("last").over(Window.partitionBy("file").orderBy("run")).alias("earlier")
    )
    return placed.join(F.broadcast(lasts), file).select("line_no", F.coalesce("before", "earlier").alias("before"))


def repeated_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines delivered twice by a stream, as events once each."""
    events = T.security_events(spark, sf_dir)
    folder = _folder(spark, "logs")
    lines = T.web_lines(events).select("line")
    for _ in range(2):
        lines.coalesce(1).write.mode("append").text(folder)
    stream = ingest.stream_lines(spark, folder, "access")
    once = ingest.without_repeats(ingest.stream_events(stream, 2024, "web"), "60 days")
    found = _written(once.select("ts", "src_ip", "http_status"), "events").groupBy("src_ip", "http_status").agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_seen"))
    return T.plain_time(found)


def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream whose last file lies days behind the first: rows later than the delay are left out.

    Spark holds a batch against the newest time of the batch before the last, so one row comes between.
    """
    events = _events(spark, sf_dir).select("ts", F.col("raw"), "tie", "action")
    newest, oldest = events.where("tie % 2 = 0"), events.where("tie % 2 = 1")
    stream = _replayed(spark, [newest, newest.orderBy(F.desc("ts"), "tie").limit(1), oldest])
    once = ingest.without_repeats(stream, "10 days", on=("ts", "raw"))
    return _written(once.select("tie", "action"), "events").select("tie", "action")


def event_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed events and skipped lines appended in two parts and read back, counted by day and source."""
    events = T.security_events(spark, sf_dir)
    lines = T.all_lines(events)
    kept, left = _folder(spark, "events"), _folder(spark, "skipped")
    for half in (0, 1):
        # picked before the parse, below which no filter moves
        part = staged(N.parse_routed(lines.where(F.col("line_no") % 2 == half), 2024))
        sinks.write_events(N.events(part), kept)
        sinks.write_skipped(N.skipped(part), left)
    found = spark.read.parquet(kept).groupBy(F.col("day").cast("string").alias("day"), "source").agg(F.count(F.lit(1)).alias("n"))
    skipped = spark.read.parquet(left).groupBy(F.lit("skipped").alias("day"), F.col("feed").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(skipped)


def alert_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of alerts after those of the first half of the events, and then those of all."""
    events = T.security_events(spark, sf_dir)
    rules, path = [Q.demo_rules()["burst_count"]], _folder(spark, "alerts")
    for part in (events.filter("ts < TIMESTAMP_NTZ '2024-01-16 00:00:00'"), events):
        found, _ = D.detect(part, rules)
        sinks.merge_alerts(found, path)
    return spark.read.parquet(path).select("alert_id", "evidence_count", "n_matches", F.col("day").cast("string").alias("day"))


def decoded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents in a one-byte code, read as UTF-8: what is none becomes U+FFFD."""
    texts = T.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("feed"), "text")
    one_byte = F.translate("text", "".join(chr(c) for c in range(0x80, 0xC0)), "")
    coded = F.encode(F.regexp_replace(one_byte, r"[^\x00-\xF7]", ""), "ISO-8859-1").cast("string")
    lines = L.lines_of_text(texts.withColumn("text", X.valid_utf8(coded)))
    return lines.select("feed", "line_no", F.md5(F.encode("line", "UTF-8")).alias("digest"))


def queries() -> dict:
    return {
        "stream_alerts": stream_alerts, "tied_events": tied_events, "stream_positions": stream_positions,
        "repeated_delivery": repeated_delivery, "late_events": late_events, "event_sink": event_sink,
        "alert_sink": alert_sink, "decoded_lines": decoded_lines,
    }


def oracle_sql() -> dict[str, str]:
    names = ["burst_count", "burst_sum", "sequence_two"]
    day = "ev AS (SELECT * REPLACE (date_trunc('day', ts) AS ts) FROM given)"
    given = O.EV.replace("ev AS", "given AS", 1)
    web = O._LIST["web"]
    alerts = O._with(*O._burst_ctes("burst_count"), *O._alert_ctes("burst_count_e", 72, "a"))
    return {
        "stream_alerts": O._with(*O._many_alerts(names))
        + "SELECT alert_id, rule_id, severity, evidence_count, n_matches FROM al",
        "tied_events": f"WITH RECURSIVE {given}, {day}, " + ", ".join(O._sequence_ctes("sequence_two"))
        + " SELECT k AS entity_key, tie, ts FROM sequence_two_e",
        "stream_positions": f"WITH {O.EV} SELECT tie AS line_no, lag(tie) OVER (PARTITION BY tie % 4 ORDER BY tie) AS before FROM ev",
        "repeated_delivery": f"WITH {O.EV}, once AS (SELECT DISTINCT {web[1]} AS ts, src_ip, {web[2]['http_status']} AS http_status, "
        f"principal, port, action, tie % 3 = 0 AS a, tie % 6 = 0 AS b, tie % 40 = 3 AS c, tie % 2 AS d, cents FROM ev) "
        "SELECT src_ip, http_status, count(*) AS events, max(ts) AS last_seen FROM once GROUP BY ALL",
        "late_events": f"WITH {O.EV}, mark AS (SELECT max(ts) - INTERVAL 10 DAY AS m FROM ev WHERE tie % 2 = 0) "
        "SELECT tie, action FROM ev, mark WHERE tie % 2 = 0 OR ts > date_trunc('millisecond', m)",
        "event_sink": f"WITH {O.EV} SELECT CAST(CAST(CASE WHEN source = 'web' THEN {web[1]} ELSE {O._SEC} END AS DATE) AS VARCHAR) AS day, "
        f"source, count(*) AS n FROM ev WHERE NOT {O._SKIPPED} GROUP BY ALL UNION ALL "
        f"SELECT 'skipped', {O._FEED}, count(*) FROM ev WHERE {O._SKIPPED} GROUP BY ALL",
        "alert_sink": alerts + f"SELECT {O.alert_id('burst_count')} AS alert_id, count(*) AS evidence_count, max(n_matches) AS "
        "n_matches, CAST(CAST(alert_ts AS DATE) AS VARCHAR) AS day FROM a_k GROUP BY k, alert_ts",
        "decoded_lines": "SELECT CAST(doc_id AS VARCHAR) AS feed, line_no, md5(line) AS digest FROM (SELECT doc_id, "
        "generate_subscripts(parts, 1) AS line_no, unnest(parts) AS line FROM (SELECT doc_id, regexp_split_to_array("
        r"regexp_replace(regexp_replace(text, '[\x{80}-\x{BF}]|[^\x{00}-\x{F7}]', '', 'g'), '[\x{C0}-\x{F7}]', chr(65533), 'g'), "
        r"'\r?\n') AS parts FROM documents)) WHERE regexp_matches(line, '[^" + O.WS + "]')",
    }
