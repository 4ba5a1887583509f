"""Lines of the shipped rules' scenes read back as what they were made from."""

from pyspark.sql import functions as F

from emberwatch.driver import incidents as I


def test_times_of_the_next_year_and_lines_alike(spark, tmp_path):
    """Episodes 0 and 2,790, which lies in the next year, and 0 once more, at the same times."""
    starts = F.explode(F.array(*(F.lit(e * 1200) for e in (0, 2790, 2800))))
    ids = spark.range(1200).select("id", starts.alias("start")).select((F.col("id") + F.col("start")).alias("event_id"))
    ids.select(
        "event_id", F.lit("purchase").alias("event_type"), (F.col("event_id") % 24).alias("user_id"), F.lit(1.0).alias("value"),
    ).write.parquet(str(tmp_path / "events.parquet"))
    wanted = {r.tie: r.ts for r in I.scenes(spark, str(tmp_path)).select("tie", "ts").collect()}
    got = I.events(spark, str(tmp_path))
    assert "year" not in got.columns
    rows = got.select("line_no", "source", "raw", F.col("ts").cast("timestamp_ntz").alias("ts")).collect()
    assert len(rows) == 3600 and {r.line_no: r.ts for r in rows} == wanted
    assert {r.ts.year for r in rows} == {2024, 2025}
    logins = [(r.raw, r.ts) for r in rows if r.line_no % 12 in (0, 1, 7)]
    assert len(set(logins)) == len(logins) == 900
