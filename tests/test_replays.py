"""Replays of tables that are more than one file or half."""

import pytest
from pyspark.sql import functions as F

from emberwatch.driver import queries as Q
from emberwatch.driver import replays as R

ROWS = 1000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("replays")
    day = F.date_add(F.lit("2024-01-01"), (F.col("id") % 10).cast("int")).cast("timestamp_ntz")
    spark.range(ROWS).select(
        F.col("id").alias("event_id"), day.alias("ts"), (F.col("id") % 9).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"),
    ).write.parquet(str(path / "events.parquet"))
    return str(path)


def test_a_log_goes_on_in_further_files(spark, folder, monkeypatch):
    monkeypatch.setattr(R, "FILE_LINES", 40)
    rows = R.stream_positions(spark, folder).collect()
    assert {r.line_no: r.before for r in rows} == {n: n - 4 if n > 3 else None for n in range(ROWS)} and len(rows) == ROWS


def test_halves_are_parsed_once_and_written_to_few_files(spark, folder, monkeypatch):
    parse, given, events, written = R.N.parse_routed, [], R.sinks.write_events, []

    def counted(lines, year):
        given.append(lines.count())
        return parse(lines, year)

    def kept(rows, path):
        events(rows, path)
        written.append(spark.read.parquet(path).select(F.input_file_name()).distinct().count())

    monkeypatch.setattr(R.N, "parse_routed", counted)
    monkeypatch.setattr(R.sinks, "write_events", kept)
    found = R.event_sink(spark, folder).collect()
    assert given == [ROWS // 2, ROWS // 2] and sum(r.n for r in found) == ROWS
    folders = [10, 20]  # even ties are of two sources on five days each; odd ones likewise
    assert all(n <= most for n, most in zip(written, folders, strict=True))


def test_lines_of_an_array_are_parsed_once(spark, folder):
    rows = Q.json_array_files(spark, folder)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # whole elements and those across splits
    found = rows.collect()
    assert {r.feed for r in found if r.ts is None} == {"5", "15"}
