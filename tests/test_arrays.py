"""JSON arrays cut in splits, and feeds told by their heads."""

import json
import random

import pytest

from emberwatch.sources import arrays
from emberwatch.sources import lines as L


def element(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice([1, -2.5, True, None, 10**12])
    if kind < 4:
        return "".join(rng.choices('ab,"\\[]{}é\n ', k=rng.randrange(12)))
    if kind < 6:
        return {"".join(rng.choices('k,"]', k=3)): element(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [element(rng, depth + 1) for _ in range(rng.randrange(4))]


@pytest.fixture
def splits(spark):
    """Splits of a few bytes, several to a task."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("sent", [64 << 20, 0])
def test_arrays_in_splits(spark, splits, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(arrays, "MOST_SENT", sent)
    rng = random.Random(3)
    want = {}
    for i in range(6):
        values = [element(rng) for _ in range(rng.choice([1, 5, 60]))]
        text = json.dumps(values, ensure_ascii=False, indent=rng.choice([None, 2]))
        (tmp_path / f"f{i}.json").write_text(rng.choice(["", " \n"]) + text + rng.choice(["", "\n"]))
        want[f"f{i}.json"] = values
    odd = {"empty.json": "[]", "blank.json": " [ \n ] ", "one.json": "[7]"}
    broken = {"open.json": '[{"a":1},{"b":"' + "x," * 300, "lines.json": '{"a":1,"b":2}\n{"a":2}\n', "none.json": "plain, text"}
    for name, text in (odd | broken).items():
        (tmp_path / name).write_text(text)
    found = arrays.read_json_array(spark, str(tmp_path), feed_order=2).collect()
    assert {r.feed_order for r in found} == {2}
    for name, values in want.items():
        own = sorted((r for r in found if r.feed.endswith(f"/{name}")), key=lambda r: r.line_no)
        assert [r.line_no for r in own] == list(range(1, len(values) + 1))
        assert [json.loads(r.line) for r in own] == values
    assert [(r.line_no, r.line) for r in found if r.feed.endswith("/one.json")] == [(1, "7")]
    assert not [r for r in found if r.feed.endswith(("/empty.json", "/blank.json"))]
    for name, text in broken.items():
        (line,) = [r.line for r in found if r.feed.endswith(f"/{name}") and r.line_no == 1]
        assert text.startswith(line) and len(line) >= min(len(text), 90)  # of its first split


def test_a_file_uses_many_tasks(spark, splits, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"i": i} for i in range(500)]))
    assert arrays._pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    assert arrays.read_json_array(spark, str(tmp_path), feed="f").count() == 500


def test_sniffing_reads_one_split(spark, splits, tmp_path, monkeypatch):
    """A feed of many splits is told by its first one; a second file is read only for want of lines."""
    line = '1.2.3.4 - - [12/Mar/2025:08:40:02 +0000] "GET / HTTP/1.1" 404 10 "-" "-"'
    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "a.log").write_text("\n" * 5 + f"{line}\n" * 3)
    (tmp_path / "web" / "b.log").write_text(f"{line}\n" * 20_000)
    (tmp_path / "prose").mkdir()
    (tmp_path / "prose" / "a.txt").write_text("nothing here\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "4m")
    feeds = {n: str(tmp_path / n) for n in ("web", "prose")}
    got = {r.feed: (r.web, r.parser) for r in L.sniff_feeds(spark, feeds).collect()}
    monkeypatch.setattr(L, "classify_feeds", lambda lines: lines)
    spark.sparkContext.setJobGroup("sniff", "sniff")
    L.sniff_feeds(spark, feeds)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("sniff") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("", "")
    assert got == {"web": (80, "web"), "prose": (0, None)}
    assert sum(s.numTasks for s in stages if s) == 3  # b.log alone has 15 splits
