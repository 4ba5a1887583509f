"""Keys of a stream are dealt into a bounded number of states."""

from datetime import timedelta

import test_detectors as TD
from pyspark.sql import functions as F

from emberwatch.plans.rules import Burst
from emberwatch.streaming import detector as S


def test_many_keys_share_states(spark, tmp_path):
    row = TD.random_rows(3, keys=1)[0]
    rows = [dict(row, user=f"u{i}", tie=i, status="failure") for i in range(3000)]
    rule = TD.rule("b", Burst(TD.FAIL, ("user",), TD.W, 3), "{count}")
    found = S.StreamDetector([rule], str(tmp_path), timedelta(seconds=1)).hits(TD.as_events(spark, rows))
    keys, parts = found.agg(F.count_distinct("entity_key"), F.count_distinct("part")).first()
    assert keys == 3000 and S.PARTS / 2 < parts <= S.PARTS
    assert found.groupBy("entity_key").agg(F.count_distinct("part").alias("n")).where("n > 1").isEmpty()
