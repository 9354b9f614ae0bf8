import random

import pytest
from pyspark.sql import functions as F

from hostguard.operators.baseline import build_baseline, score_outliers
from hostguard.sources.deltas import whole_parts
from hostguard.streaming.profiles import OutlierSink, ProfileSink

ROW = "k string, metric double, samples string"


def batches(spark):
    rnd = random.Random(5)
    for number in range(5):
        rows = [] if number == 2 else [
            (rnd.choice(["a", "b", None] if number else ["a"]), rnd.choice([None, 1e9 + rnd.random(), 1e9]), "clash") for _ in range(20)
        ]
        yield spark.createDataFrame(rows, ROW)


@pytest.mark.parametrize("by", [[], ["k"]])
def test_versions_equal_the_profile_of_all_rows(spark, tmp_path, by):
    sink, seen, scored = ProfileSink(str(tmp_path / "p"), by), [], {}
    outliers = OutlierSink(sink, lambda rows, number: scored.__setitem__(number, rows.select("k", "value", "anomaly", "error").collect()))
    for number, batch in enumerate(batches(spark)):
        before = spark.createDataFrame(seen, ROW)
        for _ in range(2 if number in (1, 3) else 1):
            outliers(batch, number)
        if number:
            want = score_outliers(batch, build_baseline(before, by), by).select("k", "value", "anomaly", "error").collect()
            assert sorted(map(str, scored[number])) == sorted(map(str, want)), number
        seen += [tuple(r) for r in batch.collect()]
        want = {tuple(r[k] for k in by): r for r in build_baseline(spark.createDataFrame(seen, ROW), by).collect()}
        got = {tuple(r[k] for k in by): r for r in sink.profile(spark).collect()}
        assert got.keys() == want.keys()
        for key, row in want.items():
            assert got[key].samples == row.samples and got[key].mean == pytest.approx(row["mean"], rel=1e-14)
            assert got[key].variance == pytest.approx(row.variance, rel=1e-5, abs=1e-9)
    assert all(r.anomaly is None and r.error for r in scored[0])
    assert whole_parts(spark, str(tmp_path / "p"), "version") == [2, 3, 4]
    assert ProfileSink(str(tmp_path / "none"), by).profile(spark) is None
