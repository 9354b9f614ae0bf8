import random

import pytest
from pyspark.sql import functions as F

from hostguard import DetectionConfig
from hostguard.operators.rules import rule_alerts
from hostguard.plans.stream_queries import END, collected
from hostguard.sources.snapshots import scratch_path
from hostguard.streaming import detectors, sinks
from test_detectors import START, S, frame, random_attempts


def as_stream(spark, rows, files):
    """Rows in the given order as a stream of ``files`` micro-batches and a closing row."""
    path = scratch_path(rows[0], "stream")
    for part in rows:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows[0].schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def timed(df):
    return df.select(F.timestamp_micros("ts_us").alias("ts"), "seq", "ip")


def test_address_stream_equals_batch(spark):
    cfg = DetectionConfig(ip_ttl=100)
    attempts = random_attempts(11, ips=6, rows=25)
    attempts.sort(key=lambda r: r[1])
    half = len(attempts) // 2
    rng = random.Random(1)
    parts = [attempts[:half], attempts[half:]]
    for part in parts:
        rng.shuffle(part)
    end = spark.range(1).select(F.expr(END).alias("ts"), F.lit(-1).cast("bigint").alias("seq"), F.lit("end").alias("ip"))
    stream = as_stream(spark, [timed(frame(spark, p)) for p in parts] + [end], 1)
    got = collected(spark, detectors.address_alerts(stream, cfg, "10 minutes")).filter("seq >= 0").collect()
    want = rule_alerts(frame(spark, attempts), cfg, rules=["baseline", "burst", "risk", "escalation"]).collect()
    key = lambda a: (a.rule_order, a.key, a.seq, a.ts_us, a.metric, a.message)
    assert sorted(map(key, got)) == sorted(map(key, want)) and got


def test_late_rows_and_profile_stream(spark):
    rows = spark.createDataFrame([(1, 0.0, 10.0), (2, 0.0, 11.0)], "id int, at double, arrived double")
    rows = rows.select("id", F.timestamp_seconds("at").alias("at"), F.timestamp_seconds("arrived").alias("arrived"))
    in_time, late = detectors.split_late(rows, "at", "arrived", "10 SECONDS")
    assert [r.id for r in in_time.collect()] == [1] and [r.id for r in late.collect()] == [2]
    empty = spark.createDataFrame([], "mean double, variance double")
    with pytest.raises(ValueError):
        detectors.score_stream(spark.createDataFrame([(1.0,)], "metric double"), empty)


def test_grouped_profile_stream(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 9.0), ("c", 1.0)], "k string, metric double")
    profile = spark.createDataFrame([("a", 1.0, 0.0), ("b", 1.0, 1.0)], "k string, mean double, variance double")
    stream = as_stream(spark, [rows], 1)
    scored = detectors.score_stream(stream, profile, ["k"]).select("k", "anomaly", "error")
    got = {r.k: r.anomaly for r in collected(spark, scored).collect()}
    assert got == {"a": False, "b": True, "c": None}


def test_sinks_repeat_without_duplicates(spark, tmp_path):
    empty = spark.createDataFrame([], "ip string, state_json string, last_updated double")
    write = sinks.snapshot_sink(str(tmp_path / "state"), empty)
    updates = "ip string, state_json string, last_updated double, seq int"
    first = spark.createDataFrame([("a", "1", 1.0, 1), ("b", "1", 1.0, 2)], updates)
    second = spark.createDataFrame([("a", "2", 2.0, 3)], updates)
    for batch, number in [(first, 0), (second, 1), (second, 1), (second.limit(0), 3), (second.limit(0), 4)]:
        write(batch, number)
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["version=3", "version=4"]
    last = spark.read.parquet(str(tmp_path / "state" / "version=4"))
    assert sorted((r.ip, r.state_json) for r in last.collect()) == [("a", "2"), ("b", "1")]

    seen = []
    rows = spark.createDataFrame([(1, None), (2, "bad")], "n int, error string")
    sink = sinks.quarantine_sink(str(tmp_path / "good"), str(tmp_path / "bad"),
                                 on_event=lambda df, i: seen.append(("event", df.count())),
                                 on_error=lambda df, i: seen.append(("error", df.count())))
    sink(rows, 0)
    sink(rows, 0)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1
    assert seen == [("event", 1), ("error", 1)] * 2

    alerts = rule_alerts(frame(spark, [(i, START + i * S, "10.0.0.1") for i in range(4)]), rules=["burst"])
    for _ in range(2):
        sinks.alert_line_sink(str(tmp_path / "lines"))(alerts, 3)
        sinks.alert_table_sink(str(tmp_path / "table"))(alerts, 3)
    assert spark.read.text(str(tmp_path / "lines")).count() == alerts.count() == 1
    assert spark.read.parquet(str(tmp_path / "table")).first().rule == "burst"


def test_idle_state_goes(spark):
    """Rows far ahead move the watermark; what earlier keys kept is dropped by timers."""
    cfg = DetectionConfig(subnet_threshold=2)
    rows = [(i, START + i * S, f"10.0.{i}.1") for i in range(70)]
    far = [[(1000 + k, START + 86_400 * (k + 1) * S, f"11.0.{k}.1")] for k in range(4)]
    parts = [timed(frame(spark, p)) for p in [rows, *far]]
    for make in (
        lambda s: detectors.address_alerts(s, cfg),
        lambda s: detectors.subnet_alerts(s, cfg),
        lambda s: detectors.suppress_repeats(s, ["ip"]),
    ):
        detectors.use_rocksdb(spark)
        seen = []
        query = (
            make(as_stream(spark, parts, 1)).writeStream.foreachBatch(lambda batch, _: seen.append(batch.count()))
            .option("checkpointLocation", scratch_path(parts[0], "checkpoint")).trigger(availableNow=True).start()
        )
        query.awaitTermination(240)
        totals = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        # Only the last rows' keys are left: their pending row, their state, their timers.
        assert max(totals) > 60 and totals[-1] <= 12, totals
