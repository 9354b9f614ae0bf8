import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from hostguard import SkewPolicy
from hostguard.operators import baseline, metrics, state, triage
from hostguard.sources import lines as line_source


def metric(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"metric {kind}")


@pytest.mark.parametrize("values,mean,variance", [([10.0, 12.0, 11.0, 13.0], 11.5, 1.25), ([42.0], 42, 0), ([10.0, 12.0], 11, 1)])
def test_baseline(spark, values, mean, variance):
    row = baseline.build_baseline(metric(spark, values)).first()
    assert (row["mean"], row.variance) == (mean, variance)


def test_baseline_without_usable_rows(spark):
    assert baseline.build_baseline(metric(spark, [])).count() == 0
    assert baseline.build_baseline(metric(spark, ["ten"], "string")).count() == 0
    errors = baseline.read_metric(metric(spark, ["ten", None, " 7 "], "string")).collect()
    assert [r.error for r in errors] == ["value is not a number", "metric is missing", None]
    assert errors[2].value == 7.0
    assert baseline.read_metric(spark.range(1)).first().error == "metric is missing"


@pytest.mark.parametrize("mean,variance,value,want", [
    (10.0, 2.0, 25.0, True), (10.0, 2.0, 11.0, False), (10.0, 2.0, 10 + 3 * math.sqrt(2) - 0.1, False),
    (10.0, 2.0, 10 + 3 * math.sqrt(2) + 0.1, True), (10.0, 0.0, 10.0, False), (10.0, 0.0, 11.0, True),
])
def test_outliers(spark, mean, variance, value, want):
    profile = spark.createDataFrame([(mean, variance)], "mean double, variance double")
    assert baseline.score_outliers(metric(spark, [value]), profile).first().anomaly is want


def test_outliers_without_profile(spark):
    none = spark.createDataFrame([], "mean double, variance double")
    row = baseline.score_outliers(metric(spark, [1.0]), none).first()
    assert row.anomaly is None and row.error == "the profile lacks a mean or a variance"


def test_history_threshold(spark):
    few = spark.createDataFrame([(i, 3) for i in range(9)], "seq int, count int")
    assert baseline.history_threshold(few).first().threshold == 5.0
    values = [i % 7 for i in range(130)]
    row = baseline.history_threshold(spark.createDataFrame(list(enumerate(values)), "seq int, count int")).first()
    last = values[-100:]
    mean = sum(last) / 100
    assert row.threshold == pytest.approx(mean + 2 * math.sqrt(sum((x - mean) ** 2 for x in last) / 99))


def test_rates(spark):
    rows = [("a", i * 500_000) for i in range(1500)] + [("b", 5)] + [("c", 7), ("c", 7)]
    df = spark.createDataFrame(rows, "source string, ts_us long")
    got = {r.source: (r.events, r.rate) for r in metrics.event_rate(df, "source").collect()}
    assert got == {"a": (1000, 2.0), "b": (1, 0.0), "c": (2, 0.0)}
    at = {r.source: r.rate for r in metrics.rate_as_of(df, "source", F.lit(100_000_000), 60).collect()}
    assert at["a"] == 121 / 60 and at["b"] == 0.0


@pytest.mark.parametrize("policy", [SkewPolicy(), SkewPolicy(hot_rows=20, ranges=5)])
def test_trailing_rate_and_ewma(spark, policy):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 5}", rng.randrange(0, 300) * 500_000, i, rng.random()) for i in range(150)]
    df = spark.createDataFrame(rows, "key string, ts_us long, seq long, x double")
    got = {r.seq: r.events for r in metrics.trailing_rate(df, ["key"], 10, policy).collect()}
    for key, ts, seq, _ in rows:
        earlier = [t for k, t, s, _ in rows if k == key and (t, s) <= (ts, seq) and ts - t <= 10_000_000]
        assert got[seq] == len(earlier)
    means = {r.key: r.ewma for r in metrics.ewma(df, ["key"], "x", ["ts_us", "seq"], policy=policy).collect()}
    for name in {k for k, *_ in rows}:
        mean = None
        for _, _, x in sorted((t, s, x) for k, t, s, x in rows if k == name):
            mean = x if mean is None else 0.1 * x + 0.9 * mean
        assert means[name] == pytest.approx(mean)


def test_latency_buckets(spark):
    df = spark.createDataFrame([(v,) for v in [0.001, 0.002, 0.5, 0.6, 9.0, 400.0]], "w double")
    counts = {r.bound: r.n for r in metrics.latency_histogram(df, "w").collect()}
    assert counts == {0.001: 1, 0.01: 1, 0.5: 1, 1.0: 1, 10.0: 1}
    row = metrics.latency_summary(df, "w").first()
    assert (row.n, row.max_wait, row.p50_wait, row.p95_wait, row.p99_wait) == (6, 400.0, 0.5, 10.0, 10.0)
    far = metrics.latency_summary(df.filter("w > 300"), "w").first()
    assert (far.p50_wait, far.max_wait) == (0.0, 400.0)


@pytest.mark.parametrize("total,bad,backlog,alive,want", [
    (100, 10, 700, 4, 100), (100, 11, 701, 4, 80), (100, 20, 1000, 4, 80), (100, 21, 1001, 4, 50), (0, 0, 0, 0, 20),
    (100, 50, 2000, 0, 0),
])
def test_health(spark, total, bad, backlog, alive, want):
    df = spark.createDataFrame([(total, total - bad, bad, backlog, 20.0)],
                               "total_processed int, success_count int, failure_count int, backlog int, ewma double")
    row = metrics.health(df, alive=F.lit(alive)).first()
    assert row.health_score == want and row.recent_throughput_eps == 0.05
    assert row.stagnation_detected == (backlog > 800) and row.queue_pressure == round(backlog / 1000, 3)


def test_triage(spark):
    rows = [(i, p) for i, p in enumerate([2, 0, 1, 0, 0, 1, 2, 5, 0, 1])]
    df = spark.createDataFrame(rows, "seq int, priority int")
    assert [r.seq for r in triage.take_first(df, 5).collect()] == [1, 3, 4, 8, 2]
    assert [r.seq for r in triage.take_with_quotas(df, 5, {0: 0.4, 1: 0.2}).collect()] == [1, 3, 2, 0, 6]
    split = SkewPolicy(hot_rows=2, ranges=3)
    assert sorted(r.seq for r in triage.take_first(df, 5, policy=split).collect()) == [1, 2, 3, 4, 8]
    assert [r.seq for r in triage.take_with_quotas(df, 5, {0: 0.6, 1: 0.2}, policy=split).collect()] == [1, 3, 4, 2, 0]
    named = spark.createDataFrame([("high",), ("urgent",), ("x",)], "p string")
    got = triage.named_priority(named, "p", {"urgent": -1}).collect()
    assert [(r.priority, r.error) for r in got] == [(0, None), (-1, None), (None, "no such priority: x")]
    with pytest.raises(ValueError):
        triage.priority_values({"again": 1})


STATE = "ip string, state_json string, last_updated double"


def test_snapshot(spark):
    stored = spark.createDataFrame([("a", "1", 5.0), ("b", "2", 9.0), ("c", "3", 1.0)], STATE)
    updates = spark.createDataFrame([("a", "x", 6.0, 1), ("a", "y", 6.0, 2), ("b", "z", 1.0, 3), ("d", "w", 2.0, 4)],
                                    STATE + ", seq int")
    merged = state.upsert(stored, updates)
    assert sorted(tuple(r) for r in merged.collect()) == [("a", "y", 6.0), ("b", "z", 1.0), ("c", "3", 1.0), ("d", "w", 2.0)]
    gone = spark.createDataFrame([("a",), ("a",), ("q",)], "ip string")
    left, other = state.delete_everywhere(merged, stored, gone)
    assert sorted(r.ip for r in left.collect()) == ["b", "c", "d"] and sorted(r.ip for r in other.collect()) == ["b", "c"]


def entry(number, op, key, value, at, broken=False):
    text = json.dumps(value, sort_keys=True)
    checksum = hashlib.sha256(f"{op}:{key}:{text}:{at}".encode()).hexdigest()
    return (number, op, key, text, at, "bad" if broken else checksum)


def test_replay(spark):
    log = [
        entry(1, 1, "a", {"s": 1, "b": [1]}, 1704067200.179575), entry(2, 2, "a", None, 1704067201.0),
        entry(3, 1, "a", {"s": 2}, 1704067202.5), entry(4, 2, "b", None, 1704067203.25),
        entry(5, 3, "b", [1.5], 1704067204.0), entry(6, 4, "c", None, 1704067205.0),
        entry(7, 1, "c", {"s": 9}, 1704067206.0, broken=True),
    ]
    df = spark.createDataFrame(log, "id long, op_type int, key string, value_json string, timestamp double, checksum string")
    states = spark.createDataFrame([(k, "{}", 0.0) for k in "abc"], STATE)
    histories = spark.createDataFrame([(k, "[]", 0.0) for k in "abc"], "ip string, history_json string, last_updated double")
    new_states, new_histories = state.replay(states, histories, df)
    assert sorted(tuple(r) for r in new_states.collect()) == [("a", '{"s": 2}', 1704067202.5), ("c", "{}", 0.0)]
    assert sorted(tuple(r) for r in new_histories.collect()) == [("a", "[]", 0.0), ("b", "[1.5]", 1704067204.0)]
    assert tuple(state.corrupted_entries(df).first()) == (1, 7)


def collect(spark, path, limit):
    return [r.message for r in line_source.collect_events(spark, str(path), limit, F.lit(1.0)).collect()]


def test_last_lines_of_a_file(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes("line1\nline2\n\n  caffè \n".encode())
    assert collect(spark, path, 2) == ["caffè"]
    assert collect(spark, path, 3) == ["line2", "caffè"]
    assert collect(spark, path, 99) == ["line1", "line2", "caffè"]
    assert collect(spark, path, 0) == [] and collect(spark, path, -5) == []
    assert collect(spark, tmp_path / "missing.log", 5) == []
    path.write_bytes(b"")
    assert collect(spark, path, 5) == []
    path.write_bytes(b"\x00\x01\n")
    assert len(collect(spark, path, 1)) == 1


def test_directory_scan(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "a.log").write_bytes(b"one\ntw\xffo\n\n")
    (tmp_path / "x" / "y" / "b.log").write_bytes(b"three\n")
    (tmp_path / "x" / "c.txt").write_bytes(b"no\n")
    rows = line_source.read_lines(spark, str(tmp_path)).orderBy(*line_source.LINE_ORDER).collect()
    assert sorted(r.line for r in rows) == ["", "one", "three", "two"]
    virtual = line_source.lines_of(spark.createDataFrame([("l",)], "text string"), "text").first()
    assert (virtual.line, virtual.source) == ("l", "virtual")
