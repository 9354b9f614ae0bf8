import random

import pytest
from pyspark.sql import functions as F

from hostguard import DetectionConfig, SkewPolicy
from hostguard.operators.rules import RULE_COLUMNS, rule_alerts
from hostguard.streaming.incremental import IncrementalDetector
from test_detectors import EDGE_GAPS, GAPS, S, frame, random_attempts


def shown(alerts):
    return sorted((a.rule_order, a.key, a.seq, a.ts_us, a.ip or "", round(a.metric, 6), round(a.threshold, 6), a.message) for a in alerts.collect())


CASES = [
    (21, DetectionConfig(global_threshold=12, subnet_threshold=8), SkewPolicy(), GAPS, 4),
    (22, DetectionConfig(ip_ttl=60, baseline_max_history=12, score_decay_per_second=0.3, global_threshold=9, subnet_threshold=5), SkewPolicy(), EDGE_GAPS, 3),
    (23, DetectionConfig(ip_ttl=90, subnet_threshold=8, global_threshold=15), SkewPolicy(hot_rows=60, ranges=5), GAPS, 2),
]


@pytest.mark.parametrize("seed,cfg,policy,gaps,batches", CASES)
def test_batches_add_up_to_the_batch_rules(spark, tmp_path, seed, cfg, policy, gaps, batches):
    rows = sorted(random_attempts(seed, ips=6, rows=40, gaps=gaps, hot_share=0.5), key=lambda r: r[1])
    detector = IncrementalDetector(str(tmp_path), cfg, policy, delay_s=20)
    rnd, size = random.Random(seed), -(-len(rows) // batches)
    for number in range(batches):
        part = rows[number * size : (number + 1) * size]
        # Out of order within the delay, and one batch that comes twice.
        if number + 1 < batches:
            early = [r for r in rows[(number + 1) * size :] if r[1] < part[-1][1] + 15 * S and rnd.random() < 0.3]
            rows = [r for r in rows if r not in early]
            part = part + early
        rnd.shuffle(part)
        for _ in range(2 if number == 1 else 1):
            detector(frame(spark, part), number)
        if number == 0:
            taken = part
        else:
            taken = taken + part
    detector.finish(spark)
    late = {r.seq for r in detector.late_rows(spark).collect()}
    kept = [r for r in taken if r[0] not in late]
    assert shown(detector.alerts(spark)) == shown(rule_alerts(frame(spark, kept), cfg).select(*RULE_COLUMNS))
    marks = detector.marks(spark).first()
    waiting = spark.read.parquet(f"{tmp_path}/state/version={batches - 1}/waiting").count()
    assert (marks.rows, marks.late) == (len(taken), len(late)) and marks.rows == marks.taken + marks.late + waiting
    versions = sorted(p.name for p in (tmp_path / "state").iterdir())
    assert versions == [f"version={n}" for n in range(max(0, batches - 2), batches)]
    if batches > 3:
        # What is left behind follows the windows, not the rows seen.
        left = spark.read.parquet(f"{tmp_path}/state/version={batches - 1}/recent").count()
        assert left < len(taken) / 2


def test_late_rows_empty_batches_and_rows_without_time(spark, tmp_path):
    detector = IncrementalDetector(str(tmp_path), DetectionConfig(burst_threshold=2), delay_s=5, rules=("burst",))
    start = 1_704_067_200 * S
    schema = "seq long, ts_us long, ip string, key string, rule string"

    def send(number, *rows):
        detector(spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema), number)

    send(0)
    send(1, (1, start, "a"), (2, None, "a"), (3, start + S, "a"), (4, start + 20 * S, "b"))
    send(2, (5, start + 15 * S, "a"), (6, start + 15 * S + 1, "b"), (7, start + 20 * S, "b"), (8, start + 40 * S, None))
    send(3)
    detector.finish(spark)
    detector.finish(spark)
    assert sorted(r.seq for r in detector.late_rows(spark).collect()) == [2, 5]
    assert sorted((a.seq, a.ip) for a in detector.alerts(spark).collect()) == [(3, "a"), (4, "b")]
    assert detector.marks(spark).select("rows", "taken", "late").first() == (8, 5, 2)


def test_stream_column_ts(spark, tmp_path):
    detector = IncrementalDetector(str(tmp_path), DetectionConfig(subnet_threshold=2), rules=("subnet",), delay_s=0)
    rows = frame(spark, [(i, 1_704_067_200 * S + i, f"10.0.0.{i}") for i in range(3)]).withColumn("ts", F.timestamp_micros("ts_us")).drop("ts_us")
    detector(rows, 0)
    assert [a.seq for a in detector.alerts(spark).collect()] == [1]
