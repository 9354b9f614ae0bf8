import random

import pytest
from pyspark.sql import functions as F

from hostguard import DetectionConfig, SkewPolicy
from hostguard.operators.rules import rule_alerts
from hostguard.operators.thinning import thin
from hostguard.operators.windows import address_metrics, global_counts, idle_sessions, subnet_counts
from sequential import Fold, greedy

START = 1_704_067_200_000_000
S = 1_000_000
GAPS = [0, 1, 200_000, 4_999_999, 5 * S, 20 * S, 59_999_999, 60 * S, 120 * S]
EDGE_GAPS = [0, 1, 5 * S - 1, 5 * S, 5 * S + 1, 30 * S - 1, 30 * S, 30 * S + 1, 60 * S - 1, 60 * S, 60 * S + 1,
             300 * S - 1, 300 * S, 300 * S + 1, 600 * S - 1, 600 * S, 600 * S + 1]
ORDINARY = SkewPolicy()
# Every key with more than 40 rows is cut in ranges, and ranges are small.
HOT = SkewPolicy(hot_rows=40, ranges=7)


def random_attempts(seed, ips=12, rows=60, gaps=GAPS, hot_share=0.0):
    rng = random.Random(seed)
    names = [f"10.0.{i % 3}.{i}" for i in range(ips - 2)] + ["2001:db8:1::7", "not an address"]
    out = []
    for ip in names:
        now = START + rng.randrange(0, 30) * S
        for _ in range(rows):
            now += rng.choice(gaps)
            out.append((now, ip))
    for _ in range(int(hot_share * len(out))):
        out.append((START + rng.randrange(0, 400 * S, 250_000), names[0]))
    rng.shuffle(out)
    return [(seq, ts, ip) for seq, (ts, ip) in enumerate(out)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "seq long, ts_us long, ip string")


CASES = [
    (1, DetectionConfig(), ORDINARY, {}),
    (2, DetectionConfig(), HOT, dict(hot_share=0.5)),
    (3, DetectionConfig(ip_ttl=60, score_decay_per_second=0.3), HOT, dict(gaps=EDGE_GAPS)),
    (4, DetectionConfig(baseline_max_history=15, baseline_std_multiplier=1.5, burst_window=90), ORDINARY, {}),
    (9, DetectionConfig(baseline_max_history=15, baseline_std_multiplier=1.73205, burst_window=90), ORDINARY, {}),
]


@pytest.mark.parametrize("seed,cfg,policy,shape", CASES)
def test_counts_thresholds_and_scores_equal_a_sequential_fold(spark, seed, cfg, policy, shape):
    rows = random_attempts(seed, **shape)
    fold = Fold.run(rows, cfg)
    attempts = frame(spark, rows)
    by_address = {
        r.seq: (r.failed_count, r.burst_count, r.escalation_count, r.history_n, r.history_sum,
                int(r.history_squares), r.increment, r.score_units)
        for r in address_metrics(attempts, cfg, policy).collect()
    }
    everyone = {r.seq: r.global_count for r in global_counts(attempts, cfg, policy).collect()}
    networks = {r.seq: r.subnet_count for r in subnet_counts(attempts, cfg, policy).collect()}
    assert len(by_address) == len(rows)
    got = [(row[0], *by_address[row[0]], everyone[row[0]], networks.get(row[0], 0)) for row in fold.rows]
    assert got == fold.rows


@pytest.mark.parametrize("seed,cfg,policy,shape", CASES)
def test_alerts_equal_a_sequential_fold(spark, seed, cfg, policy, shape):
    rows = random_attempts(seed, **shape)
    want = sorted(Fold.run(rows, cfg).alerts)
    alerts = rule_alerts(frame(spark, rows), cfg, policy).collect()
    assert sorted((a.rule_order, a.key, a.seq) for a in alerts) == want
    assert [(a.ts_us, a.seq, a.rule_order) for a in alerts] == sorted((a.ts_us, a.seq, a.rule_order) for a in alerts)


def test_sessions_split_only_beyond_the_ttl(spark):
    at = START
    rows = []
    for i, gap in enumerate([0, 600 * S, 600 * S + 1, 1]):
        at += gap
        rows.append((i, at, "10.0.0.1"))
    for policy in (ORDINARY, SkewPolicy(hot_rows=1, ranges=3)):
        got = idle_sessions(frame(spark, rows), policy=policy).orderBy("seq").collect()
        assert [(r.session, r.position) for r in got] == [(1, 1), (1, 2), (2, 1), (2, 2)]


@pytest.mark.parametrize("policy", [ORDINARY, SkewPolicy(hot_rows=50)])
@pytest.mark.parametrize("seed", [5, 6])
def test_thinning_equals_a_greedy_pass(spark, policy, seed):
    rng = random.Random(seed)
    rows = []
    for key, span, count in [("a", 4000, 900), ("b", 90, 300), (None, 2000, 80), ("c", 10**6, 60), ("d", 5, 3)]:
        for _ in range(count):
            rows.append((key, 1000 + rng.randrange(span), len(rows)))
    df = spark.createDataFrame(rows, "key string, ts_us long, seq long")
    got = sorted(((r.key, r.ts_us, r.seq) for r in thin(df, ["key"], 30, policy).collect()), key=str)
    assert got == sorted(((k or None, t, s) for k, t, s in _greedy_with_null(rows, 30)), key=str)


def _greedy_with_null(rows, gap):
    named = [(k if k is not None else "", ts, seq) for k, ts, seq in rows]
    return [(k or None, ts, seq) for k, ts, seq in greedy(named, gap)]


def test_messages(spark):
    rows = [(i, START + i * 1_500_000, "10.0.0.1") for i in range(4)]
    cfg = DetectionConfig(global_threshold=4, escalation_threshold=4, subnet_threshold=4, baseline_default_threshold=3)
    got = {a.rule: a.message for a in rule_alerts(frame(spark, rows), cfg).collect()}
    assert got == {
        "baseline": "Behavioural anomaly detected from IP 10.0.0.1 (count=4, threshold=3.00)",
        "burst": "Burst attack detected from IP 10.0.0.1 (burst_count=3)",
        "risk": "High risk intrusion detected from IP 10.0.0.1 (score=11.25)",
        "global": "Distributed brute force attack detected (attempts=4 in last 60s)",
        "escalation": "Slow progressive attack detected from IP 10.0.0.1 (attempts=4 in last 300s)",
        "subnet": "Subnet attack detected from 10.0.0.0/24 (attempts=4 in last 60s)",
    }


def test_unknown_setting_is_rejected():
    with pytest.raises(ValueError):
        DetectionConfig.from_dict({"burst": 1})
    assert DetectionConfig.from_dict({"burst_threshold": 4}).burst_threshold == 4
