"""Windows, rules and baselines over login attempts and metrics (W, D, A1, J2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostguard.config import DetectionConfig
from hostguard.operators import baseline, rules, windows
from hostguard.operators.skew import SkewPolicy
from hostguard.plans import views
from hostguard.plans.registry import query

# Events are spread over 30 days, so durations are stretched by this factor for the rules to fire.
K = 3600
STRETCHED = DetectionConfig().scaled(K)
SHORT_TTL = DetectionConfig(ip_ttl=60).scaled(K)
US = K * 1_000_000

ATTEMPT_SQL = "concat('10.0.', user_id % 4, '.', user_id % 250 + 1)"
EVENTS = "ev AS (SELECT *, epoch_us(ts) AS ts_us FROM events)"
ATTEMPTS = f"""{EVENTS},
att AS (SELECT event_id AS seq, ts_us, {ATTEMPT_SQL} AS ip
        FROM ev WHERE event_type = 'error')"""


def sessions_sql(ttl: int) -> str:
    return f"""{ATTEMPTS},
gaps AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY ip ORDER BY ts_us, seq) AS gap FROM att),
sess AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > {ttl * US} THEN 1 ELSE 0 END)
                        OVER (PARTITION BY ip ORDER BY ts_us, seq) AS BIGINT) AS session FROM gaps)"""


def frame_sql(width: int) -> str:
    return f"RANGE BETWEEN {width} PRECEDING AND CURRENT ROW"


COUNTS = f"""{sessions_sql(600)},
cnt AS (SELECT seq, ts_us, ip, session, gap,
          count(*) OVER (PARTITION BY ip, session ORDER BY ts_us {frame_sql(60 * US - 1)}) AS failed_count,
          count(*) OVER (PARTITION BY ip, session ORDER BY ts_us {frame_sql(5 * US)}) AS burst_count,
          count(*) OVER (PARTITION BY ip, session ORDER BY ts_us {frame_sql(300 * US - 1)}) AS escalation_count,
          count(*) OVER (ORDER BY ts_us {frame_sql(60 * US - 1)}) AS global_count,
          count(*) OVER (PARTITION BY regexp_extract(ip, '^(.*)\\.\\d+$', 1) ORDER BY ts_us
                         {frame_sql(60 * US - 1)}) AS subnet_count,
          regexp_extract(ip, '^(.*)\\.\\d+$', 1) || '.0/24' AS subnet
        FROM sess)"""

HISTORY = f"""{COUNTS},
hist AS (SELECT *, count(*) OVER h AS history_n, CAST(sum(failed_count) OVER h AS BIGINT) AS history_sum,
                avg(failed_count) OVER h AS history_mean, stddev_samp(failed_count) OVER h AS history_std
         FROM cnt WINDOW h AS (PARTITION BY ip, session ORDER BY ts_us, seq
                               ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
thr AS (SELECT *, CASE WHEN history_n < 10 THEN 5.0 ELSE history_mean + 2 * history_std END AS threshold FROM hist)"""

SCORES = f"""{sessions_sql(600)},
inc AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts_us, seq) AS rn,
               CASE WHEN gap IS NULL OR gap > {600 * US} THEN 1 ELSE 0 END AS opens,
               2 + CASE WHEN gap <= {600 * US} AND gap < {60 * US} THEN 3 ELSE 0 END
                 + CASE WHEN gap <= {600 * US} AND gap < {5 * US} THEN 5 ELSE 0 END AS increment FROM sess),
fold AS (SELECT seq, ts_us, ip, session, rn, increment, increment * {2 * US} AS score_units
         FROM inc WHERE rn = 1
         UNION ALL
         SELECT i.seq, i.ts_us, i.ip, i.session, i.rn, i.increment,
                i.increment * {2 * US}
                  + CASE WHEN i.opens = 1 THEN 0 ELSE greatest(0, f.score_units - (i.ts_us - f.ts_us)) END
         FROM fold f JOIN inc i ON i.ip = f.ip AND i.rn = f.rn + 1)"""


def cooled_sql(candidates: str) -> str:
    """Fired rows of a candidate select with (rule, rule_order, key, seq, ts_us, ip, metric, threshold, message)."""
    return f"""cand AS ({candidates}),
fired AS (SELECT key, min(ts_us) AS at FROM cand GROUP BY key
          UNION ALL
          SELECT c.key, min(c.ts_us) FROM fired f JOIN cand c ON c.key = f.key AND c.ts_us >= f.at + {30 * US}
          GROUP BY c.key),
alerts AS (SELECT c.* FROM cand c JOIN fired f ON f.key = c.key AND f.at = c.ts_us)"""


def candidate_sql(name, order, table, condition, key, metric, threshold, message) -> str:
    return (
        f"SELECT '{name}' AS rule, {order} AS rule_order, {key} AS key, seq, ts_us, ip, "
        f"CAST({metric} AS DOUBLE) AS metric, CAST({threshold} AS DOUBLE) AS threshold, {message} AS message "
        f"FROM {table} WHERE {condition}"
    )


SCORE_TEXT = (
    f"CASE WHEN score_units % {2 * US} = 0 THEN (score_units // {2 * US}) || '.0' ELSE "
    f"rtrim(printf('%.6f', score_units / {2 * US}.0), '0') END"
)
CANDIDATES = {
    "baseline": candidate_sql(
        "baseline", 1, "thr", "failed_count > threshold", "'baseline_' || ip", "failed_count", "threshold",
        "'Behavioural anomaly detected from IP ' || ip || ' (count=' || failed_count || ', threshold=' "
        "|| printf('%.2f', threshold) || ')'",
    ),
    "burst": candidate_sql(
        "burst", 2, "cnt", "burst_count >= 3", "'burst_' || ip", "burst_count", "3",
        "'Burst attack detected from IP ' || ip || ' (burst_count=' || burst_count || ')'",
    ),
    "risk": candidate_sql(
        "risk", 3, "fold", f"score_units >= {20 * US}", "'risk_' || ip", f"score_units / {2 * US}.0", "10",
        f"'High risk intrusion detected from IP ' || ip || ' (score=' || {SCORE_TEXT} || ')'",
    ),
    "global": candidate_sql(
        "global", 4, "cnt", "global_count >= 50", "'global_bruteforce'", "global_count", "50",
        f"'Distributed brute force attack detected (attempts=' || global_count || ' in last {60 * K}s)'",
    ),
    "escalation": candidate_sql(
        "escalation", 5, "cnt", "escalation_count >= 10", "'escalation_' || ip", "escalation_count", "10",
        "'Slow progressive attack detected from IP ' || ip || ' (attempts=' || escalation_count "
        f"|| ' in last {300 * K}s)'",
    ),
    "subnet": candidate_sql(
        "subnet", 6, "cnt", "subnet_count >= 30", "'subnet_' || subnet", "subnet_count", "30",
        f"'Subnet attack detected from ' || subnet || ' (attempts=' || subnet_count || ' in last {60 * K}s)'",
    ),
}
ALERT_COLUMNS = "rule, rule_order, key, seq, ts_us, ip, round(metric, 6) AS metric, round(threshold, 6) AS threshold, message"


def rounded(alerts):
    return alerts.withColumns({"metric": F.round("metric", 6), "threshold": F.round("threshold", 6)})


def _count_sql(column: str) -> str:
    return f"WITH {COUNTS} SELECT seq, ip, {column} FROM cnt"


@query("w1_sessions", f"WITH {sessions_sql(60)} SELECT seq, ip, session, "
       "row_number() OVER (PARTITION BY ip, session ORDER BY ts_us, seq) AS position FROM sess")
def w1(spark, folder):
    return windows.idle_sessions(views.attempts(spark, folder), SHORT_TTL).select("seq", "ip", "session", "position")


def _address(column, *more):
    def run(spark, folder):
        return windows.address_metrics(views.attempts(spark, folder), STRETCHED).select("seq", "ip", column, *more)

    return run


query("w2_failed_count", _count_sql("failed_count"))(_address("failed_count"))
query("w3_burst_count", _count_sql("burst_count"))(_address("burst_count"))
query("w4_escalation_count", _count_sql("escalation_count"))(_address("escalation_count"))


@query("w5_subnet_count", _count_sql("subnet, subnet_count"))
def w5(spark, folder):
    counts = windows.subnet_counts(views.attempts(spark, folder), STRETCHED)
    return counts.select("seq", "ip", "subnet", "subnet_count")


@query("w6_global_count", _count_sql("global_count"))
def w6(spark, folder):
    return windows.global_counts(views.attempts(spark, folder), STRETCHED).select("seq", "ip", "global_count")


@query("w7_rolling_threshold",
       f"WITH {HISTORY} SELECT seq, ip, history_n, history_sum, round(threshold, 6) AS threshold FROM thr")
def w7(spark, folder):
    rows = _address("history_n", "history_sum", "threshold")(spark, folder)
    return rows.withColumn("threshold", F.round("threshold", 6))


@query("w8_global_threshold", f"""WITH {COUNTS},
last AS (SELECT failed_count FROM cnt ORDER BY ts_us DESC, seq DESC LIMIT 100)
SELECT count(*) AS history_n, CAST(sum(failed_count) AS BIGINT) AS history_sum,
       round(CASE WHEN count(*) < 10 THEN 5.0 ELSE avg(failed_count) + 2 * stddev_samp(failed_count) END, 6) AS threshold
FROM last""")
def w8(spark, folder):
    counts = windows.address_metrics(views.attempts(spark, folder), STRETCHED)
    return baseline.history_threshold(counts, "failed_count", ["ts_us", "seq"]).withColumn("threshold", F.round("threshold", 6))


@query("w9_score_increment", f"WITH RECURSIVE {SCORES} SELECT seq, ip, CAST(increment AS BIGINT) AS increment FROM inc")
def w9(spark, folder):
    return windows.risk_scores(views.attempts(spark, folder), STRETCHED).select("seq", "ip", "increment")


@query("w10_decayed_score", f"WITH RECURSIVE {SCORES} SELECT seq, ip, CAST(score_units AS BIGINT) AS score_units, "
       f"round(score_units / {2 * US}.0, 6) AS score FROM fold")
def w10(spark, folder):
    rows = windows.risk_scores(views.attempts(spark, folder), STRETCHED)
    return rows.select("seq", "ip", "score_units", F.round("score", 6).alias("score"))


BASES = {"baseline": HISTORY, "burst": COUNTS, "risk": SCORES, "global": COUNTS, "escalation": COUNTS, "subnet": COUNTS}


def _rule(number, name):
    sql = f"WITH RECURSIVE {BASES[name]}, {cooled_sql(CANDIDATES[name])} SELECT {ALERT_COLUMNS} FROM alerts"

    @query(f"d{number}_{name}", sql)
    def run(spark, folder):
        return rounded(rules.rule_alerts(views.attempts(spark, folder), STRETCHED, rules=[name]))


for _number, _name in enumerate(["baseline", "burst", "risk", "global", "escalation", "subnet"], start=1):
    _rule(_number, _name)


@query("d7_cooldown", f"WITH RECURSIVE {COUNTS}, {cooled_sql(CANDIDATES['global'])} "
       "SELECT seq, ts_us FROM alerts")
def d7(spark, folder):
    found = rules.global_candidates(views.attempts(spark, folder), STRETCHED)
    return rules.cool_down(found, STRETCHED).select("seq", "ts_us")


ALL_RULES = f"{HISTORY}, {SCORES.replace(sessions_sql(600) + ',', '').strip()}"


@query("d8_alert_set", f"WITH RECURSIVE {ALL_RULES}, {cooled_sql(' UNION ALL '.join(CANDIDATES.values()))} "
       f"SELECT {ALERT_COLUMNS} FROM alerts")
def d8(spark, folder):
    return rounded(rules.rule_alerts(views.attempts(spark, folder), STRETCHED))


# Every key with more than 40 rows counts as hot, so ranges and pointers do the work.
SPLIT = SkewPolicy(hot_rows=40)


@query("d8_alert_set_split", f"WITH RECURSIVE {ALL_RULES}, {cooled_sql(' UNION ALL '.join(CANDIDATES.values()))} "
       f"SELECT {ALERT_COLUMNS} FROM alerts")
def d8_split(spark, folder):
    return rounded(rules.rule_alerts(views.attempts(spark, folder), STRETCHED, SPLIT))


PROFILE = "prof AS (SELECT avg(value) AS mean, var_pop(value) AS variance, count(*) AS samples FROM events)"
GROUP_PROFILE = """prof AS (SELECT event_type, avg(value) AS mean, var_pop(value) AS variance, count(*) AS samples
                           FROM events GROUP BY event_type)"""


def _profile_columns(profile, *by):
    return profile.select(*by, F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), "samples")


@query("a1_baseline", f"WITH {PROFILE} SELECT round(mean, 6) AS mean, round(variance, 6) AS variance, samples FROM prof")
def a1(spark, folder):
    return _profile_columns(baseline.build_baseline(views.metrics(spark, folder)))


@query("a1_baseline_by_type",
       f"WITH {GROUP_PROFILE} SELECT event_type, round(mean, 6) AS mean, round(variance, 6) AS variance, samples FROM prof")
def a1_by_type(spark, folder):
    return _profile_columns(baseline.build_baseline(views.metrics(spark, folder), ["event_type"]), "event_type")


@query("d9_outliers", f"WITH {PROFILE} SELECT event_id, value, "
       "CASE WHEN variance = 0 THEN value <> mean ELSE abs(value - mean) > 3 * sqrt(variance) END AS anomaly "
       "FROM events, prof")
def d9(spark, folder):
    rows = views.metrics(spark, folder)
    return baseline.score_outliers(rows, baseline.build_baseline(rows)).select("event_id", "value", "anomaly")


@query("j2_outliers_by_type", f"WITH {GROUP_PROFILE} SELECT event_id, e.event_type, value, "
       "abs(value - mean) > 3 * sqrt(variance) AS anomaly FROM events e JOIN prof USING (event_type)")
def j2(spark, folder):
    rows = views.metrics(spark, folder)
    profile = baseline.build_baseline(rows, ["event_type"])
    scored = baseline.score_outliers(rows, profile, ["event_type"])
    return scored.select("event_id", "event_type", "value", "anomaly")
