"""Aggregates, keyed state, triage, file sources and repeat suppression (A2-A9, S, L, J4, T5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostguard.operators import alerts, lifecycle, metrics, state, thinning, triage
from hostguard.plans import views
from hostguard.plans.registry import query
from hostguard.plans.row_queries import AS_OF, LINES, NORMAL_ALERTS, NORMAL_SQL, normal_alerts, normal_events
from hostguard.sources import lines as line_source
from hostguard.sources import snapshots

EV = """ev AS (SELECT *, epoch_us(ts) AS ts_us, concat('10.0.', user_id % 4, '.', user_id % 250 + 1) AS ip FROM events)"""

DAY_US = 86_400_000_000
WINDOW_S = 21_600


@query("a2_collector_counters", f"""WITH {LINES},
c AS (SELECT 'host' || (user_id % 5) AS source, ts_us / 1000000.0 AS seconds, user_id = 13 AS broken,
  starts_with(line, 'Failed password for ') OR starts_with(line, 'EXEC: ') AS parsed FROM lines)
SELECT source, count(*) AS lines, count(*) FILTER (parsed AND NOT broken) AS events,
  count(*) FILTER (NOT parsed AND NOT broken) AS discards, count(*) FILTER (broken) AS parse_errors,
  round(max(seconds) FILTER (parsed AND NOT broken), 6) AS last_event_time FROM c GROUP BY source""")
def a2(spark, folder):
    rows = views.lines(spark, folder, "user_id").withColumn("source", F.expr("concat('host', user_id % 5)"))
    line = F.col("line")
    parsed = line.startswith("Failed password for ") | line.startswith("EXEC: ")
    counted = metrics.collector_counters(rows, "source", parsed, F.col("user_id") == 13, F.col("ts_us") / 1_000_000)
    return counted.withColumn("last_event_time", F.round("last_event_time", 6))


@query("a3_event_rate", f"""WITH {EV}, r AS (SELECT event_type, ts_us,
  row_number() OVER (PARTITION BY event_type ORDER BY ts_us DESC) AS rn FROM ev)
SELECT event_type, count(*) AS events, round((count(*) - 1) / ((max(ts_us) - min(ts_us)) / 1000000.0), 9) AS rate
FROM r WHERE rn <= 1000 GROUP BY event_type""")
def a3(spark, folder):
    rates = metrics.event_rate(views.metrics(spark, folder), "event_type")
    return rates.withColumn("rate", F.round("rate", 9))


AS_OF_US = 1_705_276_800_000_000


@query("a4_rate_as_of", f"""WITH {EV} SELECT event_type, count(*) FILTER (ts_us BETWEEN {AS_OF_US - WINDOW_S * 1000000}
  AND {AS_OF_US}) AS events, round(count(*) FILTER (ts_us BETWEEN {AS_OF_US - WINDOW_S * 1000000} AND {AS_OF_US})
  / {WINDOW_S}.0, 9) AS rate FROM ev GROUP BY event_type""")
def a4(spark, folder):
    rates = metrics.rate_as_of(views.metrics(spark, folder), "event_type", F.lit(AS_OF_US), WINDOW_S)
    return rates.withColumn("rate", F.round("rate", 9))


@query("a4_trailing_rate", f"""WITH {EV}, c AS (SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type
  ORDER BY ts_us RANGE BETWEEN {WINDOW_S * 1000000} PRECEDING AND CURRENT ROW) AS events FROM ev)
SELECT event_id, event_type, events, round(events / {WINDOW_S}.0, 9) AS rate FROM c""")
def a4_trailing(spark, folder):
    rows = views.metrics(spark, folder).select(F.col("event_id").alias("seq"), "ts_us", "event_type")
    rates = metrics.trailing_rate(rows, ["event_type"], WINDOW_S)
    return rates.select(F.col("seq").alias("event_id"), "event_type", "events", F.round("rate", 9).alias("rate"))


# A window of the whole month holds thousands of events of a type.
MONTH_S = 31 * 86400


@query("a4_trailing_rate_month", f"""WITH {EV}, c AS (SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type
  ORDER BY ts_us RANGE BETWEEN {MONTH_S * 1000000} PRECEDING AND CURRENT ROW) AS events FROM ev)
SELECT event_id, event_type, events, round(events / {MONTH_S}.0, 9) AS rate FROM c""")
def a4_trailing_month(spark, folder):
    rows = views.metrics(spark, folder).select(F.col("event_id").alias("seq"), "ts_us", "event_type")
    rates = metrics.trailing_rate(rows, ["event_type"], MONTH_S)
    return rates.select(F.col("seq").alias("event_id"), "event_type", "events", F.round("rate", 9).alias("rate"))


BOUND = "CASE " + " ".join(f"WHEN value <= {b} THEN {b}" for b in metrics.WAIT_BOUNDS) + " END"


@query("a5_latency_histogram", f"""WITH b AS (SELECT event_type, CAST({BOUND} AS DOUBLE) AS bound FROM events)
SELECT event_type, bound, count(*) AS n FROM b WHERE bound IS NOT NULL GROUP BY ALL""")
def a5(spark, folder):
    return metrics.latency_histogram(views.metrics(spark, folder), "metric", ["event_type"])


def _percentile_sql(p: int) -> str:
    return f"""coalesce((SELECT min(bound) FROM cum WHERE cum.event_type = t.event_type AND cum.upto * 100 >= cum.total * {p}),
  max_wait) AS p{p}_wait"""


@query("a5_latency_summary", f"""WITH b AS (SELECT event_type, value, CAST({BOUND} AS DOUBLE) AS bound FROM events),
h AS (SELECT event_type, bound, count(*) AS n FROM b WHERE bound IS NOT NULL GROUP BY ALL),
cum AS (SELECT event_type, bound, sum(n) OVER (PARTITION BY event_type ORDER BY bound) AS upto,
               sum(n) OVER (PARTITION BY event_type) AS total FROM h),
t AS (SELECT event_type, count(*) AS n, avg(value) AS avg_wait, max(value) AS max_wait FROM events GROUP BY event_type)
SELECT event_type, n, round(avg_wait, 6) AS avg_wait, max_wait, {_percentile_sql(50)}, {_percentile_sql(95)},
  {_percentile_sql(99)} FROM t""")
def a5_summary(spark, folder):
    summary = metrics.latency_summary(views.metrics(spark, folder), "metric", ["event_type"])
    return summary.withColumn("avg_wait", F.round("avg_wait", 6))


def _runs(spark, folder):
    """Events as task outcomes: (worker, day, seq, ok, alerts, seconds, backlog)."""
    return views.events(spark, folder).selectExpr(
        "user_id % 8 AS worker", f"ts_us div {DAY_US} AS day", "event_id AS seq", "ts_us", "value > 5.0 AS ok",
        "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS alerts", "value / 10 AS seconds", "user_id * 8 AS backlog",
    )


RUNS = f"""{EV}, runs AS (SELECT user_id % 8 AS worker, ts_us // {DAY_US} AS day, event_id AS seq, ts_us, value > 5.0 AS ok,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS alerts, value / 10 AS seconds, user_id * 8 AS backlog FROM ev)"""
LE = ", ".join(f"count(*) FILTER (seconds <= {b}) AS le_{f'{b:g}'.replace('.', '_')}" for b in metrics.DURATION_BOUNDS)


@query("a6_outcomes", f"""WITH {RUNS} SELECT worker, count(*) AS total_processed, count(*) FILTER (ok) AS success_count,
  count(*) FILTER (NOT ok) AS failure_count, CAST(sum(alerts) AS BIGINT) AS alerts_generated, {LE} FROM runs GROUP BY worker""")
def a6(spark, folder):
    return metrics.outcome_rollup(_runs(spark, folder), ["worker"], F.col("ok"), F.col("alerts"), F.col("seconds"))


EWMA_SQL = "list_reduce(list(seconds ORDER BY ts_us), lambda acc, x: 0.9 * acc + 0.1 * x)"


@query("a7_ewma", f"WITH {RUNS} SELECT worker, round({EWMA_SQL}, 6) AS ewma FROM runs GROUP BY worker")
def a7(spark, folder):
    means = metrics.ewma(_runs(spark, folder), ["worker"], "seconds", ["ts_us"])
    return means.withColumn("ewma", F.round("ewma", 6))


@query("a8_health", f"""WITH {RUNS}, m AS (SELECT worker, day, count(*) AS total, count(*) FILTER (ok) AS good,
  count(*) FILTER (NOT ok) AS bad, max(backlog) AS backlog, {EWMA_SQL} AS ewma FROM runs GROUP BY worker, day)
SELECT worker, day, CAST(greatest(0, least(100, 100 - CASE WHEN worker = 3 THEN 20 ELSE 0 END
    - CASE WHEN backlog > 1000 THEN 30 WHEN backlog > 700 THEN 10 ELSE 0 END
    - CASE WHEN bad > 0.2 * total THEN 20 WHEN bad > 0.1 * total THEN 10 ELSE 0 END)) AS INTEGER) AS health_score,
  round(good / CAST(total AS DOUBLE), 3) AS worker_efficiency, round(backlog / 1000.0::DOUBLE, 3) AS queue_pressure,
  round(1 / ewma, 2) AS recent_throughput_eps, backlog > 800 AND 1 / ewma < 0.1 AS stagnation_detected FROM m""")
def a8(spark, folder):
    runs, keys = _runs(spark, folder), ["worker", "day"]
    totals = metrics.outcome_totals(F.col("ok"), F.col("alerts"), F.col("seconds"))
    rows = metrics.ewma(runs, keys, "seconds", ["ts_us"], also={**totals, "backlog": F.max("backlog")})
    alive = F.when(F.col("worker") == 3, F.lit(3)).otherwise(F.lit(4))
    scored = metrics.health(rows, alive=alive)
    return scored.select(*keys, "health_score", "worker_efficiency", "queue_pressure", "recent_throughput_eps",
                         "stagnation_detected")


def _alert_actions(spark, folder):
    rows = views.events(spark, folder)
    found = rows.select(F.expr("concat('a', user_id)").alias("id")).distinct().withColumns(
        {
            "timestamp": F.lit(AS_OF),
            "severity": F.lit("ERROR"),
            "message": F.lit("watched"),
            "event_id": F.lit(None).cast("string"),
            "source": F.lit("auth.log"),
            "correlation_id": F.lit(None).cast("string"),
            "metadata": F.create_map(F.lit("origin"), F.lit("seed")),
            "acknowledged": F.lit(False),
            "acknowledged_at": F.lit(None).cast("double"),
            "resolved": F.lit(False),
            "resolved_at": F.lit(None).cast("double"),
            "version": F.lit(1),
        }
    )
    actions = rows.selectExpr(
        "concat('a', user_id) AS alert_id", "event_id AS seq", "ts_us / 1000000 AS ts",
        """CASE event_type WHEN 'click' THEN 'acknowledge' WHEN 'purchase' THEN 'resolve'
           WHEN 'view' THEN 'remove_metadata' ELSE 'set_metadata' END AS action""",
        "CASE event_type WHEN 'signup' THEN 'origin' ELSE concat('k', event_id % 5) END AS key",
        "CASE WHEN value > 100 THEN NULL ELSE props END AS value",
    )
    return lifecycle.apply_actions(found, actions)


ACTIONS = f"""{EV}, act AS (SELECT 'a' || user_id AS alert_id, event_id AS seq, ts_us / 1000000.0 AS secs,
  CASE event_type WHEN 'click' THEN 'ack' WHEN 'purchase' THEN 'resolve' WHEN 'view' THEN 'remove' ELSE 'set' END AS action,
  CASE event_type WHEN 'signup' THEN 'origin' ELSE 'k' || (event_id % 5) END AS key,
  CASE WHEN value > 100 THEN NULL ELSE props END AS value FROM ev),
acked AS (SELECT alert_id, min(seq) FILTER (action = 'ack') AS ack_seq FROM act GROUP BY alert_id)"""


@query("a9_lifecycle", f"""WITH {ACTIONS}, state AS (SELECT alert_id AS id,
  count(*) FILTER (action = 'ack') > 0 AS acknowledged, round(max(secs) FILTER (action = 'ack'), 6) AS acknowledged_at,
  coalesce(bool_or(action = 'resolve' AND seq > ack_seq), false) AS resolved,
  round(max(secs) FILTER (action = 'resolve' AND seq > ack_seq), 6) AS resolved_at,
  CAST(1 + count(*) FILTER (action IN ('set', 'remove')) AS INTEGER) AS version
  FROM act JOIN acked USING (alert_id) GROUP BY alert_id),
given AS (SELECT alert_id, -1 AS seq, 'set' AS action, 'origin' AS key, 'seed' AS value FROM acked
  UNION ALL SELECT alert_id, seq, action, key, value FROM act WHERE action IN ('set', 'remove')),
final AS (SELECT alert_id, key, arg_max(action, seq) AS action, arg_max(coalesce(value, '~'), seq) AS value
  FROM given GROUP BY alert_id, key),
meta AS (SELECT alert_id, string_agg(key || ':' || value, '|' ORDER BY key) AS metadata
  FROM final WHERE action = 'set' AND value <> '~' GROUP BY alert_id)
SELECT id, acknowledged, acknowledged_at, resolved, resolved_at, version, concat_ws('|', 'ERROR', 'watched', 'auth.log', metadata)
  AS dedup_key FROM state LEFT JOIN meta ON id = alert_id""")
def a9(spark, folder):
    current, _ = _alert_actions(spark, folder)
    return current.select("id", "acknowledged", F.round("acknowledged_at", 6).alias("acknowledged_at"), "resolved",
                          F.round("resolved_at", 6).alias("resolved_at"), "version", "dedup_key")


@query("a9_refused_actions", f"""WITH {ACTIONS} SELECT alert_id, seq, action || '' AS action,
  'resolved before it was acknowledged' AS error FROM act JOIN acked USING (alert_id)
  WHERE action = 'resolve' AND (ack_seq IS NULL OR seq < ack_seq)""")
def a9_refused(spark, folder):
    _, refused = _alert_actions(spark, folder)
    return refused.select("alert_id", "seq", "action", "error")


PRIORITIES = f"""{NORMAL_ALERTS}, pr AS (SELECT seq, CASE WHEN severity IN ('CRITICAL', 'ERROR') THEN 0
  WHEN severity = 'INFO' THEN 2 ELSE 1 END AS priority FROM norm)"""


def _prioritized(spark, folder):
    rows = normal_alerts(spark, folder)
    return rows.select("seq", alerts.priority(F.col("severity")).alias("priority"))


@query("l1_triage", f"WITH {PRIORITIES} SELECT seq, priority FROM pr ORDER BY priority, seq LIMIT 5000")
def l1(spark, folder):
    return triage.take_first(_prioritized(spark, folder), 5000)


@query("l2_quota_triage", f"""WITH {PRIORITIES}, r AS (SELECT seq, priority,
  row_number() OVER (PARTITION BY priority ORDER BY seq) AS rn FROM pr)
SELECT seq, priority FROM r WHERE CASE priority WHEN 0 THEN rn <= 1500 WHEN 1 THEN rn <= 500 ELSE true END
ORDER BY priority, seq LIMIT 5000""")
def l2(spark, folder):
    return triage.take_with_quotas(_prioritized(spark, folder), 5000, {0: 0.3, 1: 0.1})


@query("s1_scan_lines", f"WITH {LINES} SELECT 'host=' || (user_id % 5) AS folder, line, count(*) AS n FROM lines GROUP BY ALL")
def s1(spark, folder):
    rows = views.lines(spark, folder, "user_id").withColumn("host", F.expr("user_id % 5"))
    path = snapshots.scratch_path(rows, "logs")
    rows.select("host", "line").write.partitionBy("host").text(path)
    found = line_source.read_lines(spark, path, "*.txt")
    return found.groupBy(F.regexp_extract("file_path", "(host=[0-9]+)", 1).alias("folder"), "line").agg(F.count("*").alias("n"))


@query("s3_last_lines", f"""WITH {LINES}, tail AS (SELECT event_id, line FROM lines ORDER BY event_id DESC LIMIT 1000)
SELECT event_id, 'log_line' AS type, trim(line) AS message, {AS_OF}::DOUBLE AS timestamp FROM tail WHERE trim(line) <> ''""")
def s3(spark, folder):
    return line_source.last_lines(views.lines(spark, folder), 1000, ["event_id"], F.lit(AS_OF))


@query("s5_event_buffer", f"""WITH {NORMAL_SQL} SELECT 'ev-' || event_id AS id, timestamp::DOUBLE AS timestamp, type, pid, severity, data, tags,
  hostname, correlation_id, source FROM norm""")
def s5(spark, folder):
    rows = normal_events(spark, folder).withColumn("id", F.concat(F.lit("ev-"), "event_id"))
    path = snapshots.scratch_path(rows, "events")
    line_source.save_event_buffer(rows, path)
    entries = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("data"))))
    return line_source.read_event_buffer(spark, path).withColumns({"data": entries, "tags": F.concat_ws(",", "tags")})


def _states(spark, folder):
    rows = views.events(spark, folder).withColumn("ip", F.expr(views.ATTEMPT_IP))
    text = F.concat(F.lit('{"n": '), F.col("event_id").cast("string"), F.lit("}"))
    rows = rows.select("event_type", "ip", text.alias("state_json"), (F.col("ts_us") / 1_000_000).alias("last_updated"),
                       F.col("event_id").alias("seq"), "value")
    stored = state.last_write(rows.filter("event_type = 'view'"), ["ip"], ["last_updated", "seq"])
    return stored.select("ip", "state_json", "last_updated"), rows


STATES = f"""{EV}, rows AS (SELECT event_type, ip, '{{"n": ' || event_id || '}}' AS state_json, ts_us / 1000000.0 AS secs,
  event_id AS seq, value FROM ev),
newest AS (SELECT *, row_number() OVER (PARTITION BY ip, event_type ORDER BY secs DESC, seq DESC) AS rn FROM rows),
stored AS (SELECT * FROM newest WHERE event_type = 'view' AND rn = 1),
fresh AS (SELECT * FROM newest WHERE event_type = 'error' AND rn = 1),
upserted AS (SELECT * FROM fresh UNION ALL SELECT * FROM stored WHERE ip NOT IN (SELECT ip FROM fresh)),
gone AS (SELECT DISTINCT ip FROM rows WHERE event_type = 'signup' AND value > 200)"""


@query("s7_snapshot", f"""WITH {STATES} SELECT ip, state_json, round(secs, 6) AS last_updated FROM upserted
WHERE ip NOT IN (SELECT ip FROM gone)""")
def s7(spark, folder):
    stored, rows = _states(spark, folder)
    current = state.upsert(stored, rows.filter("event_type = 'error'").drop("event_type", "value"))
    gone = rows.filter("event_type = 'signup' AND value > 200")
    return state.delete_keys(current, gone).withColumn("last_updated", F.round("last_updated", 6))


@query("j4_upsert", f"WITH {STATES} SELECT ip, state_json FROM upserted")
def j4(spark, folder):
    stored, rows = _states(spark, folder)
    return state.upsert(stored, rows.filter("event_type = 'error'").drop("event_type", "value")).select("ip", "state_json")


OPERATIONS = "CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 4 ELSE 1 END"


def _change_log(spark, folder):
    """Events as a change log; entries with a large value carry a wrong checksum."""
    rows = views.events(spark, folder).withColumns({"ip": F.expr(views.ATTEMPT_IP), "op_type": F.expr(OPERATIONS)})
    value = F.expr("CASE WHEN op_type IN (1, 3) THEN concat('{\"n\": ', event_id, '}') ELSE 'null' END")
    micros = F.expr("concat(ts_us div 1000000, '.', coalesce(nullif(rtrim('0', lpad(ts_us % 1000000, 6, '0')), ''), '0'))")
    right = F.sha2(F.concat_ws(":", "op_type", "ip", value, micros), 256)
    return rows.select(
        F.col("event_id").alias("id"), "op_type", F.col("ip").alias("key"), value.alias("value_json"),
        (F.col("ts_us") / 1_000_000).alias("timestamp"),
        F.when(F.col("value") > 100, F.lit("0" * 64)).otherwise(right).alias("checksum"),
    )


def _recovery_inputs(spark, folder):
    addresses = views.events(spark, folder).select(F.expr(views.ATTEMPT_IP).alias("ip")).distinct()
    states = addresses.select("ip", F.lit("{}").alias("state_json"), F.lit(0.0).alias("last_updated"))
    histories = addresses.select("ip", F.lit("[]").alias("history_json"), F.lit(0.0).alias("last_updated"))
    return states, histories, _change_log(spark, folder)


def _replayed(spark, folder):
    return state.replay(*_recovery_inputs(spark, folder))


def _replay_sql(insert: int, delete: int, empty: str, column: str) -> str:
    return f"""WITH {EV}, log AS (SELECT ip, event_id, ts_us, {OPERATIONS} AS op FROM ev WHERE NOT value > 100),
last AS (SELECT ip, arg_max(op, event_id) AS op, max(event_id) AS id, arg_max(ts_us, event_id) AS ts_us
  FROM log WHERE op IN ({insert}, {delete}) GROUP BY ip)
SELECT ip, CASE WHEN op = {insert} THEN '{{"n": ' || id || '}}' ELSE '{empty}' END AS {column},
  CASE WHEN op = {insert} THEN round(last.ts_us / 1000000.0, 6) ELSE 0.0::DOUBLE END AS last_updated
FROM (SELECT DISTINCT ip FROM ev) LEFT JOIN last USING (ip) WHERE op IS NULL OR op = {insert}"""


@query("s8_replay_states", _replay_sql(1, 2, "{}", "state_json"))
def s8_states(spark, folder):
    states, _ = _replayed(spark, folder)
    return states.withColumn("last_updated", F.round("last_updated", 6))


@query("s8_replay_histories", _replay_sql(3, 4, "[]", "history_json"))
def s8_histories(spark, folder):
    _, histories = _replayed(spark, folder)
    return histories.withColumn("last_updated", F.round("last_updated", 6))


@query("s8_corrupted", "SELECT count(*) FILTER (value > 100) AS corrupted, count(*) AS entries FROM events")
def s8_corrupted(spark, folder):
    return state.corrupted_entries(_change_log(spark, folder))


REPEAT_S = 43_200


@query("t5_repeated_lines", f"""WITH RECURSIVE {LINES},
kept AS (SELECT line, min(ts_us) AS at FROM lines GROUP BY line
  UNION ALL
  SELECT l.line, min(l.ts_us) FROM kept k JOIN lines l ON l.line = k.line AND l.ts_us > k.at + {REPEAT_S * 1000000}
  GROUP BY l.line)
SELECT event_id, lines.line FROM lines JOIN kept ON kept.line = lines.line AND kept.at = lines.ts_us""")
def t5(spark, folder):
    rows = views.lines(spark, folder).withColumnRenamed("event_id", "seq")
    kept = thinning.suppress_repeats(rows, ["line"], REPEAT_S)
    return kept.select(F.col("seq").alias("event_id"), "line")
