"""Streams replayed from files, compared with the batch results (S2, T)."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from hostguard.operators.baseline import build_baseline
from hostguard.operators.quantiles import exact_percentiles
from hostguard.operators.rules import RULE_COLUMNS
from hostguard.operators.skew import SkewPolicy
from hostguard.plans import views
from hostguard.plans.detector_queries import (
    ALERT_COLUMNS, ALL_RULES, ATTEMPT_SQL, ATTEMPTS, CANDIDATES, COUNTS, GROUP_PROFILE, PROFILE, SHORT_TTL, STRETCHED, US, cooled_sql, rounded,
)
from hostguard.plans.registry import ORACLES, query
from hostguard.plans.row_queries import LINES
from hostguard.plans.table_queries import REPEAT_S, STATES, _recovery_inputs, _replay_sql, _states
from hostguard.session import Scratch
from hostguard.sources import lines as line_source
from hostguard.sources import snapshots
from hostguard.sources.deltas import DeltaState, Recovery
from hostguard.streaming import detectors, sinks
from hostguard.streaming.counters import CounterSink
from hostguard.streaming.incremental import IncrementalDetector
from hostguard.streaming.profiles import OutlierSink, ProfileSink

FILES = 10
# Rows of one file of a replayed stream.
FILE_ROWS = 500_000
# A row of its own key far ahead moves the watermark past the last real row.
END = "timestamp'2030-01-01 00:00:00'"


def replayed(
    spark, rows: DataFrame, end: DataFrame | None = None, files: int = FILES, order: str = "ts", file_rows: int = FILE_ROWS
) -> DataFrame:
    """``rows`` as a stream of ``files`` micro-batches in order of the column ``order``, closed by the row ``end``.

    Every micro-batch has the same number of files, so large ones are written and read by many tasks.
    """
    path = snapshots.scratch_path(rows, "stream")
    moment = F.unix_micros(order)
    part = F.lit(0)
    for cut in exact_percentiles(rows, moment, [i / files for i in range(1, files)]):
        part = part + (moment > cut).cast("int")
    staged = Scratch(spark)
    folder = staged.folder()
    rows.withColumn("_part", part).write.partitionBy("_part").parquet(folder)
    parted = spark.read.schema(StructType([*rows.schema, StructField("_part", IntegerType())])).parquet(folder)
    largest = parted.groupBy("_part").count().agg(F.max("count")).first()[0] or 0
    each = max(1, -(-largest // file_rows))
    for number in range(files):
        # Files are taken in the order in which they were written.
        share = parted.filter(F.col("_part") == number).drop("_part")
        (share.coalesce(1) if each == 1 else share.repartition(each)).write.mode("append").parquet(path)
        # A task without rows writes no file.
        while snapshots.data_files(rows, path) < (number + 1) * each:
            share.limit(0).coalesce(1).write.mode("append").parquet(path)
    staged.drop_folder(folder)
    if end is not None:
        end.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(path)


@contextmanager
def partitions(spark, n: int = 2):
    """Streams started inside keep their state in ``n`` partitions: a replay has many small batches."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def collected(spark, stream: DataFrame) -> DataFrame:
    """Run the stream over everything there is and read what it wrote."""
    detectors.use_rocksdb(spark)
    path = snapshots.scratch_path(stream, "out")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with partitions(spark):
        sinks.run_available(stream, write, snapshots.scratch_path(stream, "checkpoint"))
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)


def attempt_stream(spark, folder) -> DataFrame:
    rows = timed_attempts(spark, folder)
    end = spark.range(1).select(F.expr(END).alias("ts"), F.lit(-1).cast("bigint").alias("seq"), F.lit("end").alias("ip"))
    return replayed(spark, rows, end)


BY_ADDRESS = " UNION ALL ".join(CANDIDATES[name] for name in ("baseline", "burst", "risk", "escalation"))


@query("t1_address_alerts",
       f"WITH RECURSIVE {ALL_RULES}, {cooled_sql(BY_ADDRESS)} SELECT {ALERT_COLUMNS} FROM alerts")
def t1(spark, folder):
    alerts = detectors.address_alerts(attempt_stream(spark, folder), STRETCHED)
    return rounded(collected(spark, alerts).filter("seq >= 0")).select(*RULE_COLUMNS)


def with_ttl(sql: str, ttl: int) -> str:
    """The same statement with another idle time."""
    return sql.replace(str(600 * US), str(ttl * US))


@query("t2_idle_eviction",
       f"WITH RECURSIVE {with_ttl(ALL_RULES, 60)}, {cooled_sql(BY_ADDRESS)} SELECT {ALERT_COLUMNS} FROM alerts")
def t2(spark, folder):
    alerts = detectors.address_alerts(attempt_stream(spark, folder), SHORT_TTL)
    return rounded(collected(spark, alerts).filter("seq >= 0")).select(*RULE_COLUMNS)


def incrementally(spark, rows: DataFrame, detector: IncrementalDetector, files: int = FILES, order: str = "ts") -> DataFrame:
    """Alerts of ``rows``, taken in ``files`` micro-batches."""
    stream = replayed(spark, rows, None, files, order)
    with partitions(spark):
        sinks.run_available(stream, detector, snapshots.scratch_path(rows, "checkpoint"))
        detector.finish(spark)
    return detector.alerts(spark)


def timed_attempts(spark, folder) -> DataFrame:
    return views.attempts(spark, folder).select(F.timestamp_micros("ts_us").alias("ts"), "seq", "ip")


@query("t1_incremental_rules", f"WITH RECURSIVE {ALL_RULES}, {cooled_sql(' UNION ALL '.join(CANDIDATES.values()))} "
       f"SELECT {ALERT_COLUMNS} FROM alerts")
def t1_incremental(spark, folder):
    rows = timed_attempts(spark, folder)
    detector = IncrementalDetector(snapshots.scratch_path(rows, "detector"), STRETCHED, delay_s=3600)
    return rounded(incrementally(spark, rows, detector)).select(*RULE_COLUMNS)


HOT_IP = "CASE WHEN event_id % 10 < 9 THEN '10.0.0.1' ELSE concat('10.0.', user_id % 4, '.', user_id % 250 + 1) END"


@query("t1_hot_address", f"WITH RECURSIVE {ALL_RULES.replace(ATTEMPT_SQL, HOT_IP)}, {cooled_sql(' UNION ALL '.join(CANDIDATES.values()))} "
       f"SELECT {ALERT_COLUMNS} FROM alerts")
def t1_hot(spark, folder):
    """Nine of ten attempts come from one address, whose rows are cut in ranges."""
    rows = views.attempts(spark, folder).withColumn("ip", F.expr("CASE WHEN seq % 10 < 9 THEN '10.0.0.1' ELSE ip END"))
    rows = rows.select(F.timestamp_micros("ts_us").alias("ts"), "seq", "ip")
    detector = IncrementalDetector(snapshots.scratch_path(rows, "detector"), STRETCHED, SkewPolicy(hot_rows=200, ranges=8), 3600)
    return rounded(incrementally(spark, rows, detector, 3)).select(*RULE_COLUMNS)


DELAY = 3600
@query("t6_late_stream", f"""WITH ev AS (SELECT event_id, epoch_us(ts) AS ts_us, epoch_us(ts) + CAST(value * 60000000 AS BIGINT) AS arrived FROM events),
cut AS (SELECT quantile_cont(arrived, [{", ".join(str(i / FILES) for i in range(1, FILES))}]) AS c FROM ev),
part AS (SELECT ev.*, len(list_filter(c, lambda x: arrived > x)) AS part FROM ev, cut),
closed AS (SELECT part, max(max(ts_us)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {DELAY * 1000000} AS mark
           FROM part GROUP BY part),
flagged AS (SELECT event_id, ts_us, coalesce(ts_us <= mark, false) AS late FROM part JOIN closed USING (part))
SELECT event_id, ts_us, (SELECT count(*) FROM ev) AS n_rows, (SELECT count(*) FROM flagged WHERE late) AS n_late FROM flagged WHERE late""")
def t6_stream(spark, folder):
    """Rows arrive by their value in minutes late; what comes after its time was closed is set aside and counted."""
    rows = views.events(spark, folder).select(F.col("event_id").alias("seq"), "ts_us", F.col("event_type").alias("ip"), "value")
    rows = rows.withColumn("arrived", F.timestamp_micros((F.col("ts_us") + F.col("value") * 60_000_000).cast("bigint")))
    detector = IncrementalDetector(snapshots.scratch_path(rows, "detector"), delay_s=DELAY, rules=())
    incrementally(spark, rows, detector, order="arrived")
    counted = detector.marks(spark).select(F.col("rows").alias("n_rows"), F.col("late").alias("n_late"))
    return detector.late_rows(spark).select(F.col("seq").alias("event_id"), "ts_us").crossJoin(F.broadcast(counted))


@query("t3_subnet_alerts", f"WITH RECURSIVE {COUNTS}, {cooled_sql(CANDIDATES['subnet'])} "
       "SELECT rule, rule_order, key, seq, ts_us, ip, metric, threshold, message FROM alerts")
def t3(spark, folder):
    alerts = detectors.subnet_alerts(attempt_stream(spark, folder), STRETCHED)
    return collected(spark, alerts).filter("seq >= 0")


@query("t4_global_alerts", f"""WITH RECURSIVE {ATTEMPTS},
secs AS (SELECT ts_us - ts_us % 1000000 AS ts_us, count(*) AS n, max(seq) AS seq FROM att GROUP BY 1),
cnt AS (SELECT seq, ts_us, NULL AS ip, CAST(sum(n) OVER (ORDER BY ts_us RANGE BETWEEN {60 * US - 1} PRECEDING
        AND CURRENT ROW) AS BIGINT) AS global_count FROM secs),
{cooled_sql(CANDIDATES['global'])} SELECT rule, rule_order, key, seq, ts_us, metric, threshold, message FROM alerts""")
def t4(spark, folder):
    alerts = detectors.global_alerts(attempt_stream(spark, folder), STRETCHED)
    return collected(spark, alerts).filter("seq >= 0").drop("ip")


@query("t5_repeated_lines_stream", f"""WITH RECURSIVE {LINES},
kept AS (SELECT line, min(ts_us) AS at FROM lines GROUP BY line
  UNION ALL
  SELECT l.line, min(l.ts_us) FROM kept k JOIN lines l ON l.line = k.line AND l.ts_us > k.at + {REPEAT_S * 1000000}
  GROUP BY l.line)
SELECT event_id, lines.line FROM lines JOIN kept ON kept.line = lines.line AND kept.at = lines.ts_us""")
def t5(spark, folder):
    rows = views.lines(spark, folder).select(F.timestamp_micros("ts_us").alias("ts"), F.col("event_id").alias("seq"), "line")
    end = spark.range(1).select(F.expr(END).alias("ts"), F.lit(-1).cast("bigint").alias("seq"), F.lit("end").alias("line"))
    kept = detectors.suppress_repeats(replayed(spark, rows, end), ["line"], REPEAT_S)
    return collected(spark, kept).filter("seq >= 0").select(F.col("seq").alias("event_id"), "line")


@query("t6_late_rows", """SELECT event_id, value > 60 AS late FROM events""")
def t6(spark, folder):
    rows = views.events(spark, folder).select("event_id", F.timestamp_micros("ts_us").alias("ts"), "value")
    rows = rows.withColumn("arrived", F.timestamp_micros((F.unix_micros("ts") + F.col("value") * 60_000_000).cast("bigint")))
    in_time, late = detectors.split_late(rows, "ts", "arrived", "60 MINUTES")
    flagged = in_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return flagged.select("event_id", "late")


@query("t7_alert_lines", f"""WITH RECURSIVE {COUNTS}, {cooled_sql(CANDIDATES['subnet'])}
SELECT strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((ts_us // 1000) % 1000 AS VARCHAR), 3, '0')
  || ' | SECURITY | WARNING | ' || message || ' | ' AS value FROM alerts""")
def t7(spark, folder):
    alerts = detectors.subnet_alerts(attempt_stream(spark, folder), STRETCHED).filter("seq >= 0")
    path = snapshots.scratch_path(alerts, "alert-lines")
    detectors.use_rocksdb(spark)
    with partitions(spark):
        sinks.run_available(alerts, sinks.alert_line_sink(path), snapshots.scratch_path(alerts, "checkpoint"))
    return spark.read.text(path).select("value")


@query("t7_delta_state", f"""WITH {STATES} SELECT ip, state_json, round(secs, 6) AS last_updated FROM upserted
WHERE ip NOT IN (SELECT ip FROM gone)""")
def t7_state(spark, folder):
    """State of ten micro-batches kept as changes with a compaction every third, then a batch of deletions."""
    stored, rows = _states(spark, folder)
    state = DeltaState(snapshots.scratch_path(rows, "state"), stored, compact_every=3)
    state(stored.withColumn("seq", F.lit(0)), 0)
    updates = rows.filter("event_type = 'error'").withColumn("ts", F.timestamp_micros((F.col("last_updated") * 1_000_000).cast("bigint")))
    stream = replayed(spark, updates.drop("event_type", "value"))
    with partitions(spark):
        sinks.run_available(stream, lambda batch, number: state(batch, number + 1), snapshots.scratch_path(rows, "checkpoint"))
        gone = rows.filter("event_type = 'signup' AND value > 200").withColumn("deleted", F.lit(True))
        state(gone, FILES + 1)
    return state.state(spark).withColumn("last_updated", F.round("last_updated", 6))


@query("s8_recovery_in_steps", _replay_sql(1, 2, "{}", "state_json"))
def s8_steps(spark, folder):
    """The change log taken in three steps; each reads only what is after the mark."""
    states, histories, log = _recovery_inputs(spark, folder)
    recovery = Recovery(snapshots.scratch_path(log, "recovery"), states, histories)
    last = log.agg(F.max("id")).first()[0]
    for step in (last // 3, 2 * last // 3, last):
        recovery.advance(log.filter(F.col("id") <= step))
    return recovery.tables(spark)[0].withColumn("last_updated", F.round("last_updated", 6))


@query("x6_hooks", """SELECT hook, event_type, count(*) AS n FROM (SELECT CASE WHEN value > 60 THEN 'error' ELSE 'event' END AS hook, event_type FROM events)
GROUP BY hook, event_type""")
def x6(spark, folder):
    """Hooks see the accepted and the refused rows of every micro-batch; here each writes what it saw."""
    rows = views.events(spark, folder).select(F.timestamp_micros("ts_us").alias("ts"), "event_type", F.when(F.col("value") > 60, F.lit("too large")).alias("error"))
    folders = [snapshots.scratch_path(rows, name) for name in ("good", "bad", "seen")]

    def hook(name):
        return lambda part, number: part.select(F.lit(name).alias("hook"), "event_type").write.mode("overwrite").parquet(f"{folders[2]}/{name}-{number}")

    sink = sinks.quarantine_sink(*folders[:2], on_event=hook("event"), on_error=hook("error"))
    sinks.run_available(replayed(spark, rows), sink, snapshots.scratch_path(rows, "checkpoint"))
    seen = spark.read.schema("hook string, event_type string").option("recursiveFileLookup", True).parquet(folders[2])
    return seen.groupBy("hook", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a2_stream_counters", ORACLES["a2_collector_counters"])
def a2_stream(spark, folder):
    rows = views.lines(spark, folder, "user_id").withColumns({"source": F.expr("concat('host', user_id % 5)"), "ts": F.timestamp_micros("ts_us")})
    line = F.col("line")
    parsed = line.startswith("Failed password for ") | line.startswith("EXEC: ")
    counters = CounterSink(snapshots.scratch_path(rows, "counters"), "source", parsed, F.col("user_id") == 13, F.col("ts_us") / 1_000_000)
    with partitions(spark):
        sinks.run_available(replayed(spark, rows), counters, snapshots.scratch_path(rows, "checkpoint"))
    return counters.totals(spark).withColumn("last_event_time", F.round("last_event_time", 6))


@query("s5_unknown_keys", """SELECT 'ev-' || event_id AS id, CASE WHEN event_id % 7 = 1 THEN NULL ELSE event_type END AS type,
  CASE WHEN event_id % 7 = 1 OR event_id % 7 = 2 THEN NULL ELSE CAST(user_id AS INT) END AS pid,
  CASE WHEN event_id % 7 = 1 THEN NULL ELSE '{"kept":"' || user_id || '","zone":"z' || (event_id % 3) || '"}' END AS data,
  CASE event_id % 7 WHEN 1 THEN 'not a JSON object' WHEN 2 THEN 'unreadable numbers: pid' END AS error FROM events""")
def s5_unknown(spark, folder):
    """Records with a key of their own; every seventh is cut off, every seventh has a number that is none."""
    rows = views.events(spark, folder)
    name = F.concat(F.lit("ev-"), F.col("event_id").cast("string"))
    pid = F.when(F.col("event_id") % 7 == 2, F.lit("none")).otherwise(F.col("user_id").cast("string"))
    data = F.create_map(F.lit("kept"), F.col("user_id").cast("string"))
    record = F.to_json(F.struct(name.alias("id"), F.col("event_type").alias("type"), pid.alias("pid"), data.alias("data"), F.concat(F.lit("z"), F.col("event_id") % 3).alias("zone")))
    text = F.when(F.col("event_id") % 7 == 1, F.expr("concat('{\"id\": \"ev-', event_id)")).otherwise(record)
    path = snapshots.scratch_path(rows, "records")
    rows.select(text.alias("value")).write.text(path)
    found = line_source.read_event_records(spark, path)
    entries = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("data"))))
    given = F.coalesce("id", F.regexp_extract("json", r"ev-\d+", 0))
    return found.select(given.alias("id"), "type", "pid", entries.alias("data"), "error")


@query("t8_stream_outliers", f"WITH {PROFILE} SELECT event_id, value, "
       "CASE WHEN variance = 0 THEN value <> mean ELSE abs(value - mean) > 3 * sqrt(variance) END AS anomaly "
       "FROM events, prof")
def t8(spark, folder):
    rows = views.metrics(spark, folder)
    profile = build_baseline(rows)
    source = replayed(spark, rows.withColumn("ts", F.timestamp_micros("ts_us")), None)
    scored = detectors.score_stream(source, profile)
    return collected(spark, scored.select("event_id", "value", "anomaly"))


@query("a1_running_profile",
       f"WITH {GROUP_PROFILE} SELECT event_type, round(mean, 6) AS mean, round(variance, 6) AS variance, samples FROM prof")
def a1_running(spark, folder):
    """The profile per type after ten micro-batches, each merged with the version before it."""
    rows = views.metrics(spark, folder)
    profile = ProfileSink(snapshots.scratch_path(rows, "profile"), ["event_type"])
    source = replayed(spark, rows.withColumn("ts", F.timestamp_micros("ts_us")))
    with partitions(spark):
        sinks.run_available(source, profile, snapshots.scratch_path(rows, "checkpoint"))
    found = profile.profile(spark)
    return found.select("event_type", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), "samples")


@query("t8_running_outliers", f"""WITH e AS (SELECT event_id, event_type, value, epoch_us(ts) AS us FROM events),
cuts AS (SELECT unnest(quantile_cont(us, {[i / FILES for i in range(1, FILES)]})) AS cut FROM e),
p AS (SELECT *, (SELECT count(*) FROM cuts WHERE us > cut) AS part FROM e),
prof AS (SELECT k.part, event_type, avg(value) AS mean, var_pop(value) AS variance
         FROM range({FILES}) AS k(part) JOIN p ON p.part < k.part GROUP BY k.part, event_type)
SELECT event_id, value, CASE WHEN variance = 0 THEN value <> mean ELSE abs(value - mean) > 2 * sqrt(variance) END AS anomaly
FROM p LEFT JOIN prof USING (part, event_type)""")
def t8_running(spark, folder):
    """Ten micro-batches, each scored per type by the profile of those before it."""
    rows = views.metrics(spark, folder)
    path = snapshots.scratch_path(rows, "out")

    def write(scored: DataFrame, number: int) -> None:
        scored.select("event_id", "value", "anomaly").write.mode("overwrite").parquet(f"{path}/batch={number}")

    sink = OutlierSink(ProfileSink(snapshots.scratch_path(rows, "profile"), ["event_type"]), write, sigmas=2)
    with partitions(spark):
        sinks.run_available(replayed(spark, rows.withColumn("ts", F.timestamp_micros("ts_us"))), sink, snapshots.scratch_path(rows, "checkpoint"))
    return spark.read.schema("event_id long, value double, anomaly boolean").parquet(path).select("event_id", "value", "anomaly")


@query("s2_new_lines", f"WITH {LINES} SELECT line, count(*) AS n FROM lines GROUP BY line")
def s2(spark, folder):
    rows = views.lines(spark, folder)
    path = snapshots.scratch_path(rows, "logs")
    rows.repartition(3).select("line").write.text(path)
    stream = line_source.stream_lines(spark, path, files_per_trigger=1, pattern="*.txt")
    return collected(spark, stream).groupBy("line").agg(F.count("*").alias("n"))
