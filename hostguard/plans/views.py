"""Views that read the benchmark tables as login attempts, log lines, metrics, events and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTEMPT_IP = "concat('10.0.', user_id % 4, '.', user_id % 250 + 1)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table with its time as epoch microseconds, whatever the session time zone is."""
    rows = table(spark, folder, "events")
    if dict(rows.dtypes)["ts"] == "timestamp_ntz":
        at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    else:
        at = F.unix_micros("ts")
    return rows.withColumn("ts_us", at)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows over all cores before they grow: a table in one file of few row groups is read by few tasks."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    rows = events(spark, folder).filter("event_type = 'error'")
    return rows.select(F.col("event_id").alias("seq"), "ts_us", F.expr(ATTEMPT_IP).alias("ip"))


def lines(spark: SparkSession, folder: str, *also: str) -> DataFrame:
    """One log line per event; (event_id, ts_us, line) and the event columns in ``also``."""
    line = f"""
        CASE WHEN event_type = 'error' AND event_id % 5 = 0
               THEN concat('sshd: authentication failure; rhost=', {ATTEMPT_IP}, ' user=u', user_id)
             WHEN event_type = 'error'
               THEN concat('Failed password for u', user_id, ' from ', {ATTEMPT_IP},
                           ' port ', 1024 + event_id % 60000)
             WHEN event_type = 'purchase' THEN concat('EXEC: proc', user_id % 7, ' [PID: ', event_id + 1, ']')
             WHEN event_type = 'click' THEN concat('GET /p', user_id % 9, '.php?cmd=', user_id)
             WHEN event_type = 'signup' THEN concat('type=SYSCALL msg=audit name="/etc/passwd" uid=', user_id)
             WHEN event_id % 10 = 0 THEN ''
             ELSE concat('INFO session ok u', user_id) END"""
    return events(spark, folder).select("event_id", "ts_us", F.expr(line).alias("line"), *also)


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select("event_id", "ts_us", "event_type", F.col("value").alias("metric"))


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document; (doc_id, line_no, line)."""
    rows = table(spark, folder, "documents")
    return rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
