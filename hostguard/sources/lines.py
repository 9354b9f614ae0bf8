"""Log lines, event buffers and alert lines in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostguard.functions.text import stripped
from hostguard.operators.alerts import alert_line
from hostguard.operators.events import event_fields
from hostguard.operators.skew import SkewPolicy, first_rows
from hostguard.schemas import EVENT_SCHEMA

LINE_ORDER = ["file_path", "block_start", "line_id"]


def read_lines(spark: SparkSession, path: str, pattern: str = "*.log") -> DataFrame:
    """Lines of every file below a directory whose name fits ``pattern``.

    (line, file_path, block_start, line_id): the last three, in this order, are the line order of a read.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return _with_position(reader.text(path))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one file, whatever its name; bytes that are no text show as replacement characters."""
    return _with_position(spark.read.text(path), keep_marks=True)


def _readable(value: Column) -> Column:
    """Text without the bytes that could not be decoded."""
    return F.when(F.is_valid_utf8(value), value).otherwise(
        F.replace(F.make_valid_utf8(value), F.lit("\ufffd"), F.lit(""))
    )


def _with_position(rows: DataFrame, keep_marks: bool = False) -> DataFrame:
    value = F.col("value")
    return rows.select(
        (F.make_valid_utf8(value) if keep_marks else _readable(value)).alias("line"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_id"),
    )


def stream_lines(
    spark: SparkSession, path: str, files_per_trigger: int | None = None, pattern: str = "*.log"
) -> DataFrame:
    """New files below a directory as they land. Files must be complete: rolled, not appended to."""
    reader = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.text(path)
    return rows.select(_readable(F.col("value")).alias("line"), F.col("_metadata.file_path").alias("file_path"))


def last_lines(
    df: DataFrame, limit: int, order: list[str], as_of: Column, column: str = "line", policy: SkewPolicy = SkewPolicy()
) -> DataFrame:
    """The last ``limit`` raw lines without the blank ones, as log-line events."""
    last = first_rows(df, [F.desc(c) for c in order], limit, policy)
    rows = last.withColumn("message", stripped(F.col(column))).filter(F.col("message") != "")
    return rows.select(
        *order, F.lit("log_line").alias("type"), "message", as_of.cast("double").alias("timestamp")
    ).orderBy(*order)


def collect_events(spark: SparkSession, path: str, limit: int, as_of: Column) -> DataFrame:
    """``last_lines`` of one file; a missing file has none."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    if not found:
        return spark.createDataFrame([], "type string, message string, timestamp double")
    lines = read_file(spark, path)
    return last_lines(lines, limit, LINE_ORDER, as_of).select("type", "message", "timestamp")


def lines_of(df: DataFrame, column: str, source: str = "virtual") -> DataFrame:
    """Any DataFrame as a line source."""
    others = [c for c in df.columns if c not in (column, "line", "source")]
    return df.select(*others, F.col(column).alias("line"), F.lit(source).alias("source"))


def read_event_buffer(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Saved events; ``array`` for a file that holds one JSON array instead of a record per line."""
    return spark.read.schema(EVENT_SCHEMA).option("multiLine", array).json(path)


def read_event_records(spark: SparkSession, path: str) -> DataFrame:
    """Saved events, a record per line, whatever keys they have: unknown ones go into ``data``.

    A line that is no JSON object is a row with its text in ``json`` and an ``error``, as is one whose numbers cannot be
    read (its other fields stay); blank lines are skipped.
    """
    rows = spark.read.text(path).select(F.col("value").alias("json")).filter(stripped(F.col("json")) != "")
    fields = event_fields(rows)
    number = {"timestamp": "double", "pid": "int", "severity": "int"}
    unread = [F.when(F.col(n).isNotNull() & F.col(n).try_cast(kind).isNull(), F.lit(n)) for n, kind in number.items()]
    wrong = F.concat_ws(", ", *unread)
    tags = F.coalesce(F.from_json("tags", "array<string>"), F.when(F.col("tags").isNotNull(), F.array("tags")))
    error = F.coalesce("error", F.when(wrong != "", F.concat(F.lit("unreadable numbers: "), wrong)))
    readable = F.when(F.col("error").isNull(), F.col("data"))
    found = fields.withColumns({"error": error, "data": readable, **{n: F.col(n).try_cast(kind) for n, kind in number.items()}, "tags": tags})
    return found.select(*[field.name for field in EVENT_SCHEMA], "error", F.when(F.col("error").isNotNull(), F.col("json")).alias("json"))


def save_event_buffer(df: DataFrame, path: str) -> None:
    df.select(*[field.name for field in EVENT_SCHEMA]).write.mode("overwrite").json(path)


def write_alert_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rule alerts (rule, ts_us, message), or alert rows as ``generate_alerts`` makes them, as text lines."""
    line = rule_alert_line(df) if "ts_us" in df.columns else alert_row_line(df)
    df.select(line.alias("value")).write.mode(mode).text(path)


def alert_row_line(df: DataFrame) -> Column:
    """The line of an alert row: its own event type, severity and time; what else the row has is the metadata."""
    others = [c for c in df.columns if c not in ("timestamp", "event_type", "severity", "description", "error")]
    metadata = F.to_json(F.struct(*others)) if others else F.lit("")
    seconds = F.unix_micros(F.to_timestamp("timestamp")) / 1_000_000
    return alert_line(F.col("description"), F.col("event_type"), F.col("severity"), metadata, seconds)


def rule_alert_line(df: DataFrame) -> Column:
    """The line of a detector alert: event type SECURITY, severity WARNING, no metadata."""
    return alert_line(F.col("message"), F.lit("SECURITY"), F.lit("WARNING"), seconds=F.col("ts_us") / 1_000_000)
