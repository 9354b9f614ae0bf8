"""Micro-batch sinks. Each writes under its batch id, so a repeated batch overwrites itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostguard.operators.events import split_valid
from hostguard.operators.state import upsert
from hostguard.sources.lines import write_alert_lines

Sink = Callable[[DataFrame, int], None]


def alert_line_sink(folder: str) -> Sink:
    """Rule alerts as text lines in ``folder/batch=<id>``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_alert_lines(batch, f"{folder}/batch={batch_id}", mode="overwrite")

    return write


def alert_table_sink(folder: str) -> Sink:
    """Rule alerts as parquet, partitioned by batch and day."""

    def write(batch: DataFrame, batch_id: int) -> None:
        day = F.to_date(F.timestamp_micros("ts_us"))
        batch.withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(f"{folder}/batch={batch_id}")

    return write


def snapshot_sink(folder: str, empty: DataFrame, keys: list[str] = ["ip"]) -> Sink:
    """Keyed state after each batch as ``folder/version=<id>``, made from the newest version before and the batch.

    The version before is kept, so that a repeated batch finds it; older ones are removed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = [v for v in _versions(batch, folder) if v < batch_id]
        before = empty
        if versions:
            before = spark.read.schema(empty.schema).parquet(f"{folder}/version={max(versions)}")
        upsert(before, batch, keys).write.mode("overwrite").parquet(f"{folder}/version={batch_id}")
        for old in sorted(versions)[:-1]:
            _files(batch, folder).delete(_path(batch, f"{folder}/version={old}"), True)

    return write


def _path(df: DataFrame, path: str):
    return df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)


def _files(df: DataFrame, folder: str):
    return _path(df, folder).getFileSystem(df.sparkSession._jsc.hadoopConfiguration())


def _versions(df: DataFrame, folder: str) -> list[int]:
    files = _files(df, folder)
    if not files.exists(_path(df, folder)):
        return []
    names = [status.getPath().getName() for status in files.listStatus(_path(df, folder))]
    finished = [n for n in names if files.exists(_path(df, f"{folder}/{n}/_SUCCESS"))]
    return [int(n.partition("=")[2]) for n in finished if n.startswith("version=")]


def quarantine_sink(good_folder: str, bad_folder: str, on_event: Sink | None = None, on_error: Sink | None = None) -> Sink:
    """Accepted and refused rows (by their ``error``) in two tables; hooks see the same two parts."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        good, bad = split_valid(batch)
        good.drop("error").write.mode("overwrite").parquet(f"{good_folder}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{bad_folder}/batch={batch_id}")
        if on_event:
            on_event(good, batch_id)
        if on_error:
            on_error(bad, batch_id)
        batch.unpersist()

    return write


def run_available(stream: DataFrame, sink: Sink, checkpoint: str, mode: str = "append") -> None:
    """Process what is there now and stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
