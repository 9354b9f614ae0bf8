"""Collector counters on a stream: one row per source and micro-batch, added up when they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostguard.operators.metrics import collector_counters

COUNTS = ["lines", "events", "discards", "parse_errors"]
SCHEMA = "source string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", last_event_time double"


class CounterSink:
    """A ``foreachBatch`` sink for lines; the columns are those of ``metrics.collector_counters``.

    A batch is counted under its id, so a repeated batch counts once. What is written grows with the sources of a batch,
    not with its lines. A null source is a source; an empty batch writes no row.
    """

    def __init__(self, folder: str, source: str, is_event: Column, is_error: Column, seconds: Column) -> None:
        self.folder, self.source = folder.rstrip("/"), source
        self.columns = is_event, is_error, seconds

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        counted = collector_counters(batch, self.source, *self.columns).withColumnRenamed(self.source, "source")
        counted.select("source", *COUNTS, F.col("last_event_time").cast("double")).coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/batch={batch_id}"
        )

    def batches(self, spark: SparkSession) -> DataFrame:
        """Counters per source and batch."""
        return spark.read.schema(f"{SCHEMA}, batch bigint").parquet(self.folder)

    def totals(self, spark: SparkSession) -> DataFrame:
        sums = [F.sum(c).alias(c) for c in COUNTS]
        return self.batches(spark).groupBy("source").agg(*sums, F.max("last_event_time").alias("last_event_time"))
