"""Keyed state kept as a base and the changes since, and recovery from a change log by a high-water mark.

A micro-batch writes what it changed, not the state: the last write of each key it holds, under the batch id. Reading
takes the newest base and the changes after it through one grouped maximum, later batches first. Every ``compact_every``
batches the two become a new base; changes and bases that the base before does not need are removed, so a batch that is
repeated finds what it needs and overwrites its own files.

Rows are the state's columns with ``seq`` (order within equal times), and ``deleted`` where a key is to go (absent or null:
no). A null key is a key. Empty batches write an empty change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostguard.operators.state import last_write, replay, verified

ORDER = ["_batch", "last_updated", "seq"]


def _files(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def whole_parts(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Numbers of the finished folders ``<kind>=<number>``, ascending."""
    path, files = _files(spark, folder)
    if not files.exists(path):
        return []
    names = [status.getPath().getName() for status in files.listStatus(path)]
    done = [n for n in names if n.startswith(f"{kind}=") and files.exists(_files(spark, f"{folder}/{n}/_SUCCESS")[0])]
    return sorted(int(n.partition("=")[2]) for n in done)


def remove(spark: SparkSession, path: str) -> None:
    jvm_path, files = _files(spark, path)
    files.delete(jvm_path, True)


class DeltaState:
    """A ``foreachBatch`` sink; ``empty`` has the state's columns, ``keys`` among them and ``last_updated``."""

    def __init__(self, folder: str, empty: DataFrame, keys: list[str] = ["ip"], compact_every: int = 16) -> None:
        self.folder, self.keys, self.compact_every = folder.rstrip("/"), keys, compact_every
        self.columns = empty.columns
        self.schema = empty.select("*", F.lit(0).cast("bigint").alias("seq"), F.lit(False).alias("deleted")).schema

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in batch.columns else F.lit(False)
        rows = batch.select(*self.columns, F.col("seq").cast("bigint").alias("seq"), deleted.alias("deleted"))
        last_write(rows, self.keys, ORDER[1:]).write.mode("overwrite").parquet(f"{self.folder}/change={batch_id}")
        if (batch_id + 1) % self.compact_every == 0:
            self.compact(batch.sparkSession, batch_id)

    def _newest(self, spark: SparkSession, up_to: int | None) -> DataFrame:
        """Base and later changes with the last row of every key, the deleted ones too."""
        limit = up_to if up_to is not None else 2**62
        base = max((n for n in whole_parts(spark, self.folder, "base") if n < limit), default=None)
        changes = [n for n in whole_parts(spark, self.folder, "change") if n <= limit and (base is None or n > base)]
        rows = spark.createDataFrame([], self.schema).withColumn("_batch", F.lit(-1).cast("bigint"))
        if base is not None:
            rows = spark.read.schema(self.schema).parquet(f"{self.folder}/base={base}").withColumn("_batch", F.lit(-1).cast("bigint"))
        if changes:
            paths = [f"{self.folder}/change={n}" for n in changes]
            number = F.regexp_extract(F.col("_metadata.file_path"), r"/change=(\d+)/", 1).cast("bigint")
            rows = rows.unionByName(spark.read.schema(self.schema).parquet(*paths).withColumn("_batch", number))
        return last_write(rows, self.keys, ORDER)

    def state(self, spark: SparkSession, up_to: int | None = None) -> DataFrame:
        """The state after all batches, or after batch ``up_to``."""
        return self._newest(spark, up_to).filter("NOT deleted").select(*self.columns)

    def compact(self, spark: SparkSession, batch_id: int) -> None:
        """Make the state after ``batch_id`` the new base. It reads the base before and the changes since."""
        earlier = [n for n in whole_parts(spark, self.folder, "base") if n < batch_id]
        kept = self._newest(spark, batch_id).filter("NOT deleted").drop("_batch")
        kept.write.mode("overwrite").parquet(f"{self.folder}/base={batch_id}")
        if earlier:
            for old in earlier[:-1]:
                remove(spark, f"{self.folder}/base={old}")
            for old in whole_parts(spark, self.folder, "change"):
                if old <= earlier[-1]:
                    remove(spark, f"{self.folder}/change={old}")


class Recovery:
    """States and histories with the id up to which the change log is in them.

    ``advance`` reads only entries after that mark (the filter reaches the log's scan), so what is before it may be cut
    off. Corrupt entries are skipped, counted, and passed by the mark. Log ids grow; an entry that arrives with an id at or
    below the mark is not read.
    """

    def __init__(self, folder: str, states: DataFrame, histories: DataFrame) -> None:
        self.folder, self.start = folder.rstrip("/"), (states, histories)

    def _version(self, spark: SparkSession) -> int | None:
        return max(whole_parts(spark, f"{self.folder}/mark", "version"), default=None)

    def mark(self, spark: SparkSession) -> tuple[int | None, int]:
        """(last id taken, corrupt entries skipped)."""
        version = self._version(spark)
        if version is None:
            return None, 0
        return tuple(spark.read.parquet(f"{self.folder}/mark/version={version}").select("mark", "corrupt").first())

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        version = self._version(spark)
        if version is None:
            return self.start
        return tuple(
            spark.read.schema(start.schema).parquet(f"{self.folder}/{name}/version={version}")
            for name, start in zip(("states", "histories"), self.start)
        )

    def unread(self, log: DataFrame) -> DataFrame:
        mark, _ = self.mark(log.sparkSession)
        return log if mark is None else log.filter(F.col("id") > mark)

    def advance(self, log: DataFrame) -> None:
        """Take the entries after the mark as the next version; the version before stays, older ones go."""
        spark = log.sparkSession
        version, (mark, corrupt) = self._version(spark), self.mark(spark)
        entries = self.unread(log)
        facts = verified(entries).agg(F.max("id").alias("mark"), F.count_if(~F.col("intact")).alias("corrupt")).first()
        if facts.mark is None:
            return
        # Entries that land in the log meanwhile are left for the next time.
        entries, number = entries.filter(F.col("id") <= facts.mark), 0 if version is None else version + 1
        for name, table in zip(("states", "histories"), replay(*self.tables(spark), entries)):
            table.write.mode("overwrite").parquet(f"{self.folder}/{name}/version={number}")
        counted = spark.createDataFrame([(facts.mark, corrupt + facts.corrupt)], "mark bigint, corrupt bigint")
        counted.write.mode("overwrite").parquet(f"{self.folder}/mark/version={number}")
        for name in ("states", "histories", "mark"):
            for old in whole_parts(spark, f"{self.folder}/{name}", "version"):
                if old < number - 1:
                    remove(spark, f"{self.folder}/{name}/version={old}")
