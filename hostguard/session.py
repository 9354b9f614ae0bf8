"""Session defaults and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "hostguard", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the submitter supplies the session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Recording the Python call site of every expression costs more than building it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names. A temporary one is made only for a local master."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="hostguard-"))
    return context.getCheckpointDir()


class Scratch:
    """Tables in the shared folder that belong to one job.

    Later stages read the written rows whatever executors are lost in between, and two reads of a table always
    agree, which a recomputed plan does not promise. ``drop`` frees a table once its successor is written; what
    is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def folder(self) -> str:
        """A new path in the shared folder, removed when the application ends."""
        path = f"{shared_folder(self.spark).rstrip('/')}/hostguard-{uuid.uuid4().hex}"
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
        return path

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back."""
        path = self.folder()
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            held = self._paths.pop(id(table), None)
            if held:
                self.drop_folder(held[1])

    def close(self) -> None:
        """Free every table that is left."""
        self.drop(*[table for table, _ in self._paths.values()])

    def drop_folder(self, path: str) -> None:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the table goes when the application ends."""
    return Scratch(df.sparkSession).keep(df)
