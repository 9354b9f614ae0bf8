"""Scratch files that a job writes and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from hostguard.session import shared_folder


def scratch_path(df: DataFrame, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def data_files(df: DataFrame, path: str) -> int:
    """Files of a written table, without markers."""
    spark = df.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jvm_path)
    return sum(not status.getPath().getName().startswith(("_", ".")) for status in found)
