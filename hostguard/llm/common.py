"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostguard.llm.textarrays import drop_powers

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A word is a longest run of bytes other than the space and 09 to 0D.
GAP = r"[\x20\x09-\x0D]+"

# Rows of (key, few numbers) that may be sent to every executor: some 10 MB.
BROADCAST_ROWS = 200_000


_SHIPPED: set[str] = set()


def ship_code(df: DataFrame) -> None:
    """Send this package's source to the executors, once per application, so that it need not be installed there."""
    context = df.sparkSession.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix=f"{package.name}-code-"), f"{package.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as file:
        for source in sorted(package.rglob("*.py")):
            file.write(source, source.relative_to(package.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def in_tasks(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with a function of this package."""
    ship_code(df)
    return df.mapInArrow(run, schema)


def released(run):
    """``run`` that gives its memory back at the end of a task: Python workers are reused by later stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    drop_powers()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lean_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Documents go to Python a thousand at a time, unless the session has a size of its own."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, str(rows))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; null counts as empty. All-ASCII text takes the fast path of ``lower``."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(column: str, folds: int) -> Column:
    """crc32 of a column as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds, F.lit(0).cast("bigint"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows it is below ``rows``, else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def few_parts(rows: int, each: int = 50_000) -> int:
    """How many files a narrow table of so many rows is kept in: it grows with the rows."""
    return 1 + rows // each


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """``df``, known to have at most so many rows, in one partition if that is few: nothing on top of it is shuffled."""
    return df.coalesce(1) if few_parts(rows) == 1 else df


def beside(left: DataFrame, right: DataFrame, on: str | list[str], how: str, rows: int) -> DataFrame:
    """Narrow tables of at most ``rows`` rows, joined where they lie if these are few, else ``right`` is ``small``.

    Many small joins one after the other cost the driver a broadcast, its thread and a task per shuffle partition each.
    """
    if few_parts(rows) == 1:
        return narrow(left, rows).join(narrow(right, rows).hint("merge"), on, how)
    return left.join(small(right), on, how)


def text_key(docs: DataFrame) -> Column:
    """Tells rows apart that share a doc_id."""
    return F.xxhash64(docs["text"])


def without_rows(docs: DataFrame, listed: DataFrame, key: Column | None = None) -> DataFrame:
    """``docs`` without the rows in ``listed``: by doc_id, null equal to null, and by ``key`` equal to its text_key.

    The texts stay where they are while the list is small by count; beyond that both sides are shuffled.
    """
    names = {c: f"_listed_{c}" for c in listed.columns}
    listed = small(listed.distinct().withColumnsRenamed(names))
    same = docs["doc_id"].eqNullSafe(listed["_listed_doc_id"])
    if key is not None:
        same = same & (key == listed["_listed_text_key"])
    return docs.join(listed, same, "left_anti")


def batches_of_rows(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Each batch cut so that column ``text`` holds about ``limit`` bytes per piece; a longer row is a piece alone."""
    for batch in batches:
        lengths = batch.column(text).cast(pa.large_binary()) if batch.num_rows else None
        if lengths is None:
            continue
        start, size = 0, 0
        for i, value in enumerate(pc.binary_length(lengths).to_pylist()):
            if size and size + (value or 0) > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += value or 0
        yield batch.slice(start)
