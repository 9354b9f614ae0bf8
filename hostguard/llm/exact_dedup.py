"""Exact duplicates by a persistent digest index.

The index is a table bucketed and sorted by digest. A batch of rows is reduced to one row per digest, texts that
the index already has are left out by a sort-merge anti-join, and the rest is appended. Texts never move: only
(digest, doc_id, row) is shuffled, after a partial aggregate, so copies of one text cost one row per task.

Edge cases: a null text counts as empty; empty texts equal each other. Of rows that share digest and doc_id one
stays. Null ids lose against any other. An empty table gives an empty result. Other input columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostguard.llm.common import lower_ascii
from hostguard.session import Scratch

BUCKETS = 64

# A text with more rows than this, and than a thousandth of all, goes round the shuffle: at most 1000 texts do.
HOT_ROWS = 10_000


class DigestIndex:
    """A table (digest, keep_id, keep_row, batch) in ``path``; reopening the path continues the same index.

    Every append adds one file per bucket. ``name`` is the table's name in the session catalogue.
    """

    def __init__(self, spark: SparkSession, path: str, name: str | None = None, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, keep_row BIGINT, batch INT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def next_batch(self) -> int:
        return (self.rows().agg(F.max("batch")).first()[0] or 0) + 1

    def append_new(self, batch: DataFrame, number: int) -> None:
        """Add the texts of ``batch`` (digest, doc_id, row) that the index lacks; the largest doc_id stands for each.

        Row numbers mean something only within the batch ``number``.
        """
        best = F.max(F.struct("doc_id", "row")).alias("best")
        texts = batch.groupBy("digest").agg(best)
        new = texts.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        new = new.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.lit(number).alias("batch"))
        new.repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """Forget the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8 after lower-casing A-Z, 32 bytes."""
    return F.unhex(F.sha2(lower_ascii(text).cast("binary"), 256))


def digest_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, digest); ``row`` numbers the rows and holds still once the result is written."""
    ids = F.col("doc_id").cast("bigint").alias("doc_id")
    return docs.select(F.monotonically_increasing_id().alias("row"), ids, digest(F.col("text")).alias("digest"))


def judge(rows: DataFrame, index: DataFrame, number: int) -> DataFrame:
    """Every row of batch ``number`` with keep_id, group_size and kept.

    Texts with very many copies are few and are joined by broadcast; the others by a shuffle on the digest.
    """
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = sizes.join(index, "digest")
    hot_from = max(HOT_ROWS, rows.count() // 1000)
    hot = groups.filter(F.col("group_size") > hot_from)
    hot_digests = F.broadcast(hot.select("digest"))
    common = rows.join(hot_digests, "digest", "left_anti").join(groups.filter(F.col("group_size") <= hot_from), "digest")
    found = common.unionByName(rows.join(F.broadcast(hot), "digest"))
    return found.withColumn("kept", (F.col("row") == F.col("keep_row")) & (F.col("batch") == number)).drop("batch")


def deduplicate(docs: DataFrame, scratch: Scratch, index: DigestIndex, arrivals: int = 2) -> DataFrame:
    """Judge ``docs`` against ``index`` and add them to it, in ``arrivals`` batches of falling doc_id.

    Returns (row, doc_id, digest, keep_id, keep_row, group_size, kept), with group_size counted over ``docs``.
    A text already in the index keeps the row that it had there.
    """
    rows = scratch.keep(digest_rows(docs))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / arrivals for i in range(1, arrivals)], 1000)).first()[0] or []
    upper, number = F.lit(False), index.next_batch()
    for cut in [*sorted(set(cuts), reverse=True), None]:
        above = F.col("doc_id") > cut if cut is not None else F.lit(True)
        index.append_new(rows.filter(F.coalesce(above, F.lit(False)) & ~F.coalesce(upper, F.lit(False))), number)
        upper = above
    return judge(rows, index.rows(), number)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One pass with an index of its own; the columns of ``deduplicate``, written out."""
    scratch = Scratch(docs.sparkSession)
    index = DigestIndex(docs.sparkSession, scratch.folder())
    found = scratch.keep(deduplicate(docs, scratch, index))
    index.close()
    scratch.drop_folder(index.path)
    return found
