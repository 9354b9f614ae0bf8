"""Keyed state: last-write-wins snapshots and change-log replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostguard.functions.text import plain_number

# Operation codes of the change log.
INSERT_IP, DELETE_IP, INSERT_BASELINE, DELETE_BASELINE = 1, 2, 3, 4


def last_write(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key, as a grouped maximum that is combined before the shuffle."""
    values = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_row"))
    return newest.select(*keys, "_row.*").select(*df.columns)


def upsert(snapshot: DataFrame, updates: DataFrame, keys: list[str] = ["ip"], seq: str = "seq") -> DataFrame:
    """``snapshot`` with ``updates`` (same columns and ``seq``) written over it; updates shadow stored rows.

    Stored rows and updates go through one grouped maximum, so each is read and shuffled once.
    """
    stored = snapshot.withColumns({seq: F.lit(None).cast("bigint"), "_new": F.lit(0)})
    written = updates.select(*snapshot.columns, F.col(seq).cast("bigint").alias(seq), F.lit(1).alias("_new"))
    return last_write(stored.unionByName(written), keys, ["_new", "last_updated", seq]).select(*snapshot.columns)


def delete_keys(snapshot: DataFrame, deleted: DataFrame, keys: list[str] = ["ip"]) -> DataFrame:
    return snapshot.join(deleted.select(*keys).distinct(), keys, "left_anti")


def delete_everywhere(states: DataFrame, histories: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A live delete clears the key from both tables."""
    return delete_keys(states, deleted), delete_keys(histories, deleted)


def seconds_text(seconds: Column) -> Column:
    """Epoch seconds in the shortest decimal form, one digit after the point at least."""
    return plain_number(seconds.cast("string").cast("decimal(38,9)"))


def entry_checksum(op_type: Column, key: Column, value_json: Column, seconds: Column) -> Column:
    value = F.coalesce(F.when(value_json != "", value_json), F.lit("null"))
    return F.sha2(F.concat_ws(":", op_type.cast("string"), key, value, seconds_text(seconds)), 256)


def verified(log: DataFrame) -> DataFrame:
    """Add ``intact``: the stored checksum fits the entry."""
    expected = entry_checksum(F.col("op_type"), F.col("key"), F.col("value_json"), F.col("timestamp"))
    return log.withColumn("intact", F.coalesce(expected == F.col("checksum"), F.lit(False)))


def corrupted_entries(log: DataFrame) -> DataFrame:
    return verified(log).agg(F.count_if(~F.col("intact")).alias("corrupted"), F.count(F.lit(1)).alias("entries"))


def _replay(base: DataFrame, log: DataFrame, insert: int, delete: int, value: str) -> DataFrame:
    """Only the last intact operation on a key matters: an insert leaves its value, a delete nothing.

    Stored rows count as inserts from before the log, so base and log meet in one grouped maximum.
    """
    before = base.selectExpr("ip", f"{insert} AS op_type", f"{value} AS value_json", "last_updated AS timestamp",
                             "CAST(NULL AS BIGINT) AS id")
    mine = log.filter(F.col("op_type").isin(insert, delete)).selectExpr(
        "key AS ip", "op_type", "coalesce(value_json, 'null') AS value_json", "timestamp", "id"
    )
    # A null id sorts before every operation of the log.
    last = before.unionByName(mine).groupBy("ip").agg(
        F.max(F.struct("id", "op_type", "value_json", "timestamp")).alias("_op")
    )
    rows = last.filter(F.col("_op.op_type") == insert)
    kept = rows.select("ip", F.col("_op.value_json").alias(value), F.col("_op.timestamp").alias("last_updated"))
    return kept.select(*base.columns)


def replay(states: DataFrame, histories: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after the log; each delete operation clears its own table only. Corrupt entries are skipped."""
    intact = verified(log).filter("intact").drop("intact")
    return (
        _replay(states, intact, INSERT_IP, DELETE_IP, "state_json"),
        _replay(histories, intact, INSERT_BASELINE, DELETE_BASELINE, "history_json"),
    )
