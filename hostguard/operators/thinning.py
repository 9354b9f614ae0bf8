"""Greedy thinning of timed rows per key: a row is kept if enough time has passed since the last kept row.

This is the alert cooldown and the repeated-line filter. Which rows are kept depends on all earlier ones, so
a key is followed in time order. Ordinary keys are hash-partitioned, sorted, and followed in one streaming
pass that holds only the last kept time. In hot keys each moment points to the next one that could be kept, and
pointers are doubled by joins, so no task ever follows a hot key or a stretch of it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostguard.operators.skew import Running, Scan, SkewPolicy, keyed_scan, split_heavy
from hostguard.session import Scratch, materialize

# Task functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def thin(
    df: DataFrame,
    keys: list[str],
    gap_us: int,
    policy: SkewPolicy = SkewPolicy(),
    hot_flag: str | None = None,
) -> DataFrame:
    """Rows of ``df`` (with ``ts_us`` and a unique ``seq``) kept by the rule ``ts_us - last kept >= gap_us``.

    ``hot_flag`` names the boolean column that already marks rows of hot keys; a missing column says that no
    key is hot. Without ``hot_flag`` the keys are counted.
    """
    if gap_us <= 0:
        return df.drop(hot_flag) if hot_flag else df
    if hot_flag and hot_flag not in df.columns:
        ordinary, hot = df, None
    elif hot_flag:
        is_hot = F.coalesce(F.col(hot_flag), F.lit(False))
        ordinary, hot = df.filter(~is_hot).drop(hot_flag), df.filter(is_hot).drop(hot_flag)
    else:
        ordinary, hot = split_heavy(df, keys, policy)
    kept = _follow(ordinary, keys, gap_us)
    if hot is None:
        return kept
    return kept.unionByName(_follow_hot(hot, keys, gap_us, policy))


def suppress_repeats(
    df: DataFrame, keys: list[str], ttl_s: float = 2.0, policy: SkewPolicy = SkewPolicy()
) -> DataFrame:
    """Drop a row if the same key was let through at most ``ttl_s`` seconds ago; dropped rows do not count."""
    return thin(df, keys, round(ttl_s * 1_000_000) + 1, policy)


def _follow(df: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """One pass over rows partitioned by key and sorted by (key, ts_us, seq)."""
    # Partitioned by a column of its own: Spark drops a repartition by columns it takes to be laid out already,
    # and a Python stage does not make adaptive execution keep such a layout.
    columns = df.columns
    tagged = df.withColumn("_key_id", F.xxhash64(*keys))
    laid = tagged.repartition("_key_id").sortWithinPartitions("_key_id", *keys, "ts_us", "seq")
    key_names = ["_key_id", *keys]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_kept = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch.select(key_names)
            ts = batch.column("ts_us").to_numpy(zero_copy_only=False)
            starts = _key_starts(table)
            ends = np.append(starts[1:], batch.num_rows)
            picked: list[int] = []
            for start, end in zip(starts.tolist(), ends.tolist()):
                key = tuple(table.slice(start, 1).to_pylist()[0].values())
                at = start
                if key == last_key:
                    at = start + int(np.searchsorted(ts[start:end], last_kept + gap_us))
                while at < end:
                    picked.append(at)
                    last_kept = int(ts[at])
                    at += int(np.searchsorted(ts[at:end], last_kept + gap_us))
                last_key = key
            yield batch.take(pa.array(picked, pa.int64())).select(columns)

    return laid.mapInArrow(follow, df.schema)


def _key_starts(table: pa.RecordBatch) -> np.ndarray:
    """Positions in the batch where the key differs from the row before."""
    changed = np.zeros(table.num_rows, bool)
    changed[0] = True
    for column in table.columns:
        filled = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        changed[1:] |= filled[1:] != filled[:-1]
    return np.flatnonzero(changed)


def _follow_hot(df: DataFrame, keys: list[str], gap_us: int, policy: SkewPolicy) -> DataFrame:
    """Each hot key gets a number; only numbers and times go through the levels."""
    df = materialize(df)
    numbered = materialize(df.select(*keys).distinct().withColumn("_key", F.monotonically_increasing_id()))
    named = numbered.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    if named.count() <= policy.broadcast_keys:
        named = F.broadcast(named)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    df = df.join(named, same).select(*df.columns, "_key")
    kept = kept_times(df.select("_key", "ts_us"), gap_us)
    # Of several rows at a kept moment the first by seq is kept.
    first = df.select("_key", "ts_us", "seq").join(kept, ["_key", "ts_us"], "left_semi")
    first = first.groupBy("_key", "ts_us").agg(F.min("seq").alias("seq"))
    return df.join(first, ["_key", "ts_us", "seq"], "left_semi").drop("_key")


def kept_times(moments: DataFrame, gap_us: int, policy: SkewPolicy = SkewPolicy(hot_rows=0)) -> DataFrame:
    """(_key, ts_us) of the kept moments, for keys of any size.

    Each moment points to the first one that is at least a gap later, found in one scan over ranges. Pointers are
    doubled by equi-joins on (key, moment) until they leave the key, in as many rounds as the logarithm of the number
    of kept moments; then, from the widest pointer to the narrowest, what the first moment of a key reaches is
    gathered. A join key is one moment, so no group is larger than a row.
    """
    scratch = Scratch(moments.sparkSession)
    moments = scratch.keep(moments.distinct())
    events = moments.selectExpr(
        "_key", f"inline(array(named_struct('at', ts_us, 'is_moment', 1, 'ts_us', ts_us),"
        f" named_struct('at', ts_us + {gap_us}L, 'is_moment', 0, 'ts_us', ts_us)))"
    )

    def following(scan: Scan) -> DataFrame:
        # From the latest on, the last moment seen is the earliest that is not before the row.
        seen = Running("max", F.expr("CASE WHEN is_moment = 1 THEN -at END"))
        return scan.running(_seen=seen).filter(F.col("is_moment") == 0).df.select("_key", "ts_us", (-F.col("_seen")).alias("next"))

    order = [F.desc("at"), F.desc("is_moment"), F.desc("ts_us")]
    pointers = [scratch.keep(keyed_scan(events, ["_key"], order, following, policy).filter("next IS NOT NULL"))]
    while not pointers[-1].isEmpty():
        last = pointers[-1]
        onward = last.select("_key", F.col("ts_us").alias("next"), F.col("next").alias("further"))
        pointers.append(scratch.keep(last.join(onward, ["_key", "next"]).select("_key", "ts_us", F.col("further").alias("next"))))
    reached = scratch.keep(moments.groupBy("_key").agg(F.min("ts_us").alias("ts_us")))
    for pointer in reversed(pointers[:-1]):
        new = reached.join(pointer, ["_key", "ts_us"]).select("_key", F.col("next").alias("ts_us"))
        wider = scratch.keep(reached.unionByName(new))
        scratch.drop(reached)
        reached = wider
    scratch.drop(moments, *pointers)
    return reached
