"""Current state of alerts from their ordered actions."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostguard.operators.alerts import MAX_METADATA_KEYS, cut_value, with_identity

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def apply_actions(
    alerts: DataFrame, actions: DataFrame, max_keys: int = MAX_METADATA_KEYS
) -> tuple[DataFrame, DataFrame]:
    """(alerts after their actions, refused actions).

    ``actions`` is (alert_id, seq, action, key, value, ts) with action one of acknowledge, resolve,
    set_metadata, remove_metadata. An alert can be resolved only after it was acknowledged. Flags, times and
    the version are grouped maxima and counts, combined before the shuffle.
    """
    ack, resolve = F.col("action") == "acknowledge", F.col("action") == "resolve"
    folded = actions.groupBy("alert_id").agg(
        F.min(F.when(ack, F.col("seq"))).alias("_ack_seq"),
        F.max(F.when(ack, F.struct("seq", "ts"))).alias("_ack"),
        F.max(F.when(resolve, F.struct("seq", "ts"))).alias("_resolve"),
        F.count_if(F.col("action").isin("set_metadata", "remove_metadata")).alias("_changes"),
    )
    rows = alerts.join(folded, alerts["id"] == folded["alert_id"], "left").drop("alert_id")
    metadata = final_metadata(alerts, actions, max_keys)
    rows = rows.drop("metadata").join(metadata, rows["id"] == metadata["alert_id"], "left").drop("alert_id")
    resolved = F.col("_resolve.seq").isNotNull() & (
        F.col("acknowledged") | (F.col("_resolve.seq") > F.col("_ack_seq"))
    )
    current = rows.withColumns(
        {
            "acknowledged_at": F.coalesce("_ack.ts", "acknowledged_at"),
            "acknowledged": F.col("acknowledged") | F.col("_ack").isNotNull(),
            "resolved_at": F.when(resolved, F.col("_resolve.ts")).otherwise(F.col("resolved_at")),
            "resolved": F.col("resolved") | F.coalesce(resolved, F.lit(False)),
            "metadata": F.coalesce("metadata", F.expr("map_from_entries(CAST(array() AS array<struct<k:string,v:string>>))")),
            "version": (F.col("version") + F.coalesce("_changes", F.lit(0))).cast("int"),
        }
    ).drop("_ack_seq", "_ack", "_resolve", "_changes")
    starts = alerts.select(F.col("id").alias("alert_id"), F.col("acknowledged").alias("_was_acknowledged"))
    judged = (
        actions.filter(resolve)
        .join(folded.select("alert_id", "_ack_seq"), "alert_id", "left")
        .join(starts, "alert_id", "left")
    )
    early = ~F.coalesce("_was_acknowledged", F.lit(False)) & (
        F.col("_ack_seq").isNull() | (F.col("seq") < F.col("_ack_seq"))
    )
    refused = judged.filter(early).drop("_ack_seq", "_was_acknowledged")
    message = F.lit("resolved before it was acknowledged")
    return with_identity(current), refused.withColumn("error", message)


def final_metadata(alerts: DataFrame, actions: DataFrame, max_keys: int) -> DataFrame:
    """(alert_id, metadata) after all changes.

    An alert that never saw more than ``max_keys`` keys ends with the last value of each key. Only beyond that
    does the order matter: a new key that finds the map full is dropped. Those alerts are followed in order,
    one streaming pass that holds at most ``max_keys`` entries.
    """
    given = alerts.select(F.col("id").alias("alert_id"), F.posexplode("metadata").alias("_at", "key", "value"))
    changes = given.selectExpr("alert_id", "0 AS _phase", "CAST(_at AS BIGINT) AS seq", "key", "value").unionByName(
        actions.filter(F.col("action").isin("set_metadata", "remove_metadata")).select(
            "alert_id", F.lit(1).alias("_phase"), F.col("seq").cast("bigint").alias("seq"), "key",
            F.when(F.col("action") == "set_metadata", cut_value(F.col("value"))).alias("value"),
        )
    )
    last = changes.groupBy("alert_id", "key").agg(
        F.max(F.struct("_phase", "seq", "value")).alias("_last"),
        F.count("value").alias("_sets"),
    )
    sizes = last.groupBy("alert_id").agg(F.count_if(F.col("_sets") > 0).alias("_keys"))
    roomy = last.join(sizes.filter(F.col("_keys") <= max_keys), "alert_id").filter(F.col("_last.value").isNotNull())
    entries = F.sort_array(F.collect_list(F.struct(F.col("key"), F.col("_last.value").alias("value"))))
    simple = roomy.groupBy("alert_id").agg(F.map_from_entries(entries).alias("metadata"))
    crowded = changes.join(sizes.filter(F.col("_keys") > max_keys), "alert_id")
    # Partitioned by a column of its own, which no earlier step can be taken to have laid out already.
    crowded = crowded.withColumn("_slot", F.xxhash64("alert_id")).repartition("_slot")
    crowded = crowded.sortWithinPartitions("_slot", "alert_id", "_phase", "seq")

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, {}
        for batch in batches:
            done = []
            for alert_id, key, value in zip(batch["alert_id"], batch["key"], batch["value"]):
                if alert_id != current:
                    if current is not None:
                        done.append((current, kept))
                    current, kept = alert_id, {}
                if value is None:
                    kept.pop(key, None)
                elif key in kept or len(kept) < max_keys:
                    kept[key] = value
            yield pd.DataFrame(done, columns=["alert_id", "metadata"])
        if current is not None:
            yield pd.DataFrame([(current, kept)], columns=["alert_id", "metadata"])

    schema = f"alert_id {alerts.schema['id'].dataType.simpleString()}, metadata map<string,string>"
    return simple.unionByName(crowded.mapInPandas(follow, schema))
