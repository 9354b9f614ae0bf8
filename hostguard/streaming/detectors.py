"""Streaming forms of the rules, the repeat filter and outlier scoring.

Attempts are (ts timestamp, seq, ip). Streams need the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``); ``use_rocksdb`` sets it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostguard.config import DetectionConfig
from hostguard.functions.ip import subnet_of
from hostguard.operators.baseline import OUTLIER_SIGMAS, score_outliers
from hostguard.operators.rules import RULE_COLUMNS, address_rules, global_rule, subnet_rule
from hostguard.operators.windows import with_threshold
from hostguard.streaming.processors import AddressDetector, CountingDetector, RepeatFilter

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


COUNTED = "seq bigint, ts_us bigint, counted bigint, label string"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _timed(stream: DataFrame, delay: str) -> DataFrame:
    rows = stream.withWatermark("ts", delay)
    return rows.withColumns({"ts_us": F.unix_micros("ts"), "weight": F.lit(1).cast("bigint")})


def address_alerts(stream: DataFrame, cfg: DetectionConfig = DetectionConfig(), delay: str = "10 seconds") -> DataFrame:
    """Baseline, burst, risk and escalation alerts. State is kept per address and spread by address."""
    found = (
        _timed(stream, delay)
        .select("ts", "ip", "ts_us", "seq", "weight")
        .groupBy("ip")
        .transformWithStateInPandas(AddressDetector(cfg), AddressDetector.output_schema, "Append", "EventTime")
    )
    found = with_threshold(found.withColumn("history_squares", F.col("history_squares").cast("decimal(38,0)")), cfg,
                           "failed_count")
    found = found.selectExpr("*", f"score_units / {cfg.units_per_point}L AS score")
    described = " ".join(f"WHEN rule_order = {r.order} THEN {r.struct}" for r in address_rules(cfg))
    described = found.selectExpr("seq", "ts_us", "ip", f"inline(array(CASE {described} END))")
    return described.select(*RULE_COLUMNS)


def subnet_alerts(stream: DataFrame, cfg: DetectionConfig = DetectionConfig(), delay: str = "10 seconds") -> DataFrame:
    rows = _timed(stream, delay).withColumn("subnet", subnet_of(F.col("ip"), cfg.subnet_prefixlen))
    detector = CountingDetector("subnet", cfg.us("subnet_window"), cfg.subnet_threshold, cfg.us("alert_cooldown"))
    found = (
        rows.filter(F.col("subnet").isNotNull())
        .select("ts", "subnet", "ts_us", "seq", "weight", F.col("ip").alias("label"))
        .groupBy("subnet")
        .transformWithStateInPandas(detector, f"subnet string, {COUNTED}", "Append", "EventTime")
    )
    found = found.withColumns({"subnet_count": F.col("counted"), "ip": F.col("label")})
    described = found.selectExpr("seq", "ts_us", "ip", f"inline(array({subnet_rule(cfg).struct}))")
    return described.select(*RULE_COLUMNS)


def global_alerts(stream: DataFrame, cfg: DetectionConfig = DetectionConfig(), delay: str = "10 seconds") -> DataFrame:
    """Alerts over all addresses, at a resolution of one second.

    Attempts are first counted per second, in parallel; the single key then sees one row per second, however
    many attempts there are.
    """
    per_second = (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 second"))
        .agg(F.count(F.lit(1)).alias("weight"), F.max("seq").alias("seq"))
        .select(F.window_time("window").alias("ts"), "weight", "seq")
    )
    rows = per_second.withColumns(
        {"key": F.lit("global_bruteforce"), "ts_us": F.unix_micros(F.date_trunc("second", "ts"))}
    )
    detector = CountingDetector("key", cfg.us("global_time_window"), cfg.global_threshold, cfg.us("alert_cooldown"))
    found = rows.select("ts", "key", "ts_us", "seq", "weight").groupBy("key").transformWithStateInPandas(
        detector, f"key string, {COUNTED}", "Append", "EventTime"
    )
    found = found.withColumns({"global_count": F.col("counted"), "ip": F.lit(None).cast("string")})
    described = found.selectExpr("seq", "ts_us", "ip", f"inline(array({global_rule(cfg).struct}))")
    return described.select(*RULE_COLUMNS)


def suppress_repeats(
    stream: DataFrame, keys: list[str], ttl_s: float = 2.0, delay: str = "10 seconds", buckets: int = 512
) -> DataFrame:
    """(keys, seq, ts_us) of rows whose key was not let through in the last ``ttl_s`` seconds.

    The keys are of types that text tells apart (text, whole numbers, decimals, dates, booleans).
    """
    # Keys are handled by the bucket, as text: a call into Python per key costs more than the rows of most keys.
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
    names = [f"key_{i}" for i in range(len(keys))]
    texts = [F.col(k).cast("string").alias(name) for k, name in zip(keys, names)]
    fields = ", ".join(["bucket int", *[f"{name} string" for name in names], "seq bigint, ts_us bigint"])
    found = (
        _timed(stream, delay)
        .select("ts", bucket, *texts, "ts_us", "seq")
        .groupBy("bucket")
        .transformWithStateInPandas(RepeatFilter("bucket", names, round(ttl_s * 1_000_000)), fields, "Append", "EventTime")
    )
    kinds = [stream.schema[k].dataType for k in keys]
    back = [F.col(name).cast(kind).alias(k) for k, name, kind in zip(keys, names, kinds)]
    return found.select(*back, "seq", "ts_us")


def approximate_repeats(stream: DataFrame, keys: list[str], ttl_s: float = 2.0) -> DataFrame:
    """The cheap form: at most one row per key within the watermark delay."""
    return stream.withWatermark("ts", f"{ttl_s} seconds").dropDuplicatesWithinWatermark(keys)


def score_stream(
    stream: DataFrame, profile: DataFrame, by: list[str] = [], column: str = "metric", sigmas: float = OUTLIER_SIGMAS
) -> DataFrame:
    """Outliers on a stream against a fixed profile: joined on its keys, or one row read at the start."""
    if by:
        return score_outliers(stream, profile, by, column, sigmas)
    row = profile.select("mean", "variance").first()
    if row is None:
        raise ValueError("the profile lacks a mean or a variance")
    fixed = {"mean": F.lit(row.mean), "variance": F.lit(row.variance)}
    return score_outliers(stream.withColumns(fixed), None, column=column, sigmas=sigmas)


def split_late(df: DataFrame, event_time: str, arrival_time: str, delay: str) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows) by arrival delay, for a side table of rows the watermark may drop."""
    late = F.col(arrival_time) > F.col(event_time) + F.expr(f"INTERVAL {delay}")
    return df.filter(~late), df.filter(late)
