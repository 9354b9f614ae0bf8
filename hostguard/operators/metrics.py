"""Collector, queue and worker measures as grouped aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostguard.operators.skew import Running, Scan, SkewPolicy, keyed_scan
from hostguard.operators.windows import trailing_count

# Histogram bounds in seconds.
WAIT_BOUNDS = [0.001, 0.01, 0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0, 300.0]
DURATION_BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]

RATE_HISTORY = 1000
EWMA_ALPHA = 0.1


def collector_counters(
    df: DataFrame, source: str, is_event: Column, is_error: Column, seconds: Column
) -> DataFrame:
    """Lines, events, discards, parse errors and last event time per source."""
    kept = is_event & ~is_error
    return df.groupBy(source).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(kept).alias("events"),
        F.count_if(~kept & ~is_error).alias("discards"),
        F.count_if(is_error).alias("parse_errors"),
        F.max(F.when(kept, seconds)).alias("last_event_time"),
    )


def event_rate(df: DataFrame, source: str, ts_us: str = "ts_us", history: int = RATE_HISTORY) -> DataFrame:
    """Events per second over the last ``history`` events of each source.

    The row-number filter is also applied before the shuffle, so a hot source sends ``history`` rows per task.
    """
    recent = Window.partitionBy(source).orderBy(F.desc(ts_us))
    last = df.select(source, ts_us).withColumn("_rn", F.row_number().over(recent)).filter(F.col("_rn") <= history)
    span = (F.col("_last") - F.col("_first")) / F.lit(1_000_000)
    totals = last.groupBy(source).agg(
        F.count(F.lit(1)).alias("events"), F.min(ts_us).alias("_first"), F.max(ts_us).alias("_last")
    )
    rate = F.when((F.col("events") >= 2) & (span > 0), (F.col("events") - 1) / span).otherwise(F.lit(0.0))
    return totals.select(source, "events", rate.alias("rate"))


def rate_as_of(
    df: DataFrame, key: str, as_of_us: Column, window_s: float = 60, ts_us: str = "ts_us"
) -> DataFrame:
    """Events per second per key in the window that ends at ``as_of_us``."""
    recent = F.col(ts_us).between(as_of_us - round(window_s * 1_000_000), as_of_us)
    counted = F.count_if(recent)
    rate = counted / F.lit(float(window_s)) if window_s > 0 else F.lit(0.0)
    return df.groupBy(key).agg(counted.alias("events"), rate.alias("rate"))


def trailing_rate(
    df: DataFrame,
    keys: list[str],
    window_s: float = 60,
    policy: SkewPolicy = SkewPolicy(),
) -> DataFrame:
    """The same rate as of every event; ``df`` has ``ts_us`` and ``seq``. The far edge of the window counts."""
    counted = trailing_count(df, keys, round(window_s * 1_000_000) + 1, "events", policy)
    return counted.withColumn("rate", F.col("events") / F.lit(float(window_s)))


def bucket_bound(value: Column, bounds: list[float]) -> Column:
    """The first bound that is not below ``value``, null beyond the last one."""
    return reduce(lambda rest, b: F.when(value <= b, F.lit(b)).otherwise(rest), reversed(bounds), F.lit(None).cast("double"))


def latency_histogram(df: DataFrame, value: str, by: list[str] = [], bounds: list[float] = WAIT_BOUNDS) -> DataFrame:
    """Values per bucket; values above the last bound are in none."""
    bucketed = df.withColumn("bound", bucket_bound(F.col(value), bounds)).filter(F.col("bound").isNotNull())
    return bucketed.groupBy(*by, "bound").agg(F.count(F.lit(1)).alias("n"))


def latency_summary(
    df: DataFrame,
    value: str,
    by: list[str] = [],
    bounds: list[float] = WAIT_BOUNDS,
    percentiles: tuple[int, ...] = (50, 95, 99),
) -> DataFrame:
    """Count, average, maximum and bucket percentiles in one grouped pass.

    A percentile is the first bound at which the bucketed count reaches its share, and 0 if no value is in a
    bucket.
    """
    bound = bucket_bound(F.col(value), bounds)
    reached = {b: F.count_if(bound <= b) for b in bounds}
    totals = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("avg_wait"),
        F.max(value).alias("max_wait"),
        *[count.alias(f"_le_{i}") for i, count in enumerate(reached.values())],
    )
    bucketed = F.col(f"_le_{len(bounds) - 1}")

    def percentile(p: int) -> Column:
        # Buckets without values are not in the histogram and cannot be the answer.
        hits = []
        for i, b in enumerate(bounds):
            filled = F.col(f"_le_{i}") > (F.col(f"_le_{i - 1}") if i else F.lit(0))
            hits.append(F.when(filled & (F.col(f"_le_{i}") * 100 >= bucketed * p), F.lit(b)))
        return F.when(bucketed == 0, F.lit(0.0)).otherwise(F.coalesce(*hits, F.col("max_wait")))

    return totals.select(*by, "n", "avg_wait", "max_wait", *[percentile(p).alias(f"p{p}_wait") for p in percentiles])


def outcome_totals(success: Column, alerts: Column, seconds: Column) -> dict[str, Column]:
    """Totals of a worker's runs and the cumulative duration histogram ``le_<bound>``, as aggregates."""
    return {
        "total_processed": F.count(F.lit(1)),
        "success_count": F.count_if(success),
        "failure_count": F.count_if(~success),
        "alerts_generated": F.sum(alerts.cast("bigint")),
        **{f"le_{b:g}".replace(".", "_"): F.count_if(seconds <= b) for b in DURATION_BOUNDS},
    }


def outcome_rollup(df: DataFrame, by: list[str], success: Column, alerts: Column, seconds: Column) -> DataFrame:
    """``outcome_totals`` per worker."""
    return df.groupBy(*by).agg(*[total.alias(name) for name, total in outcome_totals(success, alerts, seconds).items()])


def ewma(
    df: DataFrame,
    by: list[str],
    value: str,
    order: list[str],
    alpha: float = EWMA_ALPHA,
    policy: SkewPolicy = SkewPolicy(),
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """Exponentially weighted mean per key, seeded with the first value.

    ``also`` names further aggregates of the same groups, taken in the same pass.

    Written out, the value r steps before the newest weighs ``alpha * (1 - alpha)^r``, and the seed adds
    ``(1 - alpha)^n`` of the first value. That is a plain sum over rows numbered from the newest, so no list is
    built per key.
    """

    def body(scan: Scan) -> DataFrame:
        scan = scan.running(_age=Running("sum", F.lit(1).cast("bigint")))
        weight = F.lit(float(alpha)) * F.pow(F.lit(1.0 - alpha), (F.col("_age") - 1).cast("double"))
        totals = scan.df.groupBy(*by).agg(
            F.sum(weight * F.col(value)).alias("_sum"),
            F.count(F.lit(1)).alias("_n"),
            F.max_by(value, "_age").alias("_first"),
            *[total.alias(name) for name, total in also.items()],
        )
        seed = F.pow(F.lit(1.0 - alpha), F.col("_n").cast("double")) * F.col("_first")
        return totals.select(*by, (F.col("_sum") + seed).alias("ewma"), *also)

    also = also or {}
    columns = df if also else df.select(*dict.fromkeys([*by, value, *order]))
    return keyed_scan(columns, by, [F.desc(c) for c in order], body, policy)


def health(
    df: DataFrame,
    workers: int = 4,
    threshold: int = 1000,
    alive: Column | None = None,
) -> DataFrame:
    """Health score and ratios of rows with total_processed, success_count, failure_count, backlog and ewma."""
    alive = F.lit(workers) if alive is None else alive
    total, failures, backlog, mean = (F.col(c) for c in ("total_processed", "failure_count", "backlog", "ewma"))
    missing = F.greatest(F.lit(workers) - alive, F.lit(0))
    failure_rate = F.when(total > 0, failures / total).otherwise(F.lit(0.0))
    score = (
        F.lit(100)
        - missing * 20
        - F.when(backlog > threshold, F.lit(30)).when(backlog > threshold * 0.7, F.lit(10)).otherwise(F.lit(0))
        - F.when(failure_rate > 0.2, F.lit(20)).when(failure_rate > 0.1, F.lit(10)).otherwise(F.lit(0))
    )
    throughput = F.when(mean > 0, F.lit(1.0) / mean).otherwise(F.lit(0.0))
    efficiency = F.when(total > 0, F.col("success_count") / total).otherwise(F.lit(0.0))
    pressure = backlog / F.lit(threshold) if threshold > 0 else F.lit(0.0)
    return df.withColumns(
        {
            "health_score": F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int"),
            "worker_efficiency": F.round(efficiency, 3),
            "queue_pressure": F.round(pressure, 3),
            "recent_throughput_eps": F.round(throughput, 2),
            "stagnation_detected": (backlog > threshold * 0.8) & (throughput < 0.1),
        }
    )
