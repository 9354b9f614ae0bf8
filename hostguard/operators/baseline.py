"""Mean / variance profiles of a metric and the outliers against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostguard.config import DetectionConfig
from hostguard.functions.text import as_double
from hostguard.operators.windows import with_threshold

OUTLIER_SIGMAS = 3


def read_metric(df: DataFrame, column: str = "metric") -> DataFrame:
    """Add ``value`` (double) and ``error``. Text that reads as a number counts as one."""
    if column not in df.columns:
        return df.withColumns({"value": F.lit(None).cast("double"), "error": F.lit(f"{column} is missing")})
    value = as_double(df, column)
    error = F.when(F.col(column).isNull(), F.lit(f"{column} is missing")).when(
        value.isNull(), F.lit("value is not a number")
    )
    return df.withColumns({"value": value, "error": error})


def build_baseline(df: DataFrame, by: list[str] = [], column: str = "metric") -> DataFrame:
    """Mean and population variance per group, or one row for everything. No usable row, no profile."""
    good = read_metric(df, column).filter(F.col("error").isNull())
    profile = good.groupBy(*by).agg(
        F.avg("value").alias("mean"),
        F.var_pop("value").alias("variance"),
        F.count(F.lit(1)).alias("samples"),
    )
    return profile.filter(F.col("samples") > 0)


def score_outliers(
    df: DataFrame, profile: DataFrame | None, by: list[str] = [], column: str = "metric", sigmas: float = OUTLIER_SIGMAS
) -> DataFrame:
    """Add ``value``, ``error``, ``mean``, ``variance`` and ``anomaly``.

    The ungrouped profile is read as a scalar subquery; a grouped one is joined on its keys, and its size
    decides at run time whether it is broadcast. Without a profile, ``df`` brings mean and variance itself.
    """
    rows = read_metric(df, column)
    if profile is None:
        pass
    elif by:
        rows = rows.join(profile.select(*by, "mean", "variance"), by, "left")
    else:
        one = profile.select(F.struct("mean", "variance")).scalar()
        rows = rows.withColumn("_profile", one).select("*", "_profile.mean", "_profile.variance").drop("_profile")
    distance = F.abs(F.col("value") - F.col("mean"))
    anomaly = F.when(F.col("variance") == 0, F.col("value") != F.col("mean")).otherwise(
        distance > F.lit(float(sigmas)) * F.sqrt("variance")
    )
    no_profile = F.when(F.col("mean").isNull(), F.lit("the profile lacks a mean or a variance"))
    return rows.withColumns({"error": F.coalesce("error", no_profile), "anomaly": anomaly})


def history_threshold(
    counts: DataFrame, value: str = "count", order: str | list[str] = "seq", cfg: DetectionConfig = DetectionConfig()
) -> DataFrame:
    """Threshold over the last ``baseline_max_history`` values of the whole table, a top-k and one small sum.

    ``order`` should be a total order, or which of several tied rows count is left open.
    """
    order = [order] if isinstance(order, str) else order
    last = counts.orderBy(*[F.desc(c) for c in order]).limit(cfg.baseline_max_history).select(F.col(value).cast("bigint").alias("_v"))
    totals = last.agg(
        F.count("_v").alias("history_n"),
        F.coalesce(F.sum("_v"), F.lit(0)).alias("history_sum"),
        F.coalesce(F.sum(F.col("_v") * F.col("_v")), F.lit(0)).cast("decimal(38,0)").alias("history_squares"),
        F.max("_v").alias("_top"),
    )
    return with_threshold(totals, cfg, "_top").select("history_n", "history_sum", "threshold")
