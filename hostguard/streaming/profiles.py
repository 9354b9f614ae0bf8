"""A metric's profile that is kept up to date by a stream, and outliers against its newest version.

A version is one row per group: samples, mean and the sum of squared deviations. A micro-batch is reduced to such rows and
merged with the version before it, so its cost follows its own rows and the number of groups, never the history. The
version of batch n is ``version=<n>``; a repeated batch reads the one before it and overwrites its own. The last ``keep``
versions stay.

Null group values are a group; rows without a usable value change nothing; an empty batch carries the profile on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostguard.operators.baseline import OUTLIER_SIGMAS, build_baseline, score_outliers
from hostguard.sources.deltas import remove, whole_parts


def profile_parts(df: DataFrame, by: list[str] = [], column: str = "metric") -> DataFrame:
    """(*by, samples, mean, squares) of the usable rows; ``squares`` is the sum of squared deviations from the mean."""
    profile = build_baseline(df, by, column)
    return profile.select(*by, "samples", "mean", (F.col("variance") * F.col("samples")).alias("squares"))


def merge_parts(left: DataFrame, right: DataFrame, by: list[str] = []) -> DataFrame:
    """The parts of both sides' rows together. The means' distance is added, so nothing large is subtracted."""
    left = left.select(*[F.col(k).alias(f"_l_{k}") for k in by], F.struct("samples", "mean", "squares").alias("_a"))
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in by], F.struct("samples", "mean", "squares").alias("_b"))
    same = reduce(lambda a, b: a & b, [F.col(f"_l_{k}").eqNullSafe(F.col(f"_r_{k}")) for k in by], F.lit(True))
    both = left.join(right, same, "full")
    keys = [F.when(F.col("_a").isNull(), F.col(f"_r_{k}")).otherwise(F.col(f"_l_{k}")).alias(k) for k in by]
    n, m = F.col("_a.samples"), F.col("_b.samples")
    distance = F.col("_b.mean") - F.col("_a.mean")
    return both.select(
        *keys,
        (F.coalesce(n, F.lit(0)) + F.coalesce(m, F.lit(0))).cast("bigint").alias("samples"),
        F.coalesce(F.col("_a.mean") + distance * m / (n + m), "_a.mean", "_b.mean").alias("mean"),
        F.coalesce(
            F.col("_a.squares") + F.col("_b.squares") + distance * distance * n * m / (n + m), "_a.squares", "_b.squares"
        ).alias("squares"),
    )


class ProfileSink:
    """A ``foreachBatch`` sink that adds every batch to the profile in ``folder``."""

    def __init__(self, folder: str, by: list[str] = [], column: str = "metric", keep: int = 3) -> None:
        self.folder, self.by, self.column, self.keep = folder.rstrip("/"), by, column, max(2, keep)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, parts = batch.sparkSession, profile_parts(batch, self.by, self.column)
        before = self._version(spark, batch_id)
        merged = parts if before is None else merge_parts(before, parts, self.by)
        merged.write.mode("overwrite").parquet(f"{self.folder}/version={batch_id}")
        for number in whole_parts(spark, self.folder, "version")[: -self.keep]:
            remove(spark, f"{self.folder}/version={number}")

    def _version(self, spark: SparkSession, below: int | None) -> DataFrame | None:
        known = [n for n in whole_parts(spark, self.folder, "version") if below is None or n < below]
        return spark.read.parquet(f"{self.folder}/version={known[-1]}") if known else None

    def profile(self, spark: SparkSession, below: int | None = None) -> DataFrame | None:
        """(*by, mean, variance, samples) of the newest version, or of the newest before batch ``below``."""
        found = self._version(spark, below)
        if found is None:
            return None
        return found.select(*self.by, "mean", (F.col("squares") / F.col("samples")).alias("variance"), "samples")


class OutlierSink:
    """A ``foreachBatch`` sink: each batch is scored by the profile of the batches before it, then added to the profile.

    ``write`` takes (scored rows, batch id). In the first batch no row has a profile, which its ``error`` says.
    """

    def __init__(self, profile: ProfileSink, write, sigmas: float = OUTLIER_SIGMAS) -> None:
        self.profile, self.write, self.sigmas = profile, write, sigmas

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        before = self.profile.profile(batch.sparkSession, batch_id)
        if before is None:
            nothing = F.lit(None).cast("double")
            batch_with = batch.withColumns({"mean": nothing, "variance": nothing})
            scored = score_outliers(batch_with, None, column=self.profile.column, sigmas=self.sigmas)
        else:
            scored = score_outliers(batch, before, self.profile.by, self.profile.column, self.sigmas)
        self.write(scored, batch_id)
        self.profile(batch, batch_id)
