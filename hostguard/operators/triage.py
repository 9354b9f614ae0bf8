"""Which alerts to look at first."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostguard.operators.alerts import PRIORITIES
from hostguard.operators.skew import SkewPolicy, first_rows


def priority_values(extra: dict[str, int] = {}) -> dict[str, int]:
    """Priority numbers by upper-case name; two names may not share a number."""
    values = dict(PRIORITIES)
    for name, value in extra.items():
        if value in values.values():
            raise ValueError(f"two priorities have the number {value}")
        values[name.upper()] = value
    return values


def named_priority(df: DataFrame, column: str, extra: dict[str, int] = {}) -> DataFrame:
    """Add ``priority`` from a column of priority names; unknown names carry ``error``."""
    values = priority_values(extra)
    name = F.upper(F.col(column))
    number = F.coalesce(*[F.when(name == known, F.lit(value)) for known, value in values.items()])
    error = F.when(number.isNull(), F.concat(F.lit("no such priority: "), F.col(column)))
    return df.withColumns({"priority": number, "error": error})


def take_first(df: DataFrame, n: int, arrival: str = "seq", policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """The ``n`` most urgent rows, earliest first within a priority."""
    return first_rows(df, ["priority", arrival], n, policy).orderBy("priority", arrival)


def take_with_quotas(
    df: DataFrame, capacity: int, quotas: dict[int, float], arrival: str = "seq", policy: SkewPolicy = SkewPolicy()
) -> DataFrame:
    """At most ``int(capacity * quota)`` rows of each listed priority, ``capacity`` rows in all.

    One pass: rows are numbered per priority up to its quota, which cuts a hot priority down in every task before the
    shuffle; rows of other priorities are numbered together.
    """
    limit = F.lit(capacity)
    for number, quota in quotas.items():
        limit = F.when(F.col("priority") == number, F.lit(int(capacity * quota))).otherwise(limit)
    listed = F.when(F.col("priority").isin(*quotas), F.col("priority")) if quotas else F.lit(None).cast("int")
    within = Window.partitionBy("_listed").orderBy("priority", arrival)
    numbered = df.withColumn("_listed", listed).withColumn("_nth", F.row_number().over(within))
    kept = numbered.filter((F.col("_nth") <= capacity) & (F.col("_nth") <= limit)).drop("_listed", "_nth")
    return take_first(kept, capacity, arrival, policy)
