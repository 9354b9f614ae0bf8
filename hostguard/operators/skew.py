"""Running totals per key that hold up when one key owns a large part of the rows.

A window over a key sorts all rows of that key in one task. That is the cheapest plan for ordinary keys, and
it is what ``WindowScan`` does. Keys with more rows than ``SkewPolicy.hot_rows`` go to ``RangeScan``: the rows
are cut into even ranges of (key, order), each range is summed on its own, and the totals of the earlier
ranges of a key are added back. Both give the same rows, so operators are written once against either.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostguard.session import Scratch, materialize


@dataclass(frozen=True)
class SkewPolicy:
    """When a key counts as hot and how finely its rows are cut.

    However many keys are hot, each is split: their list is a table, broadcast while a count shows it to be below
    ``broadcast_keys`` and joined by a shuffle beyond. ``top_rows`` is the largest top-k that ends in one task.
    """

    hot_rows: float = 2_000_000
    broadcast_keys: int = 100_000
    top_rows: int = 20_000
    ranges: int | None = None

    def prepare(self, df: DataFrame) -> tuple[DataFrame, "SkewPolicy"]:
        """Rows and policy for an operator that reads its input several times.

        One row count decides. A small input cannot have a hot key, so no key is counted later. A large one is
        written out, narrow as it is, so that the source and its parsing are not run again for each pass.
        """
        if math.isinf(self.hot_rows):
            return df, self
        if df.count() > self.hot_rows:
            return materialize(df), self
        return df, replace(self, hot_rows=math.inf)

    def range_count(self, df: DataFrame) -> int:
        if self.ranges:
            return self.ranges
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def heavy_keys(df: DataFrame, keys: list[str], policy: SkewPolicy) -> DataFrame | None:
    """The keys with more than ``policy.hot_rows`` rows, or None. Counts are combined before the shuffle."""
    if math.isinf(policy.hot_rows):
        return None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > policy.hot_rows)
    found = materialize(counts.select(*keys))
    return None if found.isEmpty() else found


def split_heavy(df: DataFrame, keys: list[str], policy: SkewPolicy) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of hot keys if there are any."""
    hot = heavy_keys(df, keys, policy)
    if hot is None:
        return df, None
    hot = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    if hot.count() <= policy.broadcast_keys:
        hot = F.broadcast(hot)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


@dataclass(frozen=True)
class Running:
    """A running total: ``kind`` is sum or max; ``before`` leaves the current row out."""

    kind: str
    value: Column
    before: bool = False

    def over_window(self) -> Column:
        return F.sum(self.value) if self.kind == "sum" else F.max(self.value)


class WindowScan:
    """Running totals of ordinary keys, one window over the key."""

    hot = False

    def __init__(self, df: DataFrame, keys: list[str], order: list[str]):
        self.df, self.keys, self.order = df, keys, order

    def running(self, **totals: Running) -> "WindowScan":
        window = Window.partitionBy(*self.keys).orderBy(*self.order)
        columns = {}
        for name, total in totals.items():
            frame = window.rowsBetween(Window.unboundedPreceding, -1 if total.before else 0)
            columns[name] = total.over_window().over(frame)
        return self.derive(**columns)

    def lagged(self, position: str, steps: int, **columns: str) -> "WindowScan":
        """Values of ``columns`` from ``steps`` rows earlier; ``position`` numbers the rows of a key from 1."""
        window = Window.partitionBy(*self.keys).orderBy(*self.order)
        return self.derive(**{name: F.lag(source, steps).over(window) for name, source in columns.items()})

    def derive(self, **columns: Column) -> "WindowScan":
        return type(self)(self.df.withColumns(columns), self.keys, self.order)

    def filter(self, condition: Column) -> "WindowScan":
        return type(self)(self.df.filter(condition), self.keys, self.order)

    def reordered(self, df: DataFrame, order: list[str]) -> "WindowScan":
        """A scan of ``df``, rows made from this scan's rows, in another order."""
        return type(self)(df, self.keys, order)


class RangeScan:
    """Running totals of hot keys, over even ranges of (key, order)."""

    hot = True

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], policy: SkewPolicy, laid_out: bool = False):
        self.df, self.keys, self.order, self.policy, self.laid_out = df, keys, order, policy, laid_out

    def _lay_out(self, scratch: Scratch) -> "RangeScan":
        if self.laid_out:
            return self
        ranged = self.df.repartitionByRange(self.policy.range_count(self.df), *self.keys, *self.order)
        ranged = scratch.keep(ranged.withColumn("_range", F.spark_partition_id()))
        return RangeScan(ranged, self.keys, self.order, self.policy, laid_out=True)

    def running(self, **totals: Running) -> "RangeScan":
        scratch = Scratch(self.df.sparkSession)
        if not self.laid_out:
            laid_out = self._lay_out(scratch)
            done = laid_out.running(**totals)
            scratch.close()  # the totals are written, so nothing reads the layout any more
            return done
        window = Window.partitionBy("_range", *self.keys).orderBy(*self.order)
        local = {}
        for name, total in totals.items():
            frame = window.rowsBetween(Window.unboundedPreceding, -1 if total.before else 0)
            local[f"_in_{name}"] = total.over_window().over(frame)
        per_range = self.df.groupBy("_range", *self.keys).agg(
            *[total.over_window().alias(f"_out_{name}") for name, total in totals.items()]
        )
        # One row per range and hot key in it.
        earlier = Window.partitionBy(*self.keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        carried = per_range.select(
            "_range",
            *self.keys,
            *[
                (F.sum if total.kind == "sum" else F.max)(f"_out_{name}").over(earlier).alias(f"_out_{name}")
                for name, total in totals.items()
            ],
        )
        carried = carried.withColumnsRenamed({k: f"_c_{k}" for k in ["_range", *self.keys]})
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in ["_range", *self.keys]])
        carried = scratch.keep(carried)
        if carried.count() <= self.policy.broadcast_keys:
            carried = F.broadcast(carried)
        joined = self.df.withColumns(local).join(carried, same, "left")
        merged = {}
        for name, total in totals.items():
            if total.kind == "sum":
                # A sum over no rows is null, as it is in a window.
                both = F.coalesce(f"_in_{name}", F.lit(0)) + F.coalesce(f"_out_{name}", F.lit(0))
                none = F.col(f"_in_{name}").isNull() & F.col(f"_out_{name}").isNull()
                merged[name] = F.when(~none, both)
            else:
                merged[name] = F.greatest(f"_in_{name}", f"_out_{name}")
        kept = [c for c in self.df.columns if c not in merged]
        done = joined.select(*kept, *[value.alias(name) for name, value in merged.items()])
        done = RangeScan(materialize(done), self.keys, self.order, self.policy, laid_out=True)
        scratch.close()
        return done

    def lagged(self, position: str, steps: int, **columns: str) -> "RangeScan":
        # (key, position) is unique, so this join spreads evenly however hot the key is.
        sources = list(columns.values())
        earlier = self.df.select(
            *[F.col(k).alias(f"_e_{k}") for k in self.keys],
            (F.col(position) + steps).alias("_e_position"),
            *[F.col(source).alias(f"_e_{name}") for name, source in columns.items()],
        )
        same = reduce(
            lambda a, b: a & b,
            [F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in self.keys] + [F.col(position) == F.col("_e_position")],
        )
        joined = self.df.join(earlier, same, "left")
        kept = [c for c in self.df.columns if c not in columns]
        picked = joined.select(*kept, *[F.col(f"_e_{name}").alias(name) for name in columns])
        return RangeScan(picked, self.keys, self.order, self.policy, self.laid_out)

    def derive(self, **columns: Column) -> "RangeScan":
        return RangeScan(self.df.withColumns(columns), self.keys, self.order, self.policy, self.laid_out)

    def filter(self, condition: Column) -> "RangeScan":
        return RangeScan(self.df.filter(condition), self.keys, self.order, self.policy, self.laid_out)

    def reordered(self, df: DataFrame, order: list[str]) -> "RangeScan":
        return RangeScan(df.drop("_range"), self.keys, order, self.policy)


Scan = WindowScan | RangeScan


def first_rows(df: DataFrame, order: list, n: int, policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """The first ``n`` rows by ``order``, which must be a total order.

    A small ``n`` is a top-k that ends in one task. A large one never meets in one task: the rows are laid out
    in ranges and numbered.
    """
    if n <= min(policy.hot_rows, policy.top_rows):
        return df.orderBy(*order).limit(max(n, 0))
    scan = RangeScan(df, [], order, policy).running(_number=Running("sum", F.lit(1).cast("bigint")))
    return scan.filter(F.col("_number") <= n).df.select(*df.columns)


def keyed_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    body: Callable[[Scan], DataFrame],
    policy: SkewPolicy,
    hot_flag: str | None = None,
) -> DataFrame:
    """Run ``body`` over every key, hot keys through ranges, and put the rows back together.

    ``hot_flag`` names a boolean column that marks the rows of hot keys; it is there only if a key is hot.
    """
    ordinary, hot = split_heavy(df, keys, policy)
    parts = [body(WindowScan(ordinary, keys, order))]
    if hot is not None:
        parts.append(body(RangeScan(hot, keys, order, policy)).drop("_range"))
    if hot_flag and hot is not None:
        parts = [part.withColumn(hot_flag, F.lit(i == 1)) for i, part in enumerate(parts)]
    return reduce(DataFrame.unionByName, parts)
