"""Exact percentiles without bringing the values together."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: bins that a span of values is cut in each round.
BINS = 1024


def exact_percentiles(rows: DataFrame, value: Column, fractions: list[float]) -> list[float]:
    """Percentiles of a whole number, interpolated as ``F.percentile`` does; empty if there is no value.

    ``F.percentile`` keeps every distinct value in one task. Here the values are counted per bin, then inside the bins
    that hold a wanted rank, until each is known: a few passes, and no more than some thousand counts come together.
    """
    values = rows.select(value.cast("bigint").alias("v")).filter(F.col("v").isNotNull())
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return []
    places = [(n - 1) * fraction for fraction in fractions]
    ranks = {rank for place in places for rank in (math.floor(place), math.ceil(place))}
    found = _at_ranks(values, (low, high, n, 0, sorted(ranks)))

    def between(place: float) -> float:
        lower, higher = math.floor(place), math.ceil(place)
        if found[lower] == found[higher]:
            return float(found[lower])
        return (higher - place) * found[lower] + (place - lower) * found[higher]

    return [between(place) for place in places]


def _at_ranks(values: DataFrame, whole: tuple[int, int, int, int, list[int]]) -> dict[int, int]:
    """The values at the ranks of a span (least, largest, rows, rows below it, ranks)."""
    found: dict[int, int] = {}
    spans = [whole]
    while spans:
        wider = []
        for low, high, rows, below, ranks in spans:
            found |= {r: low for r in ranks if r == below or low == high}
            found |= {r: high for r in ranks if r == below + rows - 1}
            rest = [r for r in ranks if r not in found]
            if rest:
                wider.append((low, high, rows, below, rest))
        spans = _narrowed(values, wider) if wider else []
    return found


def _narrowed(values: DataFrame, spans: list[tuple]) -> list[tuple]:
    """The bins of the spans that hold a wanted rank, as spans."""
    bins = " ".join(
        f"WHEN v BETWEEN {low} AND {high} THEN {at * BINS} + (v - {low}) div {(high - low) // BINS + 1}"
        for at, (low, high, *_) in enumerate(spans)
    )
    binned = values.withColumn("bin", F.expr(f"CASE {bins} END")).filter(F.col("bin").isNotNull())
    counted = binned.groupBy("bin").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    narrower = []
    below = {at: span[3] for at, span in enumerate(spans)}
    for row in sorted(counted.collect(), key=lambda r: r.bin):
        at = row.bin // BINS
        inside = [r for r in spans[at][4] if below[at] <= r < below[at] + row.n]
        if inside:
            narrower.append((row.low, row.high, row.n, below[at], inside))
        below[at] += row.n
    return narrower
