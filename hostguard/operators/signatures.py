"""Catalogues of many patterns: an inverted index from required literals to patterns.

``literal_index`` reads from every pattern the literals that its matches cannot lack, and files the pattern under one
short piece (gram) of each: the piece that the fewest patterns of the catalogue share. A line probes the index with its
own grams, so it meets the patterns whose piece it holds and no others; only those are tested, first for the whole
literal, then by the regular expression. The work per line follows its length and its candidates, not the number of
patterns. Nothing is shuffled while the index is small enough to be broadcast (a count tells); beyond, lines' grams and
index meet by a join on the gram.

Patterns without a certain literal (``\\d+``, ``(?i)...``) cannot be filed. They are tested against every line, as
``parsing.signature_hits`` does, a block of patterns per pass.

Null and empty lines and null patterns give no hits (an empty pattern is in every line); a line that holds a gram several
times, and a pattern filed under several literals, give one hit. Patterns with equal text but different ordinals are hits of
their own; rows of one ordinal give a hit each.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostguard.functions.literals import SHORTEST, required_literals
from hostguard.functions.text import java_pattern
from hostguard.operators.parsing import signature_hits
from hostguard.plans.catalog import LinePattern
from hostguard.session import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONG_GRAM = 5
GRAMS = (SHORTEST, LONG_GRAM)
BROADCAST_ROWS = 200_000
BLOCK = 500  # patterns without a literal that one pass tests

_WAYS = "ordinal bigint, pattern string, regex string, ways array<array<string>>"
_ENTRY = "array<struct<ordinal:bigint,literal:string,earlier:array<string>,regex:string>>"


def _ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        found = rows.assign(ways=[required_literals(p) for p in rows["pattern"]], regex=[java_pattern(p) for p in rows["pattern"]])
        yield found[["ordinal", "pattern", "regex", "ways"]]


def readable_patterns(catalogue: DataFrame) -> DataFrame:
    """(ordinal, pattern, regex, ways) of the patterns that are not null."""
    rows = catalogue.select(F.col("ordinal").cast("bigint").alias("ordinal"), F.col("pattern").cast("string").alias("pattern"))
    return rows.filter("pattern IS NOT NULL").mapInPandas(_ways, _WAYS)


def literal_index(patterns: DataFrame) -> DataFrame:
    """(width, gram, ordinal, literal, earlier, regex): where each pattern of ``readable_patterns`` is filed.

    Of a pattern's ways the one is taken whose pieces the fewest patterns share. ``earlier`` lists the literals of the
    same way that come first, so that a line with several of them reports the pattern once.
    """
    way = patterns.filter("size(ways) > 0").withColumn("row", F.monotonically_increasing_id())
    way = way.select("row", "ordinal", "regex", F.posexplode("ways").alias("way", "literals"))
    each = way.select("row", "way", F.posexplode("literals").alias("at", "literal"))
    width = F.when(F.length("literal") >= LONG_GRAM, LONG_GRAM).otherwise(SHORTEST)
    start = F.explode(F.sequence(F.lit(1), F.length("literal") - F.col("width") + 1)).alias("start")
    pieces = each.withColumn("width", width).select("*", start).withColumn("gram", F.expr("substring(literal, start, width)")).drop("start")
    shared = pieces.groupBy("gram").agg(F.count_distinct("row").alias("patterns"))
    rarest = F.min(F.struct("patterns", "gram", "width")).alias("piece")
    filed = pieces.join(shared, "gram").groupBy("row", "way", "at").agg(rarest)
    costs = filed.groupBy("row", "way").agg(F.sum("piece.patterns").alias("cost"))
    chosen = costs.groupBy("row").agg(F.min(F.struct("cost", "way")).alias("best")).select("row", "best.way")
    rows = way.join(chosen, ["row", "way"]).join(filed, ["row", "way"])
    literal, earlier = F.get("literals", F.col("at")), F.slice("literals", F.lit(1), F.col("at"))
    return rows.select("piece.width", "piece.gram", "ordinal", literal.alias("literal"), earlier.alias("earlier"), "regex")


def _gram(width: int) -> Column:
    """``width`` characters from the current place; fewer at the end of a line."""
    return F.concat_ws("", *[F.get("_chars", F.col("_i") + k) for k in range(width)])


def indexed_hits(df: DataFrame, catalogue: DataFrame, column: str = "line") -> DataFrame:
    """Every (line, pattern) hit of a catalogue table (ordinal, pattern) of any size, as rows of ``df`` with ``ordinal``."""
    scratch = Scratch(df.sparkSession)
    patterns = scratch.keep(readable_patterns(catalogue))
    index = scratch.keep(literal_index(patterns))
    parts = [_filed_hits(df, index, column)]
    rest = patterns.filter("size(ways) = 0").orderBy("ordinal", "pattern").select("ordinal", "pattern").collect()
    for start in range(0, len(rest), BLOCK):
        parts.append(_plain_hits(df, rest[start : start + BLOCK], column))
    return reduce(DataFrame.unionByName, parts)


def _filed_hits(df: DataFrame, index: DataFrame, column: str) -> DataFrame:
    names = [c for c in df.columns if c != "ordinal"]
    line = F.col(column)
    rows = df.filter(line.isNotNull()).select(*names).withColumn("_chars", F.split(line, ""))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("_chars") - 1)).alias("_i"))
    widths = sorted(r.width for r in index.select("width").distinct().collect())
    for width in widths:
        entries = index.filter(F.col("width") == width).groupBy(F.col("gram").alias(f"_gram{width}"))
        entries = entries.agg(F.collect_list(F.struct("ordinal", "literal", "earlier", "regex")).alias(f"_at{width}"))
        few = F.broadcast(entries) if index.count() <= BROADCAST_ROWS else entries
        rows = rows.join(few, _gram(width) == F.col(f"_gram{width}"), "left")
    if not widths:
        return df.select(*names, F.lit(None).cast("bigint").alias("ordinal")).limit(0)
    # The first place of a gram in the line stands for all.
    met = [
        F.when(F.col(f"_at{w}").isNotNull() & (F.instr(line, _gram(w)) == F.col("_i") + 1), F.col(f"_at{w}")).otherwise(F.array().cast(_ENTRY))
        for w in widths
    ]
    some = reduce(lambda a, b: a | b, [F.col(f"_at{w}").isNotNull() for w in widths])
    found = rows.filter(some).select(*names, F.explode(F.concat(*met)).alias("_entry"))
    repeated = F.exists("_entry.earlier", lambda literal: line.contains(literal))
    hit = line.contains(F.col("_entry.literal")) & ~repeated & F.expr(f"`{column}` rlike _entry.regex")
    return found.filter(hit).select(*names, F.col("_entry.ordinal").alias("ordinal"))


def _plain_hits(df: DataFrame, rows: list, column: str) -> DataFrame:
    """A block of patterns tested in one projection."""
    hits = signature_hits(df.drop("ordinal"), [LinePattern(r.pattern) for r in rows], column)
    ordinals = F.array(*[F.lit(r.ordinal).cast("bigint") for r in rows])
    return hits.withColumn("ordinal", ordinals[F.col("ordinal")])


def indexed_counts(df: DataFrame, catalogue: DataFrame, column: str = "line") -> DataFrame:
    """(ordinal, pattern, hits) for every pattern of the catalogue, those without hits included."""
    counts = indexed_hits(df, catalogue, column).groupBy(F.col("ordinal").alias("_ordinal")).agg(F.count(F.lit(1)).alias("hits"))
    known = catalogue.select(F.col("ordinal").cast("bigint").alias("ordinal"), "pattern")
    joined = known.join(counts, F.col("ordinal") == F.col("_ordinal"), "left").drop("_ordinal")
    return joined.withColumn("hits", F.coalesce("hits", F.lit(0).cast("bigint")))


def first_hits(df: DataFrame, catalogue: DataFrame, key: list[str], column: str = "line") -> DataFrame:
    """The first pattern in catalogue order per line; ``key`` names the columns that tell lines apart."""
    hits = indexed_hits(df, catalogue, column)
    others = [c for c in hits.columns if c not in key]
    first = hits.groupBy(*key).agg(F.min_by(F.struct(*others), F.col("ordinal")).alias("_first"))
    return first.select(*key, "_first.*").select(*hits.columns)


__all__ = ["first_hits", "indexed_counts", "indexed_hits", "literal_index", "readable_patterns"]
