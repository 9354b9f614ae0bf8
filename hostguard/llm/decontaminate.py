"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly.

Words are runs of letters and digits of the lower-cased text, shingles are five words. Items are partitioned by
their number of shingles (a power of two each). A partition whose largest item has u shingles keeps the k smallest
hash values of each item, k = floor((1 - t) u) + 1: an item contained to the share t lacks at most (1 - t) u of its
shingles, so a document that contains it must hold one of the k. A banded signature of the long document would
almost never meet a short item; probing the document's values with the item's sketch loses none.

Pass 1 hashes every document's shingles and looks them up among the sketches; only (doc_id, item_id) leaves it.
Pass 2 reads the candidate documents again and counts the shingles of the item that they really hold, as text.

Edge cases: an item with fewer than five words is one shingle of all its words, searched as such; an item without
words, and a null text, match nothing. Rows that share a doc_id count as one document, or those that share all
``keys`` if others are given. An empty table on either side gives an empty result. Repeated items are reported under each of their ids, an id with several texts by its best. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostguard.llm.common import small
from hostguard.session import Scratch

KEYS = ("doc_id",)
WORDS = 5
SHARE = 80  # hundredths

NO_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    cut = F.split(F.btrim(F.regexp_replace(F.lower(text), "^" + NO_WORD + "|" + NO_WORD + "$", "")), NO_WORD)
    return F.filter(cut, lambda w: w != "")


def doc_words(text: Column) -> Column:
    """The same words of a long text: split once, an empty first or last piece cut off."""
    cut = F.split(F.lower(text), NO_WORD)
    first = F.when(F.get(cut, F.lit(0)) == "", 2).otherwise(1)
    last = F.when(F.get(cut, F.size(cut) - 1) == "", F.size(cut) - 1).otherwise(F.size(cut))
    return F.slice(cut, first, F.greatest(last - first + 1, F.lit(0)))


def each_shingle(df: DataFrame, keys: list[str], width: Column | int, value) -> DataFrame:
    """One row per shingle of ``words``; ``value`` makes the column from the list of its word columns."""
    # No filter on the number of words: it would be pushed down and split every text once more.
    starts = F.when(F.size("words") >= width, F.sequence(F.lit(0), F.size("words") - width))
    at = df.select(*keys, "words", F.explode(starts).alias("i"))
    return at.select(*keys, value([F.get("words", F.col("i") + k) for k in range(width)]).alias("shingle"))


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, part, width, n, shingle): the n distinct shingles of every item; ``part`` tells texts of one id apart."""
    cut = items.select(F.col("item_id").cast("bigint").alias("item_id"), words(F.col("text")).alias("words"))
    cut = cut.filter(F.size("words") > 0).withColumn("width", F.least(F.size("words"), F.lit(WORDS)))
    grams = F.expr("transform(sequence(0, size(words) - width), i -> concat_ws(' ', slice(words, i + 1, width)))")
    grams = F.array_distinct(grams)
    rows = cut.select("item_id", "width", grams.alias("grams")).withColumn("part", F.xxhash64("grams")).dropDuplicates()
    return rows.select("item_id", "part", "width", F.size("grams").alias("n"), F.explode("grams").alias("shingle"))


def sketches(shingles: DataFrame, share: int = SHARE) -> DataFrame:
    """(width, hash, item_id): the smallest hash values of each item, as many as its size partition asks for.

    ``u`` is the top of the item's size partition.
    """
    hashed = shingles.select("item_id", "part", "width", "n", F.expr("xxhash64(shingle)").alias("hash"))
    upper = F.expr("shiftleft(1, CAST(ceil(log2(n)) AS INT))")
    grouped = hashed.groupBy("item_id", "part", "width", upper.alias("u")).agg(F.sort_array(F.collect_set("hash")).alias("values"))
    length = F.floor(F.col("u") * (100 - share) / 100).cast("int") + 1
    return grouped.select("width", F.explode(F.slice("values", F.lit(1), length)).alias("hash"), "item_id")


def key_columns(keys: tuple[str, ...]) -> list[Column]:
    return [F.col(k).cast("bigint").alias(k) for k in keys]


def same_keys(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def candidates(docs: DataFrame, sketch: DataFrame, widths: list[int], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Distinct (keys, item_id) where the document holds a value of the item's sketch."""
    cut = docs.select(*key_columns(keys), doc_words(F.col("text")).alias("words"))
    found = None
    for width in widths:
        hashed = each_shingle(cut, [*keys], width, lambda gram: F.xxhash64(F.concat_ws(" ", *gram)))
        wanted = small(sketch.filter(F.col("width") == width).select(F.col("hash").alias("shingle"), "item_id"))
        pairs = hashed.join(wanted, "shingle").select(*keys, "item_id")
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def verify(
    docs: DataFrame, pairs: DataFrame, shingles: DataFrame, widths: list[int], share: int = SHARE, keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """(keys, item_id, n_shared, n_shingles, containment) of the candidate pairs that reach the share."""
    found = [f"_found_{k}" for k in keys]
    listed = small(pairs.select(*keys).distinct())
    cut = docs.select(*key_columns(keys), "text")
    cut = cut.join(listed.withColumnsRenamed(dict(zip(keys, found))), same_keys([*keys], found), "left_semi")
    cut = cut.select(*keys, doc_words(F.col("text")).alias("words"))
    held = None
    for width in widths:
        grams = each_shingle(cut, [*keys], width, lambda gram: F.concat_ws(" ", *gram))
        wanted = small(shingles.filter(F.col("width") == width).select("shingle", "item_id", "part", "n"))
        rows = grams.join(wanted, "shingle").select(*keys, "item_id", "part", "n", "shingle")
        held = rows if held is None else held.unionByName(rows)
    held = held.distinct().groupBy(*keys, "item_id", "part", "n").agg(F.count(F.lit(1)).alias("n_shared"))
    held = held.filter(F.col("n_shared") * 100 >= F.col("n") * share)
    best = F.max(F.struct((F.col("n_shared") / F.col("n")).alias("containment"), "n_shared", "n")).alias("best")
    held = held.groupBy(*[F.col(k).alias(f) for k, f in zip(keys, found)], F.col("item_id").alias("_item")).agg(best)
    return held.join(pairs, same_keys([*found, "_item"], [*keys, "item_id"]), "left_semi").select(
        *[F.col(f).alias(k) for k, f in zip(keys, found)],
        F.col("_item").alias("item_id"),
        "best.n_shared",
        F.col("best.n").cast("bigint").alias("n_shingles"),
        "best.containment",
    )


def leaks(docs: DataFrame, items: DataFrame, share: int = SHARE, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Every document and item where the document holds at least ``share`` hundredths of the item's shingles.

    ``keys`` are the numeric columns that tell documents apart.
    """
    scratch = Scratch(docs.sparkSession)
    shingles = scratch.keep(item_shingles(items))
    sketch = scratch.keep(sketches(shingles, share))
    widths = sorted(r.width for r in sketch.select("width").distinct().collect()) or [WORDS]
    pairs = scratch.keep(candidates(docs, sketch, widths, keys))
    found = scratch.keep(verify(docs, pairs, shingles, widths, share, keys))
    scratch.drop(pairs, sketch, shingles)
    return found
