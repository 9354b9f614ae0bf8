"""Ranked lexical search by pipelined term partitioning: bundles of items visit the owners of their terms in turn.

Terms are dealt to four owners by the share of documents that hold them, the rarest first. Items are tied in bundles; for
each block of documents a bundle carries, per item, a sparse accumulator (document -> score so far). A stage cogroups
the bundles with the postings of one owner and adds the owner's integer contributions, so no stage sees more than one
owner's lists and no accumulator is gathered in one place before the final selection.

Accumulators that cannot win are left behind, which changes no result: after a stage the tenth best partial score of an
item is known (scores only grow), and so is the most that the remaining owners can add to any document of the item (the
largest contribution of each term, over all documents). What cannot reach the tenth best with it is dropped, new
documents included; ties at the tenth place are kept.

A block has some ``BLOCK`` documents whatever the corpus size, a bundle some ``BUNDLE`` items, so a group is bounded:
a term that a third of all documents hold is spread over all blocks. Thresholds and the final selection keep the ten best
per task before anything is shuffled by item. The index holds only terms of the items. The items are the stated query
set; their terms, owners and bounds are tables, broadcast while a count shows them to be small.

Edge cases: a null text has no terms, a document or item without terms matches nothing. Rows that share a doc_id are
documents of their own, numbered by row; equal scores go by ascending doc_id (null last), then by row. Rows that share an
item_id are one item with the terms of all, a null item_id is one of its own. Empty tables give an empty result. A very long
text is counted term by term. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostguard.llm.common import LOWER, UPPER, in_tasks, ship_code, small
from hostguard.session import Scratch

# Fixed value: a term is a longest match of this in the text, A-Z lower-cased.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOWN = str.maketrans(UPPER, LOWER)

BEST = 10
BLOCK = 4096  # documents
BUNDLE = 256  # items
# A term belongs to the first owner whose share of the documents it does not exceed, the rest to the last owner.
OWNERS = (1 / 512, 1 / 64, 1 / 8)

COUNTED = "row bigint, id bigint, n bigint, terms array<string>, times array<bigint>"
STATE = "bundle bigint, block bigint, item bigint, docs array<bigint>, ids array<bigint>, scores array<bigint>"
NO_ID = np.iinfo(np.int64).max  # orders documents without a doc_id last


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of terms of every text, and how often it holds each."""
    for batch in batches:
        sizes, terms, times = [], [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            text = text.lower() if text.isascii() else text.translate(DOWN)
            held = Counter(m.group() for m in TERM.finditer(text))
            sizes.append(held.total())
            terms.append(list(held))
            times.append(list(held.values()))
        columns = [batch.column("row"), batch.column("id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))]
        yield pa.record_batch(columns, names=["row", "id", "n", "terms", "times"])


def counted(rows: DataFrame, key: str) -> DataFrame:
    """(row, id, n, terms, times) of a table's texts."""
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    return in_tasks(numbered, count_terms, COUNTED)


def each_term(rows: DataFrame) -> DataFrame:
    """(row, id, n, term, times)."""
    return rows.select("row", "id", "n", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("times").alias("times"))))


def item_terms(items: DataFrame, scratch: Scratch) -> DataFrame:
    """(item, bundle, item_id, term, times): numbered items with the terms of all their texts."""
    rows = scratch.keep(each_term(counted(items, "item_id")).groupBy(F.col("id").alias("item_id"), "term").agg(F.sum("times").alias("times")))
    ids = scratch.keep(rows.select(F.col("item_id").alias("id")).distinct().withColumn("item", F.monotonically_increasing_id()))
    bundles = 1 + ids.count() // BUNDLE
    ids = ids.withColumn("bundle", F.expr(f"pmod(xxhash64(item), {bundles}L)"))
    return rows.join(small(ids), F.col("item_id").eqNullSafe(F.col("id"))).drop("id")


def stage(last: bool):
    """One owner's visit: adds its contributions, drops what cannot reach the threshold, or keeps the best at the end."""

    def run(key: tuple, bundle: pa.Table, postings: pa.Table) -> pa.Table:
        term, row = postings.column("term").to_numpy(), postings.column("row").to_numpy()
        gain = postings.column("gain").to_numpy()
        order = np.argsort(term, kind="stable")
        term, row, gain, ids = term[order], row[order], gain[order], postings.column("id").to_numpy()[order]
        lists, starts = np.unique(term, return_index=True)
        place = {t: (a, b) for t, a, b in zip(lists.tolist(), starts.tolist(), [*starts[1:].tolist(), len(term)])}
        held = {c: bundle.column(c).combine_chunks() for c in ("docs", "ids", "scores")}
        docs, first, where = np.unique(np.concatenate([row, flat(held["docs"])]), return_index=True, return_inverse=True)
        names = np.concatenate([ids, flat(held["ids"])])[first] if len(docs) else docs
        old, cuts = where[len(row) :], held["docs"].offsets.to_numpy() - held["docs"].offsets[0].as_py()
        scores_before = flat(held["scores"])
        kept = []
        for i, item in enumerate(bundle.select(["terms", "times", "rest", "threshold"]).to_pylist()):
            score = np.zeros(len(docs), np.int64)
            mine = slice(cuts[i], cuts[i + 1])
            score[old[mine]] = scores_before[mine]
            for t, times in zip(item["terms"], item["times"]):
                if t in place:
                    a, b = place[t]
                    score[where[a:b]] += gain[a:b] * times
            alive = np.flatnonzero((score > 0) & (score + item["rest"] >= item["threshold"]))
            if last and len(alive) > BEST:
                alive = alive[np.lexsort((docs[alive], names[alive], -score[alive]))[:BEST]]
            kept.append((docs[alive], names[alive], score[alive]))
        out = [bundle.column(c) for c in ("bundle", "block", "item")]
        return pa.table(
            [*out, *[lists_of([k[j] for k in kept]) for j in range(3)]],
            names=["bundle", "block", "item", "docs", "ids", "scores"],
        )

    return run


def flat(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def lists_of(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *[len(p) for p in parts]]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()))


def tenth_best(bundles: DataFrame) -> DataFrame:
    """(item, threshold): the tenth best partial score of the items that have ten."""
    in_block = F.slice(F.sort_array("scores", asc=False), 1, BEST)
    each = bundles.select("item", F.explode(in_block).alias("score"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc()))
    best = each.withColumn("rank", rank).filter(F.col("rank") <= BEST)
    return best.groupBy("item").agg(F.min("score").alias("threshold"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == BEST).drop("n")


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the ten best documents of every item."""
    spark = docs.sparkSession
    ship_code(docs)
    scratch = Scratch(spark)
    wanted = scratch.keep(item_terms(items, scratch))
    terms = scratch.keep(wanted.select("term").distinct().withColumn("number", F.monotonically_increasing_id()))
    index = scratch.keep(counted(docs, "doc_id"))
    N, L = index.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not N or not wanted.head(1):
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    length = F.expr(f"100 - 75 + (75 * n * {N}L) div {L}L")
    part = F.expr("(1000000000L * times) div (1000 * times + 8 * m)")
    found = each_term(index.filter("n > 0")).join(small(terms), "term").withColumn("m", length)
    blocks = 1 + N // BLOCK
    postings = found.select(
        F.expr(f"pmod(xxhash64(row), {blocks}L)").alias("block"), F.col("number").alias("term"), "row", F.coalesce("id", F.lit(int(NO_ID))).alias("id"), part.alias("part")
    )
    postings = scratch.keep(postings)
    weight = F.floor(1000 * F.log((F.lit(2.0) * N + 2) / (2 * F.col("df") + 1)))
    share = F.col("df") / F.lit(N)
    owner = F.when(share <= OWNERS[0], 0).when(share <= OWNERS[1], 1).when(share <= OWNERS[2], 2).otherwise(3)
    facts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("part").alias("largest"))
    facts = scratch.keep(facts.select(F.col("term").alias("number"), owner.alias("owner"), weight.alias("w"), "largest"))
    asked = scratch.keep(wanted.join(small(terms), "term").join(small(facts), "number"))
    # What owners after each one can add to a document at most.
    after = [F.coalesce(F.sum(F.when(F.col("owner") > o, F.col("times") * F.col("w") * F.col("largest"))), F.lit(0)).alias(f"rest{o}") for o in range(4)]
    bundled = scratch.keep(
        asked.groupBy("bundle", "item").agg(
            *[F.collect_list(F.when(F.col("owner") == o, F.struct("number", "times"))).alias(f"terms{o}") for o in range(4)], *after
        )
    )
    dealt = asked.select("bundle", F.col("number").alias("term"), "owner", "w").distinct()
    state = bundled.select("bundle", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"), "item").withColumns(
        {c: F.array().cast("array<bigint>") for c in ("docs", "ids", "scores")}
    )
    bounds, held = None, None
    for o in range(4):
        if bounds is None:
            facts_now = bundled.withColumn("threshold", F.lit(0).cast("bigint"))
        else:
            facts_now = bundled.join(small(bounds), "item", "left").fillna(0, ["threshold"])
        facts_now = facts_now.select(
            "item", F.col(f"terms{o}.number").alias("terms"), F.col(f"terms{o}.times").alias("times"), F.col(f"rest{o}").alias("rest"), "threshold"
        )
        bundles = state.join(small(facts_now), "item")
        gains = postings.join(small(dealt.filter(F.col("owner") == o)), "term").select("bundle", "block", "term", "row", "id", (F.col("w") * F.col("part")).alias("gain"))
        moved = bundles.groupBy("bundle", "block").cogroup(gains.groupBy("bundle", "block")).applyInArrow(stage(o == 3), STATE)
        moved = scratch.keep(moved)
        if held is not None:
            scratch.drop(held)
        state = held = moved
        if o < 3:
            if bounds is not None:
                scratch.drop(bounds)
            bounds = scratch.keep(tenth_best(state))
    rows = state.select("item", F.inline(F.arrays_zip(F.col("docs").alias("row"), F.col("ids").alias("id"), F.col("scores").alias("score"))))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "id", "row")).alias("rank")
    best = scratch.keep(rows.select("item", "row", "score", rank).filter(F.col("rank") <= BEST))
    names = small(scratch.keep(wanted.select("item", "item_id").distinct()))
    chosen = best.join(names, "item")
    ids = index.select("row", F.col("id").alias("doc_id"))
    return ids.join(small(chosen), "row").select("item_id", "rank", "doc_id", "score")
