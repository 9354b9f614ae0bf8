"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostguard.llm.common import few_parts, in_tasks, small
from hostguard.session import Scratch

# So many links, or fewer, are followed in one task, which saves the rounds of jobs; the result is the same.
ONE_TASK = 200_000


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(node: int) -> int:
        above = root.setdefault(node, node)
        while above != node:
            root[node] = above = root[above]
            node, above = above, root[above]
        return node

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], ["node", "root"])


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the smallest node of the component.

    Each round every node goes to its smallest neighbour, if that is smaller, and the links are drawn anew between
    what is left. Nodes at least halve in every component, so the rounds are few; a node with very many links is one
    row per task after the partial minimum. Tables that a count shows to be small are joined by broadcast and kept in
    few files, larger ones are shuffled. At most ``ONE_TASK`` links are followed at once. Links of a node with itself
    are allowed.
    """
    links = scratch.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    count = links.count()
    if count <= ONE_TASK:
        roots = scratch.keep(in_tasks(links.coalesce(1), _follow, "node bigint, root bigint"))
        scratch.drop(links)
        return roots
    parts = few_parts(count)
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = scratch.keep(nodes.withColumn("root", F.col("node")).coalesce(parts))
    open_links = scratch.keep(links.filter("a <> b").coalesce(parts))
    scratch.drop(links)
    while not open_links.isEmpty():
        ends = open_links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        least = ends.select("e.*").groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        least = scratch.keep(least.coalesce(parts))
        # Nodes that go to a node which itself goes on follow it at once.
        onward = small(least.select(F.col("a").alias("to"), F.col("to").alias("further")))
        step = scratch.keep(least.join(onward, "to", "left").select("a", F.coalesce("further", "to").alias("to")).coalesce(parts))
        moved = roots.join(small(step.withColumnRenamed("a", "root")), "root", "left")
        new_roots = scratch.keep(moved.select("node", F.coalesce("to", "root").alias("root")).coalesce(parts))
        left = open_links.join(small(step.withColumnRenamed("to", "ra")), "a").select("ra", F.col("b").alias("a"))
        left = left.join(small(step.withColumnRenamed("to", "rb")), "a").filter("ra <> rb")
        pairs = left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        new_links = scratch.keep(pairs.coalesce(parts))
        scratch.drop(roots, open_links, least, step)
        roots, open_links = new_roots, new_links
    scratch.drop(open_links)
    return roots
