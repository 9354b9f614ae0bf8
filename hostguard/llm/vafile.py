"""Centroid clustering over a vector-approximation file: few-bit cells first, full vectors only where cells leave doubt.

Vectors are whole numbers. Every component is replaced by the number of its cell, one of ``CELLS`` between quantile marks
of its dimension over all vectors (any marks give the same result, good ones decide more). For each centroid and cell a
lookup table holds the least and the greatest squared difference; summed over the dimensions they are an interval that
holds the true distance. A vector is decided when the interval of one centroid lies below all others. Only vectors whose
intervals overlap, or whose centroid changed, are fetched: a join on the row number with the full vectors, which lie
bucketed by it and do not move. Overlapping centroids are compared exactly, ties go to the smaller number. Sums are
kept per centroid and changed by the vectors that moved, so a round reads the cells of all vectors and the full
components of few. A round in which no vector moves ends the rounds: later ones could not differ.

The driver holds the centroids, their sums and the cell marks: (2 centroids + CELLS) times the dimensions, whatever the
number of rows. No step groups vectors by value, so copies of one vector are spread like any others.

Edge cases: vectors are left out if they are null, have another number of components, a null, NaN or infinite component,
or one beyond +-2^27 after scaling (their squared distance would not fit 64 bits). Repeated rows and repeated vec_id are
vectors of their own; centroids start in order of (hash, components). A null vec_id starts no centroid. Fewer vectors
than centroids start that many centroids; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostguard.llm.common import in_tasks
from hostguard.session import Scratch

DIMS = 64
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
CELLS = 16  # of four bits, two to a byte
LARGEST = 2**27
VECTORS_PER_BUCKET = 1_000_000

LOOKED = "row bigint, cells binary, old int, new int, open bigint"


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, v): components times ``scale``, rounded down, of the vectors that are kept."""
    size = F.size("embedding") == dims
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    sound = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double") * scale) <= LARGEST, F.lit(False)))
    kept = vectors.filter(F.coalesce(size & sound, F.lit(False)))
    ids = F.col("vec_id").cast("bigint").alias("vec_id")
    return kept.select(F.monotonically_increasing_id().alias("row"), ids, scaled.cast("array<int>").alias("v"))


class FullVectors:
    """The vectors in a table bucketed by row number; a join on it leaves them where they are."""

    def __init__(self, vectors: DataFrame, scratch: Scratch) -> None:
        self.spark, self.path = vectors.sparkSession, scratch.folder()
        self.name = f"full_vectors_{uuid.uuid4().hex}"
        buckets = max(1, vectors.count() // VECTORS_PER_BUCKET)
        self.spark.sql(
            f"CREATE TABLE {self.name} (row BIGINT, vec_id BIGINT, v ARRAY<INT>) USING parquet "
            f"CLUSTERED BY (row) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )
        vectors.repartition(buckets, "row").write.insertInto(self.name)
        self.rows = self.spark.table(self.name)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def first_centroids(vectors: DataFrame, count: int, salt: str) -> np.ndarray:
    """The vectors with the smallest sha256 of ``<salt>:<vec_id>``, in that order."""
    order = F.sha2(F.concat_ws(":", F.lit(salt), F.col("vec_id").cast("string")), 256)
    chosen = vectors.filter("vec_id IS NOT NULL").select(order.alias("order"), "v").orderBy("order", "v").limit(count)
    return np.array([r.v for r in chosen.collect()], np.int64).reshape(-1, DIMS)


def cell_marks(vectors: DataFrame, dims: int = DIMS) -> np.ndarray:
    """(dims, CELLS + 1): the least value, quantiles and the greatest value of each dimension over all vectors."""
    shares = F.array(*[F.lit(i / CELLS) for i in range(CELLS + 1)])
    found = vectors.agg(*[F.percentile_approx(F.get("v", F.lit(d)), shares, 500).alias(f"d{d}") for d in range(dims)]).first()
    ends = vectors.agg(
        *[F.min(F.get("v", F.lit(d))).alias(f"a{d}") for d in range(dims)], *[F.max(F.get("v", F.lit(d))).alias(f"b{d}") for d in range(dims)]
    ).first()
    marks = np.array([found[f"d{d}"] for d in range(dims)], np.int64)
    marks[:, 0], marks[:, -1] = [ends[f"a{d}"] for d in range(dims)], [ends[f"b{d}"] for d in range(dims)]
    return marks


def components(column: pa.Array, dims: int = DIMS) -> np.ndarray:
    """A list column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def to_cells(marks: np.ndarray):
    """Cells of a batch: the number of inner marks that a component reaches, two numbers to a byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = components(batch.column("v"))
            cells = np.zeros(v.shape, np.uint8)
            for d in range(v.shape[1]):
                cells[:, d] = np.searchsorted(marks[d, 1:-1], v[:, d], side="right")
            packed = cells[:, 0::2] << 4 | cells[:, 1::2]
            ends = np.arange(len(v) + 1, dtype=np.int32) * packed.shape[1]
            held = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(packed))])
            yield pa.record_batch([batch.column("row"), held], names=["row", "cells"])

    return run


def lookup_tables(marks: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, dimension, cell): the least and the greatest squared difference between centroid and cell."""
    low, high = marks[:, :-1][None], marks[:, 1:][None]
    at = centroids[:, :, None]
    outside = np.maximum(np.maximum(low - at, at - high), 0)
    across = np.maximum(np.abs(at - low), np.abs(at - high))
    return outside**2, across**2


def look(marks: np.ndarray, centroids: np.ndarray):
    """Decide vectors by their cells. ``open`` has a bit per centroid that may be nearest, ``new`` is null in doubt."""
    least, most = lookup_tables(marks, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, width = batch.num_rows, marks.shape[0] // 2
            packed = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(n, width)
            cells = np.empty((n, 2 * width), np.uint8)
            cells[:, 0::2], cells[:, 1::2] = packed >> 4, packed & 15
            lower, upper = np.zeros((len(centroids), n), np.int64), np.zeros((len(centroids), n), np.int64)
            for d in range(2 * width):
                lower += least[:, d, cells[:, d]]
                upper += most[:, d, cells[:, d]]
            candidate = lower <= upper.min(axis=0)
            new = np.where(candidate.sum(axis=0) == 1, candidate.argmax(axis=0), -1)
            bits = (candidate * (1 << np.arange(len(centroids)))[:, None]).sum(axis=0)
            columns = [batch.column("row"), batch.column("cells"), batch.column("cluster"), pa.array(new, pa.int32(), mask=new < 0), pa.array(bits, pa.int64())]
            yield pa.record_batch(columns, names=["row", "cells", "old", "new", "open"])

    return run


def nearest(centroids: np.ndarray):
    """Settle fetched vectors exactly among their open centroids; ``distance`` is the squared one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, bits = components(batch.column("v")), batch.column("open").to_numpy()
            best, at = np.full(len(v), np.iinfo(np.int64).max), np.full(len(v), -1, np.int32)
            for c, centre in enumerate(centroids):
                rows = np.flatnonzero(bits >> c & 1)
                far = ((v[rows] - centre) ** 2).sum(axis=1)
                less = far < best[rows]
                best[rows[less]], at[rows[less]] = far[less], c
            yield pa.record_batch(
                [batch.column(c) for c in ("row", "vec_id", "cells", "old")] + [pa.array(at), pa.array(best), batch.column("v")],
                names=["row", "vec_id", "cells", "old", "cluster", "distance", "v"],
            )

    return run


SETTLED = "row bigint, vec_id bigint, cells binary, old int, cluster int, distance bigint, v array<int>"


def fetch(looked: DataFrame, full: FullVectors, centroids: np.ndarray) -> DataFrame:
    """Full vectors of the rows of ``looked``, each with its nearest centroid."""
    joined = looked.select("row", "cells", "old", "open").join(full.rows, "row")
    return in_tasks(joined, nearest(centroids), SETTLED)


def sums(rows: DataFrame, signs: Column) -> DataFrame:
    """(cluster, n, s0, s1, ...): counts and component sums of ``rows`` per cluster, each row times its sign."""
    each = rows.select(F.inline(signs), "v")
    return each.groupBy("cluster").agg(
        F.sum("sign").cast("bigint").alias("n"), *[F.sum(F.col("sign") * F.get("v", F.lit(d))).alias(f"s{d}") for d in range(DIMS)]
    )


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, salt: str = "3") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per kept vector."""
    scratch = Scratch(vectors.sparkSession)
    numbered = scratch.keep(whole_vectors(vectors))
    centres = first_centroids(numbered, centroids, salt)
    marks = cell_marks(numbered) if len(centres) else np.zeros((DIMS, CELLS + 1), np.int64)
    if not len(centres):  # no vector, or none with an id to start from
        numbered = numbered.limit(0)
    full = FullVectors(numbered, scratch)
    state = scratch.keep(in_tasks(numbered.select("row", "v"), to_cells(marks), "row bigint, cells binary").withColumn("cluster", F.lit(None).cast("int")))
    scratch.drop(numbered)
    held, total, counts = [state], np.zeros(centres.shape, np.int64), np.zeros(len(centres), np.int64)
    moved_from = F.array(F.struct(F.col("cluster"), F.lit(1).alias("sign")), F.struct(F.col("old").alias("cluster"), F.lit(-1).alias("sign")))
    for _ in range(rounds if len(centres) else 0):
        looked = scratch.keep(in_tasks(state, look(marks, centres), LOOKED))
        doubtful = "new IS NULL OR NOT (new <=> old)"
        settled = fetch(looked.filter(doubtful), full, centres)
        settled = settled.withColumn("v", F.when(~F.col("cluster").eqNullSafe(F.col("old")), F.col("v"))).drop("vec_id", "distance")
        settled = scratch.keep(settled)
        found = sums(settled.filter("v IS NOT NULL"), moved_from).filter("cluster IS NOT NULL").collect()
        for r in found:  # a row per centroid
            counts[r.cluster] += r.n
            total[r.cluster] += [r[f"s{d}"] for d in range(DIMS)]
        state = looked.filter(f"NOT ({doubtful})").select("row", "cells", F.col("new").alias("cluster")).unionByName(
            settled.select("row", "cells", "cluster")
        )
        scratch.drop(*held)
        held = [looked, settled]
        if not found:
            break
        centres = np.where(counts[:, None] > 0, total // np.maximum(counts, 1)[:, None], centres)
    last = in_tasks(state, look(marks, centres), LOOKED)
    assigned = scratch.keep(fetch(last, full, centres).select("vec_id", "cluster", "distance"))
    scratch.drop(*held)
    full.close()
    scratch.drop_folder(full.path)
    return with_totals(assigned, centres)


def with_totals(assigned: DataFrame, centres: np.ndarray) -> DataFrame:
    """Inertia per cluster and over all, and the digest of each centroid."""
    each = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    rows = [(c, each.get(c, 0), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centres.tolist())]
    facts = [F.struct(F.lit(c).alias("c"), F.lit(i).cast("bigint").alias("i"), F.lit(d).alias("d")) for c, i, d in rows]
    if not facts:
        facts = [F.struct(F.lit(-1).alias("c"), F.lit(0).cast("bigint").alias("i"), F.lit("").alias("d"))]
    fact = F.element_at(F.array(*facts), F.col("cluster") + 1)
    return assigned.withColumns(
        {"cluster_inertia": fact["i"], "inertia": F.lit(sum(each.values())).cast("bigint"), "centroid_sha256": fact["d"]}
    )
