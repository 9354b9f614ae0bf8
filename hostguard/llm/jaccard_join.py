"""Texts whose word-shingle sets are close in Jaccard distance, joined in the metric space, exactly.

Texts with equal sets are one point of the space; the join is over points. It recurses through three kinds of pivots:

1. The empty set. By the triangle inequality around it two linked points differ little in size (the size window).
2. Singletons, ordered rare shingles first. Among them a point of n shingles is nearest to its own shingles, the first
   in the order wins the tie and the point lies in that pivot's Voronoi region. Linked points share so many shingles
   that a point needs to be replicated only to the first n - ceil(t n) + 1 of its pivots to meet every point linked
   to it in some region. Regions of shingles that one text has hold one point and are never made.
3. Points of a region. A region whose points are not yet known to be connected takes some as pivots and measures
   their distance to every other point of it that may link: one in another component, within the size window, and
   whose distance to the region's first pivot differs by at most 1 - t (the ring window), and such that both have
   enough shingles from the region's on (the rest window): the first shingle in the order that two points share gives a
   region of both, and what comes before it in either is not in the other. Pivots are the points with the fewest
   shingles before the region's, which the copies of a text that were changed most are nearest to. Links join
   components; pivots leave the region, as they have met everyone; the region recurses until all its points are connected.

Regions with the same points are one. Every point first joins in its largest region only, then in the others that hold
points not yet connected. A group of near copies is connected after the first turn, so its pairs are not enumerated, nor
measured once per region; only points that stay apart are measured on. Pairs are rows, dealt out by their points, and no group meets in one task. Nothing is capped: the order
of the singletons rests on a bit map and a list of fixed size, and any order gives the same links.

Edge cases: a text with one or two words has one shingle, all of them; a null text, or one without words, has none and
is linked with nothing. Rows that share a doc_id are separate rows. The component is named by its smallest doc_id; null
ids name none. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hostguard.llm.common import batches_of_rows, beside, few_parts, give_back, in_tasks, narrow, released, small, text_key
from hostguard.llm.components import components
from hostguard.llm.textarrays import MIX, mix, word_hashes
from hostguard.session import Scratch

TEXT_BYTES = 4 << 20
RANGE_BYTES = 512 << 10
FLUSH = 1_000_000
MAP_BITS = 27
HEAVY, HEAVY_LIST = 16, 1 << 19
FIRST_PIVOTS = 4


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``width`` words; fewer words are one shingle."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    width_here = min(width, len(words))
    rolled = np.zeros(len(words) - width_here + 1, dtype=np.uint64)
    for k in range(width_here):
        rolled = mix(rolled * MIX + words[k : len(words) - width_here + 1 + k] + np.uint64(k + 1))
    if width_here < width:
        rolled = mix(rolled + np.uint64(width_here))
    return np.unique(rolled)


@dataclass(frozen=True)
class Prints:
    """How shingles are cut to fingerprints of ``bits`` bits and parted into ``ranges``.

    Both follow the length of all texts: a range per ``RANGE_BYTES``, and some sixty times as many fingerprints as
    shingles, so few of those that one text has are taken for shared.
    """

    bits: int
    ranges: int

    @staticmethod
    def of(df: DataFrame) -> "Prints":
        size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = 1 << min(20, max(6, (size // RANGE_BYTES).bit_length()))
        return Prints(min(56, max(32, (size // 7).bit_length() + 6)), ranges)

    def whole(self, shingles: np.ndarray) -> np.ndarray:
        return shingles >> np.uint64(64 - self.bits)

    @property
    def low(self) -> int:
        return self.bits - (self.ranges.bit_length() - 1)

    def cut(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of each fingerprint, and the rest of it."""
        return (prints >> np.uint64(self.low)).astype(np.int64), prints & np.uint64((1 << self.low) - 1)

    @property
    def part(self) -> int:
        """Bits of the map per range."""
        return (1 << MAP_BITS) // self.ranges

    def bit(self, rest: np.ndarray) -> np.ndarray:
        return (mix(rest) & np.uint64(self.part - 1)).astype(np.int64)


def _pack(prints: np.ndarray) -> bytes:
    """Sorted distinct fingerprints as gaps of as few bytes as the widest needs; the first byte tells how many."""
    gaps = np.diff(prints, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, blob[0])
    gaps = np.zeros((len(raw), 8), np.uint8)
    gaps[:, : blob[0]] = raw
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


@dataclass(frozen=True)
class Rarity:
    """Which shingles more than one text may have, and the heaviest of them with their counts.

    The bit map has a fixed size. A shingle whose bit is not set is in one text only; the bit of such a shingle may be
    set nevertheless, the more often the more shared shingles there are, which costs time and no links.
    """

    prints: Prints
    bits: np.ndarray
    heavy: np.ndarray
    counts: np.ndarray

    def shared(self, shingles: np.ndarray) -> np.ndarray:
        at, rest = self.prints.cut(self.prints.whole(shingles))
        place = at * self.prints.part + self.prints.bit(rest)
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)

    def weight(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.heavy):
            return np.zeros(len(shingles), dtype=np.int64)
        prints = self.prints.whole(shingles)
        at = np.minimum(np.searchsorted(self.heavy, prints), len(self.heavy) - 1)
        return np.where(self.heavy[at] == prints, self.counts[at], 0)


def rarity(texts: DataFrame, width: int) -> Rarity:
    """Count the shingles of all texts by fingerprint.

    A task sends the distinct fingerprints of some millions of shingles as gaps, two or three bytes each, parted by
    range; what several texts of the task share is sent apart, with its count. Every range is merged on its own.
    """
    cut = Prints.of(texts)
    most = max(1, HEAVY_LIST // cut.ranges)

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        whole, counts = np.unique(cut.whole(np.concatenate(held)), return_counts=True)
        at, prints = cut.cut(whole)
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        rows = []
        for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(at)]):
            several = np.flatnonzero(counts[start:stop] > 1)
            rows.append((int(at[start]), _pack(prints[start:stop]), several.astype("<u4").tobytes(), counts[start:stop][several].astype("<u4").tobytes()))
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["at", "prints", "places", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches_of_rows(batches, 0, TEXT_BYTES):
            for text in batch.column(0):
                held.append(shingle_set(text.as_py(), width))
                size += len(held[-1])
                if size > FLUSH:
                    yield send(held)
                    held, size = [], 0
        if size:
            yield send(held)

    def merge(group: pa.Table) -> pa.Table:
        prints, counts = [], []
        for blob, places, several in zip(group.column("prints"), group.column("places"), group.column("counts")):
            prints.append(_unpack(blob.as_py()))
            counts.append(np.ones(len(prints[-1]), dtype=np.int64))
            counts[-1][np.frombuffer(places.as_py(), "<u4")] = np.frombuffer(several.as_py(), "<u4")
        every, weights = np.concatenate(prints), np.concatenate(counts)
        order = np.argsort(every, kind="stable")
        every, weights = every[order], weights[order]
        starts = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        every, weights = every[starts], np.add.reduceat(weights, starts)
        bits = np.zeros(cut.part, dtype=np.uint8)
        bits[cut.bit(every[weights > 1])] = 1
        heavy = np.flatnonzero(weights >= HEAVY)
        heavy = np.sort(heavy[np.argsort(-weights[heavy], kind="stable")[:most]])
        at = group.column("at")[0].as_py()
        heavy_prints = np.uint64(at << cut.low) | every[heavy]
        row = [at, np.packbits(bits, bitorder="little").tobytes(), heavy_prints.tobytes(), weights[heavy].tobytes()]
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        del prints, counts, every, weights, order
        give_back()
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["at", "bits", "heavy", "counts"])

    sent = in_tasks(texts.select("text"), released(run), "at int, prints binary, places binary, counts binary")
    merged = sent.groupBy("at").applyInArrow(merge, "at int, bits binary, heavy binary, counts binary").collect()
    bits = np.zeros((1 << MAP_BITS) // 8, dtype=np.uint8)
    for row in merged:
        bits[row.at * cut.part // 8 : (row.at + 1) * cut.part // 8] = np.frombuffer(row.bits, np.uint8)
    merged.sort(key=lambda row: row.at)
    heavy = [np.frombuffer(row.heavy, np.uint64) for row in merged]
    counts = [np.frombuffer(row["counts"], np.int64) for row in merged]
    return Rarity(cut, bits, np.concatenate(heavy or [np.zeros(0, np.uint64)]), np.concatenate(counts or [np.zeros(0, np.int64)]))


def nearest_pivots(shingles: np.ndarray, rare: Rarity, percent: int) -> tuple[np.ndarray, int]:
    """The shingles whose regions the point goes to, the rarest first, without those that no other point has.

    And how many shingles the point has without those.
    """
    n = len(shingles)
    need = n - -(-percent * n // 100) + 1
    shared = rare.shared(shingles)
    met = int(shared.sum())
    need -= n - met
    if need <= 0:
        return shingles[:0], met
    shingles = shingles[shared]
    return shingles[np.lexsort((shingles, rare.weight(shingles)))[:need]], met


def points_of(docs: DataFrame, width: int, percent: int, rare: Rarity) -> DataFrame:
    """(doc_id, text_key, n, met, sig, pivots) of every row; ``sig`` names the set, null for the empty one.

    ``met`` of the ``n`` shingles may be in other rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rare)
    names = ["doc_id", "text_key", "n", "met", "sig", "pivots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_rows(batches, 2, TEXT_BYTES):
            sets = [shingle_set(t.as_py(), width) for t in batch.column(2)]
            sigs = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            nearest = [nearest_pivots(s, shared.value, percent) if len(s) else (s, 0) for s in sets]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([met for _, met in nearest], pa.int64())]
            columns += [pa.array(sigs, pa.binary()), pa.array([p.view(np.int64) for p, _ in nearest], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(docs), F.col("text").cast("string").alias("text"))
    return in_tasks(rows, released(run), "doc_id bigint, text_key bigint, n bigint, met bigint, sig binary, pivots array<bigint>")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(point, shingles) of the ``wanted`` (point, doc_id, sig): only their documents are read again.

    A row that is repeated word for word gives its point twice.
    """
    ids = wanted.select(F.col("doc_id").alias("_id"), "point", "sig")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(small(ids), F.col("doc_id").eqNullSafe(F.col("_id"))).select("point", "sig", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_rows(batches, 2, TEXT_BYTES):
            found = []
            for point, sig, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                shingles = shingle_set(text.as_py(), width).tobytes()
                # Another row may have the same doc_id.
                if hashlib.blake2b(shingles, digest_size=16).digest() == sig:
                    found.append((point, shingles))
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["point", "shingles"])

    return in_tasks(rows, released(run), "point bigint, shingles binary")


def measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, joint): sizes of the intersection and the union of each pair (a, b)."""
    left = sets.select(F.col("point").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("point").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, joint = [], []
            for sa, sb in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared.append(int((y[at] == x).sum()))
                joint.append(len(x) + len(y) - shared[-1])
            columns = [pa.array(shared, pa.int64()), pa.array(joint, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["a", "b", "shared", "joint"])

    return in_tasks(both, released(run), "a bigint, b bigint, shared bigint, joint bigint")


def _order() -> Column:
    """Pivots are taken in this order: few shingles before the region's first, then the same in every region."""
    return F.struct((F.col("n") - F.col("rest")).alias("before"), F.xxhash64("point").alias("hash"), "point")


def _pivots(members: DataFrame, pivots_each: int, rows: int) -> DataFrame:
    """Some points of every region: from its largest component if that is large, else from outside it.

    ``members`` has region, point, n, rest, comp, ring. A pivot meets the other components only, so pivots of a component that
    holds nearly the whole region cost little, and most of what is not yet connected to it links to one of them.
    """
    members = narrow(members, rows)
    sizes = members.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("region").agg(F.max(F.struct("size", "comp")).alias("top"))
    largest = largest.select("region", F.col("top.comp").alias("main"), F.col("top.size").alias("size"))
    inside = F.col("comp") == F.col("main")
    drawn = F.when(F.col("size") > 2 * pivots_each, inside).otherwise(~inside | (F.col("size") == 1))
    nth = F.row_number().over(Window.partitionBy("region").orderBy(_order()))
    chosen = beside(members, largest, "region", "inner", rows).filter(drawn).withColumn("nth", nth).filter(F.col("nth") <= pivots_each)
    return chosen.drop("nth", "main", "size")


def _pairs(members: DataFrame, pivots: DataFrame, percent: int, most: int) -> DataFrame:
    """The distinct pairs (a, b) of a pivot and a point of its region that may link; there are at most ``most``."""
    names = {"point": "p", "n": "pn", "rest": "prest", "comp": "pc", "ring": "pr"}
    met = beside(members, pivots.select("region", *[F.col(k).alias(v) for k, v in names.items()]), "region", "inner", most)
    met = met.filter("point <> p AND comp <> pc")
    met = met.filter((F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent))
    met = met.filter(F.least("rest", "prest") * (100 + percent) >= (F.col("n") + F.col("pn")) * percent)
    apart = F.abs(F.col("ring") - F.col("pr")) > F.lit(1 - percent / 100 + 1e-9)
    met = met.filter(~F.coalesce(apart, F.lit(False)))
    return met.select(F.least("point", "p").alias("a"), F.greatest("point", "p").alias("b")).distinct()


def distinct_regions(replicas: DataFrame) -> DataFrame:
    """(region, m): regions of several points, one for each set of points: the first in the order of the shingles.

    Sets are told apart by their size and two sums of 64-bit hashes; near copies fill many regions with the same points.
    Of regions with the same points the first leaves each of them the longest rest.
    """
    names = [F.bit_xor(F.xxhash64("point", F.lit(seed))).alias(f"name{seed}") for seed in (1, 2)]
    sets = replicas.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.sum("rest").alias("room"), *names).filter("m > 1")
    return sets.groupBy("m", "name1", "name2").agg(F.max_by("region", "room").alias("region")).select("region", "m")


def join_in_turns(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """(node, root) of the points that are linked. ``members``: region, m, point, n, rest.

    First every point meets others in its largest region alone, which connects groups of near copies wherever they lie;
    then in all its regions that hold points not yet connected.
    """
    largest = members.groupBy("point").agg(F.max(F.struct("m", "region")).alias("top")).select("point", "top.region")
    largest = scratch.keep(largest)
    roots = None
    for part in (members.join(largest, ["point", "region"], "left_semi"), members):
        roots = join_regions(part.select("region", "point", "n", "rest"), sets, percent, scratch, roots)
    scratch.drop(largest)
    return roots


def unconnected(members: DataFrame, scratch: Scratch, rows: int) -> DataFrame:
    """The rows of regions whose points lie in several components; ``members`` has at most ``rows``."""
    parts, members = few_parts(rows), narrow(members, rows)
    split = members.groupBy("region").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
    if parts > 1:
        split = scratch.keep(split.coalesce(parts))
    kept = scratch.keep(beside(members, split.select("region"), "region", "left_semi", rows).coalesce(parts))
    scratch.drop(split)
    return kept


def join_regions(
    members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, roots: DataFrame | None = None
) -> DataFrame | None:
    """(node, root) of the points that are linked, those of ``roots`` included. ``members``: region, point, n, rest."""
    comp = F.col("point")
    if roots is not None:
        members = members.join(small(roots.withColumnRenamed("node", "point")), "point", "left")
        comp = F.coalesce("root", "point")
    start = scratch.keep(members.select("region", "point", "n", "rest", comp.alias("comp"), F.lit(None).cast("double").alias("ring")))
    members = unconnected(start, scratch, start.count())
    scratch.drop(start)
    pivots_each, first = FIRST_PIVOTS, True
    while rows := members.count():
        parts = few_parts(rows)
        pivots = scratch.keep(_pivots(members, pivots_each, rows).coalesce(parts))
        pairs = scratch.keep(_pairs(members, pivots, percent, rows * pivots_each))
        measured = pairs.count()
        found = scratch.keep(measure(pairs, sets).distinct().coalesce(few_parts(measured)))
        links, most = found.filter(F.col("shared") * 100 >= F.col("joint") * percent).select("a", "b"), measured
        if roots is not None:
            links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
            most += roots.count()
        new_roots = components(narrow(links, most), scratch)
        # A link has two nodes at most, and no table below has more rows than this.
        most = max(rows, 2 * most)

        rest = beside(members, pivots.select("region", "point"), ["region", "point"], "left_anti", most).drop("comp")
        if first:
            # The first pivot of each region, and everyone's distance to it where it was measured.
            anchor = narrow(pivots, most).groupBy("region").agg(F.min(_order()).alias("least"))
            anchor = anchor.select("region", F.col("least.point").alias("anchor"))
            if few_parts(most) > 1:
                anchor = scratch.keep(anchor.coalesce(parts))
            far = F.lit(1.0) - F.col("shared") / F.col("joint")
            both = F.array(F.struct(F.col("a").alias("anchor"), F.col("b").alias("point")), F.struct(F.col("b").alias("anchor"), F.col("a").alias("point")))
            known = found.select(F.explode(both).alias("both"), far.alias("far")).select("both.*", "far")
            rest = beside(rest.drop("ring"), anchor, "region", "left", most)
            rest = beside(rest, known, ["anchor", "point"], "left", most)
            rest = rest.select("region", "point", "n", "rest", F.col("far").alias("ring"))
        rest = beside(rest, new_roots.withColumnRenamed("node", "point"), "point", "left", most)
        rest = rest.select("region", "point", "n", "rest", F.coalesce("root", "point").alias("comp"), "ring")
        rest = scratch.keep(rest.coalesce(parts))
        # A region is done when its points are connected.
        new_members = unconnected(rest, scratch, rows)
        scratch.drop(members, pivots, pairs, found, rest, *([roots] if roots is not None else []))
        members, roots = new_members, new_roots
        pivots_each, first = pivots_each * 4, False
    scratch.drop(members)
    return roots


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_key, component) of every row, written out.

    Rows link when 100 * intersection >= ``percent`` * union of their sets; components follow links. ``component``
    numbers the components of several rows, it is null for a row alone; unlike component_id it is also right where rows
    share a doc_id, which ``text_key`` tells apart.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(points_of(docs, width, percent, rarity(docs, width)))
    groups = rows.filter("sig IS NOT NULL").groupBy("sig").agg(
        F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("met").alias("met"),
        F.count(F.lit(1)).alias("copies"), F.first("pivots").alias("pivots")
    )
    points = scratch.keep(groups.withColumn("point", F.monotonically_increasing_id()))
    # ``rest``: the point's shingles from the region's on, in the order.
    replicas = points.select(F.posexplode("pivots").alias("at", "region"), "point", "n", "met")
    replicas = replicas.select("region", "point", "n", (F.col("met") - F.col("at")).alias("rest"))
    shared = scratch.keep(distinct_regions(replicas))
    members = scratch.keep(replicas.join(small(shared), "region"))
    named = points.select("point", "doc_id", "sig")
    wanted = scratch.keep(named.join(small(members.select("point").distinct()), "point", "left_semi"))
    sets = scratch.keep(sets_of(docs, wanted, width))
    roots = join_in_turns(members, sets, percent, scratch)
    scratch.drop(shared, wanted, members, sets)

    named = points.select("sig", "point", "doc_id", "copies")
    if roots is None:
        roots = scratch.keep(points.select(F.col("point").alias("node"), F.col("point").alias("root")).limit(0))
    linked = named.join(roots.withColumnRenamed("node", "point"), "point")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = linked.join(least, "root").select("sig", "component_id", F.col("root").alias("component"))
    copied = named.filter("copies > 1").join(roots, F.col("point") == F.col("node"), "left_anti")
    copied = copied.select("sig", F.col("doc_id").alias("component_id"), F.col("point").alias("component"))
    component = scratch.keep(linked.unionByName(copied))
    found = rows.select("doc_id", "text_key", "n", "sig").join(small(component), "sig", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "text_key",
        "component",
    )
    found = scratch.keep(found)
    scratch.drop(rows, points, component, roots)
    return found
