"""Quality of a text by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` characters. Every passage is encoded: hashed character n-grams and a few
measures of its surface go through one layer to a vector. Gated attention, tanh(V h) * sigmoid(U h) times w, weighs the
passages of a text against each other, and a logistic unit scores the weighted vector. Only texts carry labels, so the
attention learns by itself which passages give a text away.

Training takes a bounded sample of labelled texts, encoded once, in shards: each round every shard goes on from the
common weights, and the weights are averaged. Scoring reads whole texts in one pass without a shuffle; the softmax over
passages is kept as a running maximum and two running sums, so a task holds a block of passages of one text at a time.

Edge cases: a null or empty text has no passage and scores as the share of label 1 among the learnable texts; so does
every text if only one label occurs. Without labels the score is 0.5. A document with contradicting labels, a null
label or a null id is not learned from. Rows that share a doc_id are separate rows. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostguard.llm.common import batches_of_rows, fold, in_tasks
from hostguard.llm.textarrays import MIX, code_points
from hostguard.session import Scratch

PASSAGE = 400
GRAM_BITS = 9
SURFACE = 10
WIDTH = (1 << GRAM_BITS) + SURFACE
BLOCK = 256  # passages held at once
TEXT_BYTES = 8 << 20


@dataclass(frozen=True)
class Training:
    """At most about ``sample`` labelled texts, of each at most ``passages`` passages, evenly spread, are learned from."""

    sample: int = 6000
    passages: int = 256
    shards: int = 4
    rounds: int = 5
    epochs: int = 2
    batch: int = 32
    hidden: int = 24
    gate: int = 12
    rate: float = 0.01
    decay: float = 1e-4


def _kinds() -> np.ndarray:
    """0 letter, 1 capital, 2 digit, 3 blank, 4 line end, 5 sentence mark, 6 other mark; per code point."""
    found = np.zeros(0x110000, dtype=np.uint8)
    for code in range(0x3000):
        char = chr(code)
        if char.isspace():
            found[code] = 4 if char in "\n\r" else 3
        elif char.isupper():
            found[code] = 1
        elif char.isdigit():
            found[code] = 2
        elif char in ".,;:?'\"()-":
            found[code] = 5
        elif not char.isalpha():
            found[code] = 6
    return found


KINDS = _kinds()


def passages(text: str) -> Iterator[np.ndarray]:
    """Features of the passages of a text, a block of rows at a time."""
    for start in range(0, len(text), BLOCK * PASSAGE):
        yield encode(code_points(text[start : start + BLOCK * PASSAGE]))


def encode(codes: np.ndarray) -> np.ndarray:
    """Features of consecutive passages: roots of the shares of hashed n-grams, and measures of the surface."""
    count = -(-len(codes) // PASSAGE)
    place = np.arange(len(codes)) // PASSAGE
    size = np.bincount(place, minlength=count)
    kind = KINDS[codes]
    grams = np.zeros((count, 1 << GRAM_BITS))
    # Runs of small letters are told apart by their letters, everything else mostly by its kind.
    wide = codes.astype(np.uint64)
    rolled = wide
    for order in (1, 2, 3):
        if order > 1:
            rolled = rolled[:-1] * np.uint64(0x110001) + wide[order - 1 :]
        if not len(rolled):
            break
        bucket = ((rolled + np.uint64(order)) * MIX) >> np.uint64(64 - GRAM_BITS)
        at = place[: len(rolled)] << GRAM_BITS | bucket.astype(np.int64)
        whole = place[: len(rolled)] == place[order - 1 :]
        grams += np.bincount(at[whole], minlength=count << GRAM_BITS).reshape(count, -1)
    grams = np.sqrt(grams / (3.0 * size[:, None]))

    per_kind = np.bincount(place * 8 + kind, minlength=count * 8).reshape(count, 8)[:, :7] / size[:, None]
    # Words are runs that are neither blank nor line end, cut where the passage ends.
    word = (kind != 3) & (kind != 4)
    opens = np.append(True, place[1:] != place[:-1])
    starts = np.flatnonzero(word & (opens | ~np.append(False, word[:-1])))
    stops = np.flatnonzero(word & (np.append(opens[1:], True) | ~np.append(word[1:], False))) + 1
    surface = np.zeros((count, SURFACE))
    surface[:, :7] = per_kind
    if len(starts):
        powers = _powers(len(codes) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(wide * powers[0][: len(codes)], dtype=np.uint64)])
        words = (sums[stops] - sums[starts]) * powers[1][starts]
        owner = place[starts]
        n = np.bincount(owner, minlength=count)
        key = words * MIX + owner.astype(np.uint64) * np.uint64(_BASE)
        distinct = np.bincount(owner[np.unique(key, return_index=True)[1]], minlength=count)
        same = np.zeros(len(words))
        same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        some = np.maximum(n, 1)
        surface[:, 7] = 1.0 - distinct / some
        surface[:, 8] = np.bincount(owner, weights=same, minlength=count) / some
        surface[:, 9] = np.minimum(size / some / 20.0, 1.0)
    return np.concatenate([grams * 4.0, surface * 4.0], axis=1).astype(np.float32)


_BASE = 0x2545F4914F6CDD1D
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    held = _POWERS.get(0)
    if held is None or len(held[0]) < size:
        size = max(size, BLOCK * PASSAGE + 1)
        back = pow(_BASE, -1, 1 << 64)
        held = tuple(
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, dtype=np.uint64)]), dtype=np.uint64) for b in (_BASE, back)
        )
        _POWERS[0] = held
    return held


def initial(how: Training, seed: int = 7) -> dict[str, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(seed))
    normal = lambda *shape: draw.standard_normal(shape) / np.sqrt(shape[0])
    return {
        "W": normal(WIDTH, how.hidden),
        "b": np.zeros(how.hidden),
        "V": normal(how.hidden, how.gate),
        "U": normal(how.hidden, how.gate),
        "w": normal(how.gate),
        "c": normal(how.hidden),
        "d": np.zeros(1),
    }


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def hidden(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each passage and its attention before the softmax."""
    h = np.maximum(x @ p["W"] + p["b"], 0.0)
    return h, (np.tanh(h @ p["V"]) * sigmoid(h @ p["U"])) @ p["w"]


def gradients(p: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss over bags; bag i is the rows of ``x`` from ``starts[i]`` on."""
    bag = np.zeros(len(x), dtype=np.int64)
    bag[starts[1:]] = 1
    bag = np.cumsum(bag)
    pre = x @ p["W"] + p["b"]
    h = np.maximum(pre, 0.0)
    t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    e = (t * s) @ p["w"]
    a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a /= np.add.reduceat(a, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts)
    wrong = (sigmoid(z @ p["c"] + p["d"]) - labels) / len(labels)
    dz = wrong[:, None] * p["c"]
    da = (dz[bag] * h).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, starts)[bag])
    dt = de[:, None] * p["w"] * s * (1 - t**2)
    ds = de[:, None] * p["w"] * t * s * (1 - s)
    dh = (a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T) * (pre > 0)
    return {
        "W": x.T @ dh,
        "b": dh.sum(axis=0),
        "V": h.T @ dt,
        "U": h.T @ ds,
        "w": (t * s).T @ de,
        "c": z.T @ wrong,
        "d": np.array([wrong.sum()]),
    }


def learn(p: dict[str, np.ndarray], bags: list[tuple[int, np.ndarray]], how: Training, seed: int) -> dict[str, np.ndarray]:
    """``how.epochs`` passes of Adam over (label, passages)."""
    p = {k: v.copy() for k, v in p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    draw, step = np.random.Generator(np.random.PCG64(seed)), 0
    for _ in range(how.epochs):
        order = draw.permutation(len(bags))
        for at in range(0, len(order), how.batch):
            chosen = [bags[i] for i in order[at : at + how.batch]]
            starts = np.cumsum([0, *[len(b[1]) for b in chosen[:-1]]])
            x = np.concatenate([b[1] for b in chosen]).astype(np.float64)
            g = gradients(p, x, starts, np.array([b[0] for b in chosen], dtype=float))
            step += 1
            for k in p:
                grad = g[k] + how.decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                p[k] -= how.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return p


@dataclass(frozen=True)
class Model:
    """``weights`` is None if the score is ``prior`` for every text."""

    weights: dict[str, np.ndarray] | None
    prior: float

    def score(self, text: str | None) -> float:
        if not text or self.weights is None:
            return self.prior
        p, top, mass, pooled = self.weights, -np.inf, 0.0, 0.0
        for x in passages(text):
            h, e = hidden(p, x)
            higher = max(top, float(e.max()))
            a, old = np.exp(e - higher), np.exp(top - higher)
            mass, pooled, top = mass * old + a.sum(), pooled * old + a @ h, higher
        return float(sigmoid(pooled / mass @ p["c"] + p["d"])[0])


def learnable_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label): documents outside fold 1 of 3 with one clear quality."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold("doc_id", 3) != 1))
    agreed = known.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most"))
    return agreed.filter("label = most").drop("most")


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, how: Training = Training()) -> Model:
    """Learn from (doc_id, text) and (doc_id, quality)."""
    known = scratch.keep(learnable_labels(labels))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return Model(None, 0.5)
    prior = counts.get(1, 0) / total
    steps = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id")), F.lit(steps))
    chosen = known.filter(draw < int(min(1.0, how.sample / total) * steps))
    # The sample is bounded by ``how.sample``, so it is broadcast and the texts stay where they are.
    rows = docs.select("doc_id", "text").filter("text <> ''").join(F.broadcast(chosen), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_rows(batches, 1, TEXT_BYTES):
            packed = []
            for text in batch.column(1).to_pylist():
                x = np.concatenate(list(passages(text)))
                if len(x) > how.passages:
                    x = x[np.linspace(0, len(x) - 1, how.passages).astype(int)]
                packed.append(x.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], ["doc_id", "label", "bag"])

    sample = scratch.keep(in_tasks(rows, measure, "doc_id bigint, label int, bag binary"))
    if len(counts) < 2 or sample.select("label").distinct().count() < 2:
        return Model(None, prior)
    shards = sample.repartition(how.shards, "doc_id")
    weights = initial(how)
    for round_ in range(how.rounds):
        start = sample.sparkSession.sparkContext.broadcast(weights)

        def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bags = []
            for batch in batches:
                for row in batch.to_pylist():
                    bags.append((row["doc_id"], row["label"], np.frombuffer(row["bag"], np.float16).reshape(-1, WIDTH)))
            if bags:
                bags.sort(key=lambda b: (b[0], len(b[2])))
                learned = learn(start.value, [b[1:] for b in bags], how, round_)
                flat = np.concatenate([learned[k].ravel() for k in sorted(learned)])
                yield pa.RecordBatch.from_arrays([pa.array([len(bags)]), pa.array([flat.tobytes()])], ["n", "flat"])

        found = in_tasks(shards, go_on, "n bigint, flat binary").collect()
        flat = sum(np.frombuffer(r.flat) * r.n for r in found) / sum(r.n for r in found)
        cuts = np.cumsum([weights[k].size for k in sorted(weights)])[:-1]
        weights = {k: part.reshape(weights[k].shape) for k, part in zip(sorted(weights), np.split(flat, cuts))}
        start.unpersist()
    scratch.drop(sample, known)
    return Model({k: v.astype(np.float32) for k, v in weights.items()}, prior)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, score, predicted) of every row."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_rows(batches, len(keep), TEXT_BYTES):
            scores = [shared.value.score(t.as_py()) for t in batch.column(len(keep))]
            columns = [batch.column(i) for i in range(len(keep))]
            predicted = pa.array([int(s >= 0.5) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), predicted], [*keep, "score", "predicted"])

    return in_tasks(rows, run, ", ".join([*([kinds] if kinds else []), "score double, predicted int"]))


def classify(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    """Train and score all of ``docs``: doc_id, held_out (fold 1 of 3), score, predicted."""
    model = train(docs, labels, Scratch(docs.sparkSession), how)
    return predict(docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text"), model, ("doc_id", "held_out"))
