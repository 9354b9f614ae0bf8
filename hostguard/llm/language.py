"""Language of a text: sparse multinomial logistic regression on TF-IDF letter n-grams.

Features are hashed n-grams of one to three letters: their share in the text times the inverse document frequency,
which is counted over every learnable text. Weights are learned by follow-the-regularised-leader with elastic-net
penalties on a bounded sample per language, in shards: each round, every shard goes on from the common state and the
states are averaged, their changes summed bucket by bucket in the cluster. A part of the sample is held back to fit one temperature, which turns scores into probabilities.

Model and counts are bounded by ``BUCKETS`` times the number of languages. Scoring is one pass without a shuffle.

Edge cases: a null text, and one without letters, is ``und`` with score 0; so is every text if nothing can be learned.
With one language every other text gets it, with score 1. Of languages with equal scores the first by name is given.
Rows without a label, and rows of fold 1 of 3, are not learned from. Rows that share a doc_id are separate rows. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostguard.llm.common import batches_of_rows, fold, in_tasks
from hostguard.llm.textarrays import letter_grams
from hostguard.session import Scratch

BITS, ORDERS = 16, 3
BUCKETS = 1 << BITS
SCALE = 30.0
UNKNOWN = "und"
TEXT_BYTES = 8 << 20
WIDTH = 16


@dataclass(frozen=True)
class Training:
    """At most about ``per_language`` rows of each language are learned from; the rest as usual for FTRL."""

    per_language: int = 1500
    shards: int = 4
    rounds: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.01


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # per bucket and language, times the inverse document frequency
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray | None:
        """Scores before the temperature; None without letters."""
        total, count = np.zeros(len(self.languages)), 0
        for grams in letter_grams(text, ORDERS, BITS):
            total += self.weights[grams].sum(axis=0)
            count += len(grams)
        return total * (SCALE / count) + self.bias if count and has_letter(text) else None


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their TF-IDF."""
    counts = np.zeros(BUCKETS)
    for grams in letter_grams(text, ORDERS, BITS):
        counts += np.bincount(grams, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found.astype(np.int32), (counts[found] / max(1.0, counts.sum()) * SCALE * idf[found]).astype(np.float32)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of ``texts`` each bucket occurs, and how many texts there are. One row per bucket and task moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(BUCKETS + 1, dtype=np.int64), 0
        seen = np.zeros(BUCKETS, dtype=bool)
        for batch in batches:
            for text in batch.column(0):
                for grams in letter_grams(text.as_py() or "", ORDERS, BITS):
                    seen[grams] = True
                found = np.flatnonzero(seen)
                held[found] += 1
                seen[found] = False
                rows += 1
        held[BUCKETS] = rows
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(held[found], pa.int64())], ["bucket", "n"])

    counted = in_tasks(texts.select("text"), run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    held = np.zeros(BUCKETS + 1, dtype=np.int64)
    for row in counted.collect():
        held[row.bucket] = row.n
    return held[:BUCKETS], int(held[BUCKETS])


def softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return shifted / shifted.sum(axis=-1, keepdims=True)


def proximal(z: np.ndarray, n: np.ndarray, how: Training) -> np.ndarray:
    """Weights of the follow-the-regularised-leader state: zero unless the summed gradient beats the L1 penalty."""
    shrunk = np.sign(z) * np.maximum(np.abs(z) - how.l1, 0.0)
    return -shrunk / ((how.beta + np.sqrt(n)) / how.alpha + how.l2)


def learn(rows: list[tuple[int, np.ndarray, np.ndarray]], z: np.ndarray, n: np.ndarray, how: Training) -> None:
    """One pass over (language, buckets, values); the last bucket of the state is the bias. Changes ``z`` and ``n``."""
    for language, buckets, values in rows:
        at = np.append(buckets, BUCKETS)
        value = np.append(values, 1.0)
        old = n[at]
        weights = proximal(z[at], old, how)
        wrong = softmax(value @ weights)
        wrong[language] -= 1.0
        gradient = value[:, None] * wrong[None, :]
        new = old + gradient**2
        z[at] += gradient - (np.sqrt(new) - np.sqrt(old)) / how.alpha * weights
        n[at] = new


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the greatest likelihood, by golden section over its logarithm."""

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).mean()

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, scratch: Scratch, how: Training = Training()) -> Model | None:
    """Learn from (doc_id, text, lang) rows outside fold 1 of 3; None if there is no labelled text."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 3) != 1))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    frequency, total = document_frequencies(known)
    idf = np.log((1.0 + total) / (1.0 + frequency)) + 1.0

    steps = 1 << 30
    share = F.lit(0)
    for language in languages:
        part = min(1.0, how.per_language / counts[language])
        share = F.when(F.col("lang") == language, int(part * steps)).otherwise(share)
    # Drawn by id and text, equal rows once: many rows of one id neither all come in nor all stay out.
    known = known.withColumn("_draw", F.xxhash64(F.lit("language"), F.col("doc_id"), F.col("text")))
    chosen = known.filter(F.pmod("_draw", F.lit(steps)) < share).dropDuplicates(["doc_id", "lang", "_draw"])
    if chosen.isEmpty():
        chosen = known.dropDuplicates(["doc_id", "lang", "_draw"]).orderBy("_draw").limit(how.per_language)
    draw = F.col("_draw")
    place = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")) - 1
    chosen = chosen.select(
        place.cast("int").alias("language"), "text", F.pmod(F.shiftright(draw, 32), F.lit(10)).alias("part"), F.col("doc_id").cast("bigint").alias("doc_id")
    )
    names = ["language", "part", "doc_id", "buckets", "values"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_rows(batches, 1, TEXT_BYTES):
            rows = [features(t, idf) for t in batch.column(1).to_pylist()]
            packed = [pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *packed], names)

    sample = scratch.keep(
        in_tasks(chosen, measure, "language int, part bigint, doc_id bigint, buckets binary, values binary")
    )
    # The first tenth is held back for the temperature, if there is anything besides it.
    learnable = sample.filter("part > 0")
    if learnable.isEmpty():
        learnable = sample
    learnable = learnable.repartition(how.shards, "doc_id")
    shape = (BUCKETS + 1, len(languages))
    z, n = np.zeros(shape), np.zeros(shape)

    def unpack(batches: Iterator[pa.RecordBatch]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        rows = []
        for batch in batches:
            for row in batch.to_pylist():
                rows.append((row["doc_id"] or 0, row["language"], np.frombuffer(row["buckets"], np.int32), np.frombuffer(row["values"], np.float32)))
        # The same order however the rows arrive; neighbours by hash are of mixed languages.
        rows.sort(key=lambda r: ((r[0] * 0x9E3779B1) & 0xFFFFFFFF, r[0], r[1]))
        return [r[1:] for r in rows]

    every = learnable.count()
    # Languages side by side in a row of the summed changes; a state of many languages takes several rows a bucket.
    width = min(WIDTH, len(languages))
    blocks = -(-len(languages) // width)
    fields = [f"{kind}{i}" for kind in "zn" for i in range(width)]

    def by_slot(change: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(change), blocks * width))
        padded[:, : len(languages)] = change
        return padded.reshape(-1, width)

    for _ in range(how.rounds):
        start = sample.sparkSession.sparkContext.broadcast((z, n))

        def pass_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = unpack(batches)
            if rows:
                own_z, own_n = start.value[0].copy(), start.value[1].copy()
                learn(rows, own_z, own_n, how)
                touched = np.unique(np.concatenate([*[r[1] for r in rows], [BUCKETS]]))
                slots = (touched[:, None] * blocks + np.arange(blocks)).ravel()
                changes = [by_slot((own - old)[touched] * len(rows)) for own, old in zip((own_z, own_n), start.value)]
                columns = [pa.array(column) for change in changes for column in change.T]
                yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), *columns], ["slot", *fields])

        moved = in_tasks(learnable.select("language", "doc_id", "buckets", "values"), pass_over, "slot bigint, " + ", ".join(f"{f} double" for f in fields))
        # The changes of all shards are summed in the cluster: what comes here is one state, however many shards there are.
        summed = moved.groupBy("slot").agg(*[F.sum(f).alias(f) for f in fields]).toArrow()
        buckets, block = np.divmod(summed.column("slot").to_numpy(), blocks)
        for i, field in enumerate(fields):
            state, language = (z, n)[i // width], block * width + i % width
            real = language < len(languages)
            state[buckets[real], language[real]] += summed.column(field).to_numpy()[real] / every
        start.unpersist()

    weights = proximal(z, n, how)
    raw = Model(languages, (weights[:-1] * idf[:, None]).astype(np.float32), weights[-1], 1.0)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = unpack(batches)
        logits = [(values @ weights[buckets] + weights[-1]).tolist() for _, buckets, values in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array(logits, pa.list_(pa.float64()))], ["language", "logits"])

    held = in_tasks(sample.filter("part = 0").select("language", "doc_id", "buckets", "values"), judge, "language int, logits array<double>").collect()
    scratch.drop(sample)
    fitted = temperature(np.array([r.logits for r in held]), np.array([r.language for r in held])) if held and len(languages) > 1 else 1.0
    return Model(raw.languages, raw.weights, raw.bias, fitted)


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, lang_pred, score) of every row."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches_of_rows(batches, len(keep), TEXT_BYTES):
            names, scores = [], []
            for text in batch.column(len(keep)):
                logits = model.logits(text.as_py() or "") if model else None
                if logits is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    p = softmax(logits / model.temperature)
                    names.append(model.languages[int(p.argmax())])
                    scores.append(float(p.max()))
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores)], [*keep, "lang_pred", "score"])

    return in_tasks(rows, run, ", ".join([*([kinds] if kinds else []), "lang_pred string, score double"]))


def identify(docs: DataFrame, how: Training = Training()) -> DataFrame:
    """Train on ``docs`` and predict all of them: doc_id, held_out (fold 1 of 3), lang_pred, score."""
    model = train(docs, Scratch(docs.sparkSession), how)
    rows = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text")
    return predict(rows, model, ("doc_id", "held_out"))
