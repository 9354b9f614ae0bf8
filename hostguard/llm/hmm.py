"""A hidden Markov language model over words, and the exact likelihood of every text.

Words are counted over all learnable texts, and each has emissions of its own in every state. Those of the most
frequent words, at most ``CORE``, and the end are bounded and broadcast. Those of all other words are a table: a text
gets the vectors of its distinct rare words by a join, and their expected counts go back as a grouped sum. Where a word
is kept makes no difference to its emissions. A word that was not learnt has the mass that smoothing leaves to the words
of its ending (one of ``GROUPS``, by the last three bytes), by state as the learnt words of that ending.

Training is Baum-Welch. In each pass every task runs forward and backward over its sequences and sends its expected
counts by class and by rare word, which are added up across partitions. Some passes over a share of the texts break
the symmetry between states; the last passes run over every learnable text. Texts are never cut: the pieces in which
long ones are worked on carry the chances on from piece to piece. The vectors of rare words travel as 32-bit floats.

The base score adds log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens of a text: its words, then one end.

Edge cases: a null text counts as empty: one token, the end. Without anything to learn from all scores are those of
the smoothing alone. Rows that share a doc_id are separate rows. A text of any length is scored whole, by one task.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostguard.llm.common import BROADCAST_ROWS, batches_of_rows, few_parts, fold, in_tasks
from hostguard.session import Scratch

GROUPS, END = 1024, 1024
CLASSES = 1 << 16
CORE = CLASSES - GROUPS - 1
SMOOTH = 0.1
SEGMENT = 256
LONG = 4 * SEGMENT
ROOM = 512 * SEGMENT
TEXT_BYTES = 8 << 20
FLUSH = 300_000


@dataclass(frozen=True)
class Training:
    """``states`` states; ``first`` passes over ``share`` of the texts, then ``passes`` over all of them.

    Of a small table the share is larger: about ``sample`` texts.
    """

    states: int = 8
    share: float = 0.02
    sample: int = 2000
    first: int = 8
    passes: int = 2
    prior: float = 1000.0
    stay: float = 0.9


def tokens(text: str | None) -> list[bytes]:
    """The words of a text after lower-casing A-Z; the end is not among them."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c): every word of column ``text``, counted per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches_of_rows(batches, 0, TEXT_BYTES):
            for text in batch.column(0):
                held.update(tokens(text.as_py()))
            if len(held) > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "c"])
                held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "c"])

    return in_tasks(texts, run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Lexicon:
    """What every task knows of the counts: the frequent words' classes, and totals."""

    core: dict[bytes, int]
    log_count: np.ndarray  # per class: log10(c + 0.1) of a frequent word and of the end, 0 for groups
    class_count: np.ndarray  # of a group: the tokens of its rare words
    core_group: np.ndarray  # the group of each frequent word's ending
    total: int
    distinct: int
    ends: int


def group_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % GROUPS


def build_lexicon(counts: DataFrame, learnable: int) -> tuple[Lexicon, DataFrame]:
    """The lexicon, and the counts of the words that are not in its core.

    The core is cut at a step of the counts' histogram, so that nothing is sorted and it stays below ``CORE`` words.
    """
    step = F.floor(F.log2(F.col("c")) * 32).cast("int")
    histogram = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("c").alias("c")).collect()
    least, words = None, 0
    for row in sorted(histogram, key=lambda r: -r.step):
        if words + row.words > CORE:
            break
        least, words = row.step, words + row.words
    in_core = step >= (least if least is not None else 1 << 20)
    found = sorted((r.word, r.c) for r in counts.filter(in_core).collect())
    rare = counts.filter(~in_core)
    group = (F.crc32(F.substring("word", -3, 3)) % GROUPS).cast("int")
    groups = rare.groupBy(group.alias("group")).agg(F.sum("c").alias("c")).collect()
    class_count = np.zeros(CLASSES)
    for row in groups:
        class_count[row.group] = row.c
    log_count = np.zeros(CLASSES)
    log_count[END], class_count[END] = math.log10(learnable + SMOOTH), learnable
    core = {}
    for at, (word, c) in enumerate(found, END + 1):
        core[bytes(word)] = at
        log_count[at], class_count[at] = math.log10(c + SMOOTH), c
    core_group = np.array([group_of(word) for word in core], dtype=np.int64)
    total = sum(r.c for r in histogram) + learnable
    distinct = sum(r.words for r in histogram) + (learnable > 0)
    return Lexicon(core, log_count, class_count, core_group, total, distinct, learnable), rare


def encode(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Texts as classes: (row, doc_id, held_out, n_tokens, known, log_counts, classes, places, rare).

    ``known`` and ``log_counts`` cover the frequent words and the end. ``rare`` lists each rare word of the text, in the
    order of first occurrence, with how often it occurs; where ``classes`` has a group, ``places`` says which it is.
    """
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
    fields = [("n_tokens", pa.int64()), ("known", pa.int64()), ("log_counts", pa.float64())]
    fields += [("classes", pa.binary()), ("places", pa.binary()), ("rare", rare_type)]

    def one(text: str | None, lex: Lexicon) -> tuple:
        words = tokens(text)
        classes = np.fromiter(map(lex.core.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        at = np.flatnonzero(classes < 0)
        found = [words[i] for i in at.tolist()]
        rare = Counter(found)
        place = {word: i for i, word in enumerate(rare)}
        places = np.fromiter(map(place.get, found), dtype="<u4", count=len(found))
        classes[at] = np.array([group_of(word) for word in rare], dtype=np.int64)[places]
        known = len(words) - len(at) + (lex.ends > 0)
        classes = np.append(classes, END)
        return (
            len(words) + 1,
            known,
            float(lex.log_count[classes].sum()),
            classes.astype("<u2").tobytes(),
            places.tobytes(),
            [{"word": w, "n": n} for w, n in rare.items()],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for batch in batches_of_rows(batches, 3, TEXT_BYTES):
            made = [one(t.as_py(), lex) for t in batch.column(3)]
            columns = [pa.array([m[i] for m in made], kind) for i, (_, kind) in enumerate(fields)]
            names = ["row", "doc_id", "held_out", *[n for n, _ in fields]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], names)

    schema = (
        "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, log_counts double, "
        "classes binary, places binary, rare array<struct<word:binary,n:int>>"
    )
    return in_tasks(rows.select("row", "doc_id", "held_out", "text"), run, schema)


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # per class and state
    weight: np.ndarray | None = None  # per state: what a count of a rare word and its prior are multiplied by


@dataclass(frozen=True)
class Piece:
    """A stretch of a text: the state's chances before its first word, what follows its last, the piece before."""

    classes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    before: np.ndarray | None = None  # chances of the state of the last word before; None at the start of a text


def carried(model: Model, texts: list[np.ndarray]) -> list[Piece]:
    """Long texts as pieces of ``SEGMENT`` tokens that know what lies before and behind them, exactly.

    What a piece does to any chances is a matrix; those of all pieces are found side by side, and only their product
    goes through a text piece by piece, forward for what lies before and backward for what lies behind.
    """
    cuts = [[text[at : at + SEGMENT] for at in range(0, len(text), SEGMENT)] for text in texts]
    flat = sorted(((len(part), i, j) for i, parts in enumerate(cuts) for j, part in enumerate(parts)), reverse=True)
    states = len(model.start)
    classes = np.zeros((SEGMENT, len(flat)), dtype=np.int64)
    for at, (length, i, j) in enumerate(flat):
        classes[:length, at] = cuts[i][j]
    lengths = np.array([length for length, _, _ in flat])
    through = np.broadcast_to(np.eye(states), (len(flat), states, states)).copy()
    for t in range(SEGMENT):
        n = int((lengths > t).sum())
        if t:
            through[:n] = through[:n] @ model.move
        through[:n] *= model.emit[classes[t, :n]][:, None, :]
        through[:n] /= through[:n].max(axis=(1, 2), keepdims=True)
    matrix = {(i, j): through[at] for at, (_, i, j) in enumerate(flat)}
    found = []
    for i, parts in enumerate(cuts):
        ends, behind = [], np.ones(states)
        for j in range(len(parts) - 1, -1, -1):
            ends.append(model.move @ behind)
            behind = matrix[i, j] @ ends[-1]
            behind /= behind.max()
        start, before = model.start, None
        for j, part in enumerate(parts):
            found.append(Piece(part, start, ends[len(parts) - 1 - j], before))
            before = start @ matrix[i, j]
            before /= before.sum()
            start = before @ model.move
    return found


def expected(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Counts of classes by state, of moves and of first states, and the log likelihood: one forward-backward pass.

    Texts are whole: those of more than ``LONG`` tokens as pieces side by side, ``ROOM`` tokens at a time.
    """
    states = len(model.start)
    pieces = [Piece(text, model.start, np.ones(states)) for text in texts if len(text) <= LONG]
    pieces += carried(model, [text for text in texts if len(text) > LONG])
    pieces.sort(key=lambda piece: -len(piece.classes))
    totals = [np.zeros((len(model.emit), states)), np.zeros((states, states)), np.zeros(states), 0.0]
    at = 0
    while at < len(pieces):
        many = max(1, ROOM // len(pieces[at].classes))
        found = _expected_side_by_side(model, pieces[at : at + many])
        totals = [total + part for total, part in zip(totals, found)]
        at += many
    return tuple(totals)


def _expected_side_by_side(model: Model, pieces: list[Piece]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """All pieces advance together, the longest first, so those that have ended are always at the end."""
    states, longest, count = len(model.start), len(pieces[0].classes), len(pieces)
    lengths = np.array([len(piece.classes) for piece in pieces])
    active = (lengths[None, :] > np.arange(longest)[:, None]).sum(axis=1)
    classes = np.zeros((longest, count), dtype=np.int64)
    for i, piece in enumerate(pieces):
        classes[: len(piece.classes), i] = piece.classes
    starts, ends = np.stack([piece.start for piece in pieces]), np.stack([piece.end for piece in pieces])
    emitted = model.emit[classes]
    alpha, beta = np.zeros((longest, count, states)), np.zeros((longest, count, states))
    scale = np.ones((longest, count))
    before = None
    for t in range(longest):
        n = active[t]
        now = (starts if before is None else before[:n] @ model.move) * emitted[t, :n]
        scale[t, :n] = now.sum(axis=1)
        before = alpha[t, :n] = now / scale[t, :n, None]
    ahead = np.zeros((longest, count, states))
    after = 0
    for t in range(longest - 1, -1, -1):
        n = active[t]
        last = alpha[t, after:n]
        beta[t, after:n] = ends[after:n] / (last * ends[after:n]).sum(axis=1, keepdims=True)
        if after:
            beta[t, :after] = ahead[t + 1, :after] @ model.move.T
        ahead[t, :n] = emitted[t, :n] * beta[t, :n] / scale[t, :n, None]
        after = n
    gamma = alpha * beta
    within = alpha[:-1].reshape(-1, states).T @ ahead[1:].reshape(-1, states)
    begins = np.array([piece.before is None for piece in pieces])
    across = [(piece.before, ahead[0, i]) for i, piece in enumerate(pieces) if piece.before is not None]
    if across:
        within += np.stack([a for a, _ in across]).T @ np.stack([b for _, b in across])
    flat = classes.ravel()
    by_class = np.stack([np.bincount(flat, gamma[:, :, k].ravel(), len(model.emit)) for k in range(states)], axis=1)
    return by_class, model.move * within, gamma[0, begins].sum(axis=0), float(np.log(scale).sum())


def emissions(known: DataFrame, sums: DataFrame | None, model: Model, lexicon: Lexicon, how: Training) -> DataFrame:
    """(word, c, vector): the emissions of the rare words ``known`` (word, c) by state, from their expected counts."""
    names = [f"c{k}" for k in range(how.states)]
    zero = F.lit(0.0)
    if sums is None:
        met = known.select("word", "c", *[zero.alias(n) for n in names])
    else:
        met = known.join(sums, "word", "left").select("word", "c", *[F.coalesce(n, zero).alias(n) for n in names])
    weight, share = model.weight, how.prior / (lexicon.total + SMOOTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, batch.num_columns)], axis=1)
            prior = batch.column(1).to_numpy(zero_copy_only=False) * share
            vectors = ((counts + prior[:, None]) * weight).astype("<f4")
            packed = pa.array([v.tobytes() for v in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["word", "c", "vector"])

    return in_tasks(met, run, "word binary, c bigint, vector binary")


def dressed(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """``texts`` with the vectors of their learnt rare words as ``own``, these words' logarithms and their tokens."""
    slots = texts.select("row", F.posexplode("rare").alias("slot", "r")).select("row", "slot", "r.word", "r.n")
    met = slots.join(vectors, "word").groupBy("row").agg(
        F.collect_list(F.struct("slot", "vector")).alias("own"),
        F.sum(F.col("n") * F.log10(F.col("c") + F.lit(SMOOTH))).alias("rare_log"),
        F.sum("n").alias("rare_known"),
    )
    return texts.join(met, "row", "left")


def own_classes(classes: pa.Array, places: pa.Array, own: pa.Array, states: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(texts, vectors, groups) of a batch: from ``CLASSES`` on, each learnt rare word of each text is a class of its own.

    ``vectors`` has the emissions of these classes and ``groups`` the groups of their endings.
    """
    wholes = [np.frombuffer(c.as_py(), dtype="<u2").astype(np.int64) for c in classes]
    at_places = [np.frombuffer(p.as_py(), dtype="<u4").astype(np.int64) for p in places]
    starts = np.cumsum([0] + [int(p.max()) + 1 if len(p) else 0 for p in at_places])
    vectors, groups = np.full((starts[-1], states), np.nan), np.zeros(starts[-1], dtype=np.int64)
    flat = own.flatten()
    if len(flat):
        of = np.repeat(np.arange(len(own)), pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False))
        found = np.frombuffer(b"".join(flat.field(1).to_pylist()), dtype="<f4").reshape(-1, states)
        vectors[starts[of] + flat.field(0).to_numpy(zero_copy_only=False)] = found
    for whole, place, start in zip(wholes, at_places, starts):
        at = np.flatnonzero(whole < GROUPS)
        groups[start + place] = whole[at]
        learnt = ~np.isnan(vectors[start + place, 0])
        whole[at[learnt]] = CLASSES + start + place[learnt]
    return wholes, np.nan_to_num(vectors), groups


def maximise(counts: tuple[np.ndarray, np.ndarray, np.ndarray], lexicon: Lexicon, how: Training) -> Model:
    """The model of the summed counts; emissions are drawn to the words' overall shares by ``how.prior`` tokens.

    What was not learnt has ``SMOOTH`` tokens per group, dealt out in each state as the learnt words by their endings.
    """
    by_class, moves, first = counts
    base = lexicon.class_count / (lexicon.total + SMOOTH)
    base[END] = (lexicon.ends + SMOOTH) / (lexicon.total + SMOOTH)
    unknown = GROUPS * SMOOTH / (lexicon.total + SMOOTH * (GROUPS + 1))
    weight = 1.0 / (by_class.sum(axis=0) + how.prior)
    emit = (by_class + how.prior * base[:, None]) * weight
    endings, overall = emit[:GROUPS].copy(), base[:GROUPS].copy()
    core = slice(END + 1, END + 1 + len(lexicon.core_group))
    np.add.at(endings, lexicon.core_group, emit[core])
    np.add.at(overall, lexicon.core_group, base[core])
    ratio = np.where(overall[:, None] > 0, endings / np.maximum(overall, 1e-300)[:, None], 1.0)
    emit *= 1.0 - unknown
    emit[:GROUPS] = unknown * ratio / ratio.sum(axis=0)
    move = (moves + 1.0) / (moves + 1.0).sum(axis=1, keepdims=True)
    start = (first + 1.0) / (first + 1.0).sum()
    return Model(start, move, emit, weight * (1.0 - unknown))


def expectation(texts: DataFrame, model: Model | None, states: int) -> DataFrame:
    """Expected counts over ``texts`` (row, classes, places, words, own): (class, word, c0, c1, ...), added up.

    Rare words have a null class; classes from ``CLASSES`` on are the moves from each state and then the first states.
    Without a model each text is given to one state by its row, which sets the states apart to begin with.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)
    names = [f"c{k}" for k in range(states)]

    def as_rows(classes: np.ndarray | None, words: pa.Array | None, counts: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(counts), pa.int32() if classes is None else pa.binary())
        keys = [none, words] if classes is None else [pa.array(classes, pa.int32()), none]
        return pa.RecordBatch.from_arrays([*keys, *[pa.array(counts[:, k]) for k in range(states)]], ["class", "word", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_class, moves, first = np.zeros((CLASSES, states)), np.zeros((states, states)), np.zeros(states)
        for batch in batches_of_rows(batches, 1, TEXT_BYTES):
            words = batch.column(3).flatten().cast(pa.binary())
            if shared.value is None:
                rare = [np.zeros((0, states))]
                for row, blob, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    state = (row * 0x9E3779B1 >> 12) % states
                    by_class[:, state] += np.bincount(np.frombuffer(blob.as_py(), dtype="<u2"), minlength=CLASSES)
                    first[state] += 1
                    times = np.bincount(np.frombuffer(places.as_py(), dtype="<u4").astype(np.int64))
                    rare.append(np.zeros((len(times), states)))
                    rare[-1][:, state] = times
                counts = np.concatenate(rare)
            else:
                wholes, vectors, groups = own_classes(batch.column(1), batch.column(2), batch.column(4), states)
                local = replace(shared.value, emit=np.concatenate([shared.value.emit, vectors]))
                sums = np.zeros((len(local.emit), states))
                for total, part in zip((sums, moves, first), expected(local, wholes)):
                    total += part
                counts = sums[CLASSES:]
                by_class += sums[:CLASSES]
                np.add.at(by_class, groups, counts)
            if len(words):
                yield as_rows(None, words, counts)
        at = np.flatnonzero(by_class.any(axis=1))
        yield as_rows(at, None, by_class[at])
        yield as_rows(np.arange(CLASSES, CLASSES + states + 1), None, np.concatenate([moves, first[None, :]]))

    schema = "class int, word binary, " + ", ".join(f"{n} double" for n in names)
    vectors = in_tasks(texts.select("row", "classes", "places", "words", "own"), run, schema)
    return vectors.groupBy("class", "word").agg(*[F.sum(n).alias(n) for n in names])


def _collected(sums: DataFrame, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = sums.filter("class IS NOT NULL").drop("word").toArrow()
    counts = np.zeros((CLASSES + states + 1, states))
    counts[found.column(0).to_numpy()] = np.stack([c.to_numpy() for c in found.columns[1:]], axis=1)
    return counts[:CLASSES], counts[CLASSES:-1], counts[-1]


def free_shuffles(texts: DataFrame) -> None:
    """Shuffle files of finished passes are deleted once the driver collects what refers to them."""
    texts.sparkSession._jvm.System.gc()


def train(encoded: DataFrame, lexicon: Lexicon, rare: DataFrame, how: Training = Training()) -> tuple[Model, DataFrame | None]:
    """The model, and the expected counts (word, c0, c1, ...) of the words ``rare`` (word, c) that belong to it."""
    states = how.states
    even = np.full(states, 1.0 / states)
    move = np.full((states, states), (1 - how.stay) / max(1, states - 1))
    np.fill_diagonal(move, how.stay)
    move /= move.sum(axis=1, keepdims=True)
    nothing = np.zeros((CLASSES, states)), np.zeros((states, states)), np.zeros(states)
    model, sums = replace(maximise(nothing, lexicon, how), start=even, move=move), None
    if not lexicon.ends:
        return model, sums
    learnable = encoded.filter("NOT held_out").select("row", "classes", "places", "rare")
    steps, share = 1 << 30, min(1.0, max(how.share, how.sample / lexicon.ends))
    drawn = F.pmod(F.xxhash64(F.lit("hmm"), F.col("row")), F.lit(steps)) < int(share * steps)
    scratch = Scratch(encoded.sparkSession)
    sample = scratch.keep(learnable.filter(drawn).repartition(3 + few_parts(int(share * lexicon.ends), 1000), "row"))
    words = F.col("rare.word").alias("words")
    last = None

    def learn(texts: DataFrame, model: Model | None) -> tuple[Model, DataFrame]:
        nonlocal last
        kept = scratch.keep(expectation(texts.select("row", "classes", "places", words, "own"), model, states))
        if last is not None:
            scratch.drop(last)
        last = kept
        return maximise(_collected(kept, states), lexicon, how), kept.filter("class IS NULL").drop("class")

    if not sample.isEmpty():
        listed = sample.select(F.explode("rare.word").alias("word")).distinct()
        known = scratch.keep(listed.join(rare, "word"))
        held = F.broadcast if known.count() <= BROADCAST_ROWS else lambda df: df
        blank = F.lit(None).cast("array<struct<slot:int,vector:binary>>").alias("own")
        begun, sums = learn(sample.select("*", blank), None)
        model = replace(begun, start=even, move=move)
        for _ in range(how.first):
            vectors = emissions(known, held(sums), model, lexicon, how)
            model, sums = learn(dressed(sample, held(vectors)), model)
        scratch.drop(known)
    scratch.drop(sample)
    free_shuffles(encoded)
    for _ in range(how.passes):
        vectors = emissions(rare, sums, model, lexicon, how)
        model, sums = learn(dressed(learnable, vectors), model)
        free_shuffles(encoded)
    return model, sums


def log_likelihoods(model: Model, texts: list[np.ndarray], room: int = 1 << 21) -> np.ndarray:
    """log10 of the probability of each class sequence by the scaled forward recursion, whole."""
    found = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    while order:
        longest = len(texts[order[0]])
        part, order = order[: max(1, room // max(1, longest))], order[max(1, room // max(1, longest)) :]
        lengths = np.array([len(texts[i]) for i in part])
        classes = np.zeros((longest, len(part)), dtype=np.int32)
        for at, i in enumerate(part):
            classes[: len(texts[i]), at] = texts[i]
        active = len(part) - np.searchsorted(lengths[::-1], np.arange(longest), side="right")
        total, alpha = np.zeros(len(part)), None
        for t in range(longest):
            n = active[t]
            alpha = (np.broadcast_to(model.start, (n, len(model.start))) if alpha is None else alpha[:n] @ model.move) * model.emit[classes[t, :n]]
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            total[:n] += np.log10(scale)
        found[part] = total
    return found


def likelihoods(texts: DataFrame, model: Model) -> DataFrame:
    """(row, doc_id, held_out, n_tokens, known, log_counts, rare_log, rare_known, n_rare, forward) of dressed texts."""
    names = ["row", "doc_id", "held_out", "n_tokens", "known", "log_counts", "rare_log", "rare_known", "n_rare"]
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_rows(batches, len(names), TEXT_BYTES):
            classes, places, own = (batch.column(len(names) + i) for i in range(3))
            found, vectors, _ = own_classes(classes, places, own, len(shared.value.start))
            local = replace(shared.value, emit=np.concatenate([shared.value.emit, vectors]))
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(log_likelihoods(local, found))], [*names, "forward"])

    schema = (
        "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, log_counts double, rare_log double, "
        "rare_known bigint, n_rare bigint, forward double"
    )
    tokens_of = (F.octet_length("places") / 4).cast("bigint").alias("n_rare")
    return in_tasks(texts.select(*names[:-1], tokens_of, "classes", "places", "own"), run, schema)


def score(docs: DataFrame, how: Training = Training()) -> DataFrame:
    """Learn from fold 1 to 9 of 10, score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (fold("doc_id", 10) == 0).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    learnable = rows.filter("NOT held_out")
    counts = scratch.keep(count_words(learnable.select("text")))
    lexicon, rare_counts = build_lexicon(counts, learnable.count())
    encoded = scratch.keep(encode(rows, lexicon))
    model, sums = train(encoded, lexicon, rare_counts, how)
    # Every text's distinct rare words meet their emissions and counts, and the vectors and sums go back to the text.
    vectors = emissions(rare_counts, sums, model, lexicon, how)
    forward = scratch.keep(likelihoods(dressed(encoded, vectors), model))
    known = F.coalesce("rare_known", F.lit(0))
    unknown_log = (F.col("n_rare") - known) * F.lit(math.log10(SMOOTH))
    logs = F.col("log_counts") + F.coalesce("rare_log", F.lit(0.0)) + unknown_log
    below = math.log10(lexicon.total + SMOOTH * (lexicon.distinct + 1))
    return forward.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + known).cast("bigint").alias("n_known"),
        F.lit(lexicon.total).cast("bigint").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        F.col("forward").alias("score"),
    )
