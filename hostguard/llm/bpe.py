"""Byte-level BPE by replaying the merges over many words at once.

A task takes its rows in slices of the corpus. The pieces that the split pattern finds in a slice become one set of
distinct words, laid end to end as a linked list of symbols. An inverted index leads from each mergeable pair, named by
the rank of its merge, to the positions where it stands. Ranks are taken in order; each merges all its positions in one
step and touches only their neighbours, whose new pairs enter the index. A word that is itself in the vocabulary is one
token at once. If a merge makes a pair of a lower rank than its own, which no trained vocabulary in merge order does,
the word is merged by itself in the library's order instead.

The tokens of a word do not depend on other rows, so no shuffle is needed and every slice can be replayed anew; a
task holds one slice, a bounded cache of words, and the vocabulary, which is broadcast (its size is the file's).

Edge cases: a null text counts as empty and has no tokens. A text longer than a slice is a slice by itself. Pieces
longer than ``LONG_PIECE`` bytes are replayed but not cached. Special tokens in a text are ordinary text. Rows that
share a doc_id are separate rows. An empty table gives an empty result; other columns are carried along by name only
if asked for.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hostguard.llm.common import batches_of_rows, in_tasks

SLICE_BYTES = 4 << 20
CACHED_WORDS = 200_000
LONG_PIECE = 256
STRETCHES = 64

_NONE = np.iinfo(np.int64).max


def read_ranks(path: str) -> bytes:
    """The vocabulary file, read on the driver: a base64 token and its rank per line."""
    with open(path, "rb") as file:
        return file.read()


class Vocabulary:
    """Tokens by rank, and the rank that each pair of tokens merges to."""

    def __init__(self, ranks: bytes) -> None:
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        self.token = {r: t for t, r in self.rank.items()}
        self.byte = np.full(256, -1, dtype=np.int64)
        keys, made = [], []
        self.shift = max(self.token, default=0).bit_length()
        for token, rank in self.rank.items():
            if len(token) == 1:
                self.byte[token[0]] = rank
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << self.shift | right)
                    made.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.append(np.array(keys, dtype=np.int64)[order], _NONE)
        self.made = np.append(np.array(made, dtype=np.int64)[order], _NONE)

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges to, ``_NONE`` if it does not."""
        key = left << self.shift | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], _NONE)

    def one_word(self, word: bytes) -> list[int]:
        """The lowest rank first, the leftmost of equals, one pair at a time."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            found = [(self.rank.get(parts[i] + parts[i + 1], _NONE), i) for i in range(len(parts) - 1)]
            rank, at = min(found)
            if rank == _NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]


def _apart(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The positions that merge if each merge takes its right neighbour away; leftmost first. ``at`` is sorted."""
    touch = following[at[:-1]] == at[1:]
    if not touch.any():
        return at
    keep = np.ones(len(at), dtype=bool)
    for i in np.flatnonzero(touch).tolist():
        keep[i + 1] = not keep[i]
    return at[keep]


def _by_rank(at: np.ndarray, pair: np.ndarray) -> tuple[dict[int, list[np.ndarray]], list[int]]:
    """The index of the positions by the rank of their pair, and its ranks as a heap."""
    ranks = pair[at]
    order = np.argsort(ranks, kind="stable")
    at, ranks = at[order], ranks[order]
    cuts = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])[: len(ranks)])
    heap = ranks[cuts].tolist()
    return {r: [part] for r, part in zip(heap, np.split(at, cuts[1:]))}, heap


def replay(words: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """The tokens of each word as little-endian unsigned 32-bit integers."""
    found: list[bytes | None] = [None] * len(words)
    open_words = []
    for i, word in enumerate(words):
        rank = vocabulary.rank.get(word)
        if rank is None:
            open_words.append(i)
        else:
            found[i] = rank.to_bytes(4, "little")
    lengths = np.array([len(words[i]) for i in open_words], dtype=np.int64)
    symbol = vocabulary.byte[np.frombuffer(b"".join(words[i] for i in open_words), dtype=np.uint8)]
    if (symbol < 0).any():
        raise ValueError("the vocabulary lacks single bytes")
    count = len(symbol)
    owner = np.repeat(np.arange(len(open_words)), lengths)
    ends = np.cumsum(lengths)
    following = np.arange(1, count + 1)
    following[ends[lengths > 0] - 1] = -1
    preceding = np.arange(-1, count - 1)
    preceding[(ends - lengths)[lengths > 0]] = -1
    odd: set[int] = set()

    # The rank of the pair that begins at each position; -1 where the symbol is gone.
    pair = np.full(count, _NONE, dtype=np.int64)
    left = np.flatnonzero(following >= 0)
    pair[left] = vocabulary.merges(symbol[left], symbol[following[left]])
    entering = [left[pair[left] != _NONE]]
    # Ranks are taken in stretches. Pairs of later stretches wait in one list and are sorted when their stretch comes.
    ranks = np.sort(pair[entering[0]])
    tops = np.unique(ranks[(np.arange(1, STRETCHES) * len(ranks)) // STRETCHES]).tolist() if len(ranks) else []
    for top in [*tops, _NONE]:
        waiting = np.concatenate(entering)
        waiting = waiting[pair[waiting] >= 0]
        now = pair[waiting] < top
        entering = [waiting[~now & (pair[waiting] != _NONE)]]
        index, heap = _by_rank(waiting[now], pair)
        while heap:
            rank = heapq.heappop(heap)
            at = np.sort(np.concatenate(index.pop(rank)))
            # A pair may have changed since it entered the index, and entered it twice.
            at = at[(pair[at] == rank) & np.append(True, at[1:] != at[:-1])]
            if not len(at):
                continue
            at = _apart(at, following)
            gone = following[at]
            after = following[gone]
            symbol[at] = rank
            following[at] = after
            pair[gone] = -1
            pair[at] = _NONE
            right = after >= 0
            preceding[after[right]] = at[right]
            before = preceding[at]
            new = np.concatenate([before[before >= 0], at[right]])
            made = vocabulary.merges(symbol[new], symbol[following[new]])
            pair[new] = made
            soon = made < top
            if soon.any():
                if made.min() < rank:
                    odd.update(owner[new[made < rank]].tolist())
                for other, position in zip(made[soon].tolist(), new[soon].tolist()):
                    if other not in index:
                        index[other] = []
                        heapq.heappush(heap, other)
                    index[other].append(np.array([position]))
            entering.append(new[(made >= top) & (made != _NONE)])
    alive = pair >= 0
    kept = symbol[alive].astype("<u4").tobytes()
    stops = np.cumsum(np.bincount(owner[alive], minlength=len(open_words))) * 4 if count else []
    start = 0
    for place, (i, stop) in enumerate(zip(open_words, np.asarray(stops).tolist())):
        found[i] = kept[start:stop]
        start = stop
        if place in odd:
            found[i] = np.array(vocabulary.one_word(words[i]), dtype="<u4").tobytes()
    return [f if f is not None else b"" for f in found]


class Encoder:
    """Encodes slices of texts, keeping the tokens of words that it has seen."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, cached: int = CACHED_WORDS) -> None:
        self.vocabulary, self.pattern, self.cached = vocabulary, regex.compile(pattern), cached
        self.known: dict[str, bytes] = {}

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        split = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.known) > self.cached:
            self.known = {}
        words = set().union(*split)
        new = [w for w in words if w not in self.known]
        tokens = dict(zip(new, replay([w.encode("utf-8", "surrogatepass") for w in new], self.vocabulary)))
        known = self.known
        known.update((w, t) for w, t in tokens.items() if len(w) <= LONG_PIECE)
        rest = {w: t for w, t in tokens.items() if len(w) > LONG_PIECE}
        look = known.__getitem__ if not rest else lambda w: known.get(w) or rest[w]
        return [b"".join(map(look, pieces)) for pieces in split]


_loaded: dict[int, Vocabulary] = {}


def _vocabulary(ranks: bytes) -> Vocabulary:
    """One table per worker process and vocabulary."""
    key = hash(ranks)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(ranks)
    return _loaded[key]


def encode(texts: DataFrame, ranks: bytes, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, n_tokens, ids): ``ids`` are the token ids of ``text`` as little-endian unsigned 32-bit integers."""
    shared = texts.sparkSession.sparkContext.broadcast(ranks)
    rows = texts.select(*keep, texts["text"].cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_vocabulary(shared.value), pattern)
        for batch in batches_of_rows(batches, len(keep), SLICE_BYTES):
            ids = encoder.encode(batch.column(len(keep)).to_pylist())
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, counts, pa.array(ids, pa.binary())], [*keep, "n_tokens", "ids"])

    return in_tasks(rows, run, ", ".join(x for x in (kinds, "n_tokens bigint, ids binary") if x))


def decode(tokens: DataFrame, ranks: bytes, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes that ``ids`` stand for in column ``to``; null ids stay null."""
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)
    names = tokens.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema) + f", `{to}` binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _vocabulary(shared.value).token.__getitem__
        for batch in batches_of_rows(batches, names.index(ids), SLICE_BYTES):
            texts = [
                None if i is None else b"".join(map(look, np.frombuffer(i, dtype="<u4").tolist()))
                for i in batch.column(names.index(ids)).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*names, to])

    return in_tasks(tokens, run, schema)


def default_vocabulary() -> tuple[bytes, str]:
    """Ranks and split pattern of the multilingual vocabulary that the machine's tokenizer package has."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN
