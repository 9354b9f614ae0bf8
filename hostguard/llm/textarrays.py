"""Texts as numpy arrays: letters, n-grams and words without a Python loop over characters."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

SPACE = 32
MIX = np.uint64(0x9E3779B97F4A7C15)

# Texts are taken in pieces of so many characters, so arrays stay small however long a text is.
PIECE = 1 << 19


@functools.cache
def letter_table() -> np.ndarray:
    """The lower-case letter for every code point, a space for what is no letter."""
    found = np.full(0x110000, SPACE, dtype=np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            found[code] = ord(low) if len(low) == 1 else code
    return found


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def letter_grams(text: str, orders: int, bits: int) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of 1 to ``orders`` letters, piece by piece.

    Letters are lower-cased and other characters count as a space, of which one stands for several in a row.
    """
    held = np.array([SPACE], dtype=np.uint32)
    table = letter_table()
    for start in range(0, len(text), PIECE):
        part = table[code_points(text[start : start + PIECE])]
        part = np.concatenate([held[-1:], part])
        part = part[1:][(part[1:] != SPACE) | (part[:-1] != SPACE)]
        if not len(part):
            continue
        whole = np.concatenate([held, part])
        yield gram_hashes(whole, len(held), orders, bits)
        held = whole[-(orders - 1) :] if orders > 1 else whole[-1:]


def gram_hashes(codes: np.ndarray, first: int, orders: int, bits: int) -> np.ndarray:
    """Hashes of the n-grams that end at ``first`` or after."""
    codes = codes.astype(np.uint64)
    found = []
    rolled = np.zeros(len(codes), dtype=np.uint64)
    for order in range(1, orders + 1):
        rolled = rolled[: len(codes) - order + 1] * np.uint64(0x110001) + codes[order - 1 :]
        ends = rolled[max(0, first - order + 1) :]
        found.append(((ends + np.uint64(order)) * MIX) >> np.uint64(64 - bits))
    return np.concatenate(found).astype(np.int64)


_IS_GAP = np.zeros(256, dtype=bool)
_IS_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
# A random number per byte, so that no two short words share a sum of powers.
_BYTE = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)


@functools.lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    back = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BASE)]), dtype=np.uint64)
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, back)]), dtype=np.uint64)
    return powers, inverse


def drop_powers() -> None:
    _powers.cache_clear()


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def _word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[True], _IS_GAP[data], [True]]).astype(np.int8))
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text after lower-casing A-Z, in order.

    A word is a longest run of bytes other than the space and 09 to 0D. Long texts are cut at a gap.
    """
    found = []
    start = 0
    while start < len(data):
        stop = min(len(data), start + PIECE)
        if stop < len(data):
            gap = stop
            while gap > start and not _IS_GAP[data[gap]]:
                gap -= 1
            if gap == start:  # one word longer than the piece
                gap = stop
                while gap < len(data) and not _IS_GAP[data[gap]]:
                    gap += 1
            stop = gap
        found.append(_hash_piece(np.frombuffer(data, dtype=np.uint8, count=stop - start, offset=start)))
        start = stop + 1
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def _hash_piece(data: np.ndarray) -> np.ndarray:
    data = _LOWER[data]
    starts, stops = _word_bounds(data)
    size = 1 << max(12, len(data).bit_length())
    powers, inverse = _powers(size)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * powers[: len(data)], dtype=np.uint64)])
    return mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64) * MIX)
