"""Hashes of words and word sequences of many texts at once."""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit integers in which every bit depends on all."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def draws(n: int, seed: int) -> np.ndarray:
    """n odd multipliers, the same in every process."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTES = draws(256, 1)
_PLACES = draws(1 << 12, 2)
#: Texts are hashed together up to about this many characters.
SLICE_CHARS = 1 << 20


def words_of(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    r"""(hash of every word ``[^\x20\x09-\x0D]+`` of all texts in order, number of words of each text); ``lower`` folds A-Z."""
    parts, start, size = [], 0, 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= SLICE_CHARS or i == len(texts) - 1:
            parts.append(_words_of(texts[start : i + 1], lower))
            start, size = i + 1, 0
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _words_of(texts: list[str | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    global _PLACES
    raw = [(x or "").encode() for x in texts]
    sizes = np.array([len(x) + 1 for x in raw], np.int64)
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = ~_BLANK[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    lens = ends - starts
    at = np.concatenate([[0], np.cumsum(lens)[:-1]])
    if (longest := int(lens.max())) > len(_PLACES):
        _PLACES = draws(2 * longest, 2)
    chars = buf[inside]
    if lower:
        chars = _LOWER[chars]
    values = _BYTES[chars]
    values *= _PLACES[np.arange(len(chars)) - np.repeat(at, lens)]
    hashes = mix(np.add.reduceat(values, at) + lens.astype(np.uint64))
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
    return hashes, counts


def sequences(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of each run of n neighbouring words (len(words) - n + 1 of them)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k, r in enumerate(draws(n, seed)):
        out += words[k : k + m] * r
    return mix(out)
