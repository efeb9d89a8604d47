"""Runs of neighbouring words as numbers: words coded, runs hashed, runs that matter told by a bit map."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Slots of a bit map; it is 16 MB, whatever the input's size.
SLOTS = 1 << 27


def text_hash(text: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((text or "").encode("utf-8", "replace"), digest_size=8).digest(), "little")


def coded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row of each word, code of each word, words by their codes) of a batch."""
    found = lists.flatten().dictionary_encode()
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def run_hashes(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n hashed words from each start on."""
    out = words[starts]
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words[starts + k]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def joined(words: pa.Array, codes: np.ndarray, starts: np.ndarray, n: int) -> pa.Array:
    """The n coded words from each start on, joined by blanks."""
    return pc.binary_join_element_wise(*[words.take(pa.array(codes[starts + k])) for k in range(n)], " ")


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(37)).astype(np.int64)


def empty_bits() -> np.ndarray:
    return np.zeros(SLOTS // 64, np.uint64)


def put(bits: np.ndarray, hashes: np.ndarray) -> None:
    at = slots(hashes)
    np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))


def held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a hash may have been put; another one in its slot says so wrongly."""
    at = slots(hashes)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


BITS = "w int, bits long"


def as_batch(bits: np.ndarray) -> pa.RecordBatch:
    w = np.flatnonzero(bits)
    return pa.RecordBatch.from_pydict({"w": pa.array(w.astype(np.int32)), "bits": pa.array(bits[w].view(np.int64))})


def united(parts: DataFrame) -> np.ndarray:
    """One bit map of those that tasks have made as rows (BITS)."""
    told = parts.groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = empty_bits()
    out[told["w"].to_numpy()] = told["bits"].to_numpy().view(np.uint64)
    return out
