"""Bloom filters of pairs of 64-bit hashes, built by tasks and put together on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: np.ndarray


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finalizer, salted."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _positions(a: np.ndarray, b: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """``hashes`` places in a filter for each pair of 64-bit hashes, a row per hash."""
    first, step = mixed(a.astype(np.int64).view(np.uint64), 2 * level), mixed(b.astype(np.int64).view(np.uint64), 2 * level + 1) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(first + np.uint64(i) * step) % np.uint64(bits) for i in range(hashes)])


def passes(a: np.ndarray, b: np.ndarray, at: int, level: Level) -> np.ndarray:
    out = np.ones(len(a), dtype=bool)
    for place in _positions(a, b, at, level.bits, level.hashes):
        out &= (level.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return out


def build(keys: DataFrame, at: int, n: int, rate: float, most_bits: int | None = None) -> Level:
    """A filter of ``n`` keys ``(a, b)``: bits are set in tasks and joined by word.

    Beyond ``most_bits`` the filter is no larger and lets more through.
    """
    bits = max(64, 64 * math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))
    hashes = max(1, round(-math.log2(rate)))
    if most_bits is not None and bits > most_bits:
        bits = most_bits // 64 * 64
        hashes = max(1, min(hashes, round(bits / n * math.log(2))))

    def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            place = np.unique(_positions(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), at, bits, hashes))
            word, start = np.unique(place >> np.uint64(6), return_index=True)
            if len(word):
                value = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), start)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "value"])

    made = keys.select("a", "b").mapInArrow(mark, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[made["word"].to_numpy()] = made["value"].to_numpy().view(np.uint64)
    return Level(bits, hashes, words)
