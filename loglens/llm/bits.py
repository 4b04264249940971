"""Membership of 64-bit numbers in a set, as a bitmap of bounded size that tasks get as a broadcast."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import mix64

#: Bits per entry, and the most that a bitmap has whatever the number of entries (32 MB).
PER_ENTRY, MOST = 16, 1 << 28


class Bits:
    """Says yes for every member and, by chance, for a few others; so what it lets through is counted again."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.shift = np.uint64(64 - (len(words) * 64).bit_length() + 1)

    def has(self, numbers: np.ndarray) -> np.ndarray:
        at = mix64(numbers) >> self.shift
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bitmap(numbers: DataFrame, name=lambda *columns: columns[0]) -> Bits:
    """Of the numbers that ``name`` makes of the bigint columns of ``numbers`` (as uint64 arrays).

    Tasks set bits, Spark ors them together, and only the finished bitmap, of at most ``MOST`` bits, comes to the driver.
    """
    size = 1 << min(max(numbers.count() * PER_ENTRY, 1 << 12).bit_length(), MOST.bit_length() - 1)
    shift = np.uint64(64 - size.bit_length() + 1)

    def run(batches):
        for batch in batches:
            at = mix64(name(*[c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns])) >> shift
            order = np.argsort(at)
            at = at[order]
            word = (at >> np.uint64(6)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])[:len(word)])
            bits = np.left_shift(np.uint64(1), at & np.uint64(63))
            yield pa.RecordBatch.from_arrays(
                [pa.array(word[first]), pa.array((np.bitwise_or.reduceat(bits, first) if len(first) else bits).view(np.int64))],
                ["at", "bits"])

    parts = numbers.mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    words = np.zeros(size // 64, np.uint64)
    table = parts.toArrow()
    words[table["at"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return Bits(words)
