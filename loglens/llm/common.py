"""What the operators share: hashed words of whole texts, and connected components as Spark jobs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.sources.shared import materialize

CHUNK_BYTES = 1 << 20

#: ASCII white space: \x20 and \x09-\x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: Everything of ASCII but letters and digits; bytes of longer characters belong to words.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base of the polynomial hash and of its inverse, modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            self.up, self.down = (
                np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, base, np.uint64))])
                .astype(np.uint64) for base in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash; ``span_hashes`` takes hashes of any spans from them."""
    up, _ = POWERS.upto(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal spans have equal hashes, wherever they stand."""
    _, down = POWERS.upto(len(sums))
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """Yield (first row, bytes of some rows, offsets in them); a row is never split."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def words_of(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray):
    """Starts, ends and rows of the words in ``data``; ``apart`` marks the bytes between words."""
    inside = ~apart[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, "right")


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its smallest node.

    Each round points every node at its least neighbour and contracts the graph; odd rounds order nodes
    by a hash, so that long chains shrink by a constant factor too. Least neighbours are summed up
    before the shuffle, and a hub's edges meet only single rows in joins. Nothing but the number of
    edges left comes to the driver.
    """
    left = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                       .distinct(), name)
    places, turn = None, 0
    while not left.isEmpty():
        order = "node" if turn % 2 == 0 else f"xxhash64(node, {turn})"
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        near = both.groupBy("node").agg(
            F.min(F.expr(f"struct({order.replace('node', 'other')} AS o, other AS n)")).alias("m"))
        step = materialize(near.selectExpr(
            "node", f"CASE WHEN m.o < {order} THEN m.n ELSE node END AS at"), name)
        left = materialize(
            left.join(step.select(F.col("node").alias("a"), F.col("at").alias("x")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("at").alias("y")), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), name)
        if places is None:
            places = step
        else:
            moved = step.select(F.col("node").alias("at"), F.col("at").alias("to"))
            places = materialize(places.join(moved, "at", "left").select(
                "node", F.coalesce("to", "at").alias("at")), name)
        turn += 1
    if places is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = places.groupBy("at").agg(F.min("node").alias("component"))
    return places.join(least, "at").select("node", "component")
