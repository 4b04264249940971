"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import (
    LOWER, WHITE, connected_components, mix64, prefix_sums, span_hashes, text_chunks, words_of)
from loglens.sources.shared import materialize

BANDS, ROWS = 32, 4
_SHIFTS = np.arange(1, BANDS * ROWS + 1, dtype=np.uint32)
_BLOCK = 256


def _shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    data = LOWER[data]
    starts, ends, rows = words_of(data, offsets, WHITE)
    words = span_hashes(prefix_sums(data), starts, ends)
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    runs = max(len(words) - k + 1, 0)
    hashes = np.zeros(runs, np.uint64)
    for i in range(k):
        hashes = mix64(hashes * np.uint64(0x2545F4914F6CDD1D) + words[i:i + runs])
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= k:
            out.append(np.unique(hashes[a:b - k + 1]))
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                short = mix64(short * np.uint64(0xD1342543DE82EF95) + w)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _permuted(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit numbers."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray) -> np.ndarray:
    """Coordinate k is the least place of the set under the second permutation, shifted by k.

    The first permutation spreads the shingles over the circle of 2**32 places once.
    """
    at = (mix64(shingles ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_SHIFTS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(at), _BLOCK):
        np.minimum(least, _permuted(at[i:i + _BLOCK, None] + _SHIFTS).min(axis=0), out=least)
    return least


def _bands(least: np.ndarray) -> np.ndarray:
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n (size of the shingle set), print_a and print_b (of the set), bands."""
    schema = "id bigint, n bigint, print_a bigint, print_b bigint, bands array<bigint>"

    def run(batches):
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(1)):
                sets = _shingles(data, offsets, k)
                a = [int(s.sum().view(np.int64)) if len(s) else 0 for s in sets]
                b = [int(mix64(s).sum().view(np.int64)) if len(s) else 0 for s in sets]
                bands = [_bands(signature(s)) if len(s) else np.zeros(0, np.int64) for s in sets]
                places = np.cumsum([0] + [len(x) for x in bands]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                    pa.ListArray.from_arrays(places, np.concatenate(bands))],
                    ["id", "n", "print_a", "print_b", "bands"])

    return _texts(docs, id_col, text_col).mapInArrow(run, schema)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def shingle_sets(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, shingles (the 64-bit hashes of the whole set)."""
    def run(batches):
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(1)):
                sets = _shingles(data, offsets, k)
                places = np.cumsum([0] + [len(x) for x in sets]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(sets)), pa.ListArray.from_arrays(places, np.concatenate(sets).view(np.int64))],
                    ["id", "shingles"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "id bigint, shingles array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap enough."""
    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = []
            for i in range(len(x)):
                p, q = (c[i].values.to_numpy() for c in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
            .mapInArrow(run, "a bigint, b bigint"))


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept (the smallest id of its component).

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of k-word shingles;
    components are those of all links among candidates of a band. Equal sets become one
    representative first. The members of a band bucket are compared with the least of them; a bucket of one family ends there. The
    members of buckets that still hold several components are joined across components by their rarest shingles, which
    finds every link left among them without testing all pairs.

    Null or empty texts and texts without words have n_shingles 0 and are linked with nothing. Rows with a null id get a
    null component and are kept. Rows that share an id are one document for the links. Column names other than
    ``id_col`` and ``text_col`` don't matter.
    """
    signed = materialize(signatures(docs, k, id_col, text_col), "minhash")
    known = signed.where("id IS NOT NULL AND n > 0")
    keys = ["n", "print_a", "print_b"]
    classes = materialize(known.groupBy(*keys).agg(F.min("id").alias("rep")), "classes")
    reps = known.join(classes, keys).where("id = rep").dropDuplicates(["rep", *keys])
    banded = reps.select("rep", "n", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most")
    members = materialize(
        banded.join(shared.select("band"), "band").select("band", "rep", "n").distinct(), "members")
    wanted = members.select(F.col("rep").alias("id")).distinct()
    sets = materialize(
        shingle_sets(docs.join(wanted.select(F.col("id").alias(id_col)), id_col, "left_semi"), k, id_col, text_col)
        .dropDuplicates(["id"]), "sets")
    places = links(members, sets, percent)
    placed = classes.join(places, classes.rep == places.node, "left").select(
        *keys, F.coalesce("component", "rep").alias("component"))
    return signed.join(placed, keys, "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == F.coalesce("component", "id"))).alias("kept"))


def links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) from bucket members (band, rep, n) and their full sets (id, shingles)."""
    nodes = members.select(F.col("rep").alias("node")).distinct()
    heads = members.groupBy("band").agg(F.min("rep").alias("head"))
    sized = heads.join(members.select("band", F.col("rep").alias("head"), F.col("n").alias("pn")), ["band", "head"])
    stars = members.join(sized, "band").where(
        f"rep <> head AND 100 * least(n, pn) >= {percent} * greatest(n, pn)").select(
        F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    edges = materialize(_verified(stars, sets, percent), "star-edges")
    places = _placed(nodes, edges)
    apart = members.join(places.withColumnRenamed("node", "rep"), "rep")
    open_ = apart.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    live = materialize(apart.join(open_, "band", "left_semi").select("rep", "n", "component").distinct(), "open-members")
    if live.isEmpty():
        return places
    pairs = _across(live, sets, percent)
    return _placed(nodes, materialize(edges.unionByName(_verified(pairs, sets, percent)), "all-edges"))


def _placed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    joined = connected_components(edges)
    return materialize(nodes.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "places")


def _across(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different components that can overlap enough, by their rarest shingles.

    Sets of n and m shingles overlap enough only if they share t = ceil(percent * (n + m) / (100 + percent)) of them, so in one order of all
    shingles, rarest first, they share one among the first n - t + 1 of the one and the first m - t + 1 of the other.
    The join has that as its condition: a set whose rarest shingles are its own gives no pair, however large its bucket is.
    """
    each = live.join(sets.withColumnRenamed("id", "rep"), "rep").select(
        "rep", "n", "component", F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(common, "shingle").groupBy("rep", "n", "component").agg(
        F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("order"))
    most = F.expr(f"CAST(n - ceil({percent} * n / 100D) + 1 AS INT)")
    heads = materialize(ranked.select("rep", "n", "component", F.posexplode(F.slice("order", F.lit(1), most)).alias("pos", "s"))
                        .where("s.df > 1").select("rep", "n", "component", "pos", F.col("s.shingle").alias("shingle")), "rare-shingles")
    x = heads.select("shingle", *[F.col(c).alias(f"a_{c}") for c in ("rep", "n", "component", "pos")])
    y = heads.select("shingle", *[F.col(c).alias(f"b_{c}") for c in ("rep", "n", "component", "pos")])
    needed = f"ceil({percent} * (a_n + b_n) / {100 + percent}D - 1e-9)"
    return x.join(y, (x.shingle == y.shingle) & F.expr(
        f"a_rep < b_rep AND a_component <> b_component AND a_pos <= a_n - {needed} AND b_pos <= b_n - {needed}")
    ).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).distinct()
