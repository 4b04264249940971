"""Packing documents into sequences: best fit, then a local search that swaps pieces between bins."""

from __future__ import annotations

import bisect
import math
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.sources.shared import materialize

END = 2
GROUP_PIECES = 20_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _encoder(path: str):
    """A function from texts to token ids.

    Most texts go through a second implementation of the same merges, built from the tokenizer's own vocabulary file,
    which gives the same ids in a third of the time; texts with a special token's string go through the tokenizer itself.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    specials = [t["content"] for t in model["added_tokens"]]
    byte = _byte_of_symbol()
    ranks = {bytes(byte[c] for c in token): n for token, n in model["model"]["vocab"].items() if token not in specials}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(s in text for s in specials):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies print bytes as themselves where visible, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(rest)}


def pieces(
    docs: DataFrame, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None,
) -> DataFrame:
    """doc_id, piece, start, length, ids (unsigned little-endian 32-bit token ids) of all whole texts.

    Each document ends with id 2. Only documents of more than ``capacity`` ids are cut, the remainder first.
    A null text is empty: its one piece is the end id.
    """
    path = vocab or vocabulary()
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids binary"

    def run(batches):
        encode = _encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array(encode(text.as_py()) + [END], "<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for n, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    rows.append((doc, n, a, b - a, ids[a:b].tobytes()))
                size += len(ids)
                if size > 1 << 20:
                    yield _rows(rows)
                    rows, size = [], 0
            yield _rows(rows)

    def _rows(rows):
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids"])

    texts = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, schema)


def _best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit, longest first; free room is kept as a sorted list of distinct values."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms: list[int] = []
    for item in np.argsort(-sizes, kind="stable"):
        size = int(sizes[item])
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            n, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[at]
            n = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        bins[n].append(int(item))
        left = room - size
        if left:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(n)
    return bins


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int, tries: int = 200) -> list[list[int]]:
    """Empty bins by moves and swaps between underfull bins, each of which raises the sum of squared fills.

    The least filled bin gives to the others: a piece moves where it fits; else it is exchanged for a smaller piece, or for two
    pieces that are smaller together, of a bin that has room for the difference. A bin is given up when nothing
    more can be exchanged with it; ``tries`` bins given up in a row end the search.
    """
    bins = [list(b) for b in bins]
    fill = [sum(int(sizes[i]) for i in b) for b in bins]
    order = sorted((n for n in range(len(bins)) if fill[n] < capacity), key=lambda n: fill[n])
    failed = 0
    given_up: set[int] = set()
    while failed < tries:
        source = next((n for n in order if bins[n] and n not in given_up), None)
        if source is None:
            break
        if _drain(source, bins, fill, sizes, capacity, order):
            failed = 0
        else:
            given_up.add(source)
            failed += 1
        order = sorted((n for n in order if bins[n] and fill[n] < capacity), key=lambda n: fill[n])
    return [b for b in bins if b]


def _drain(source: int, bins, fill, sizes, capacity: int, order: list[int]) -> bool:
    """Shrink the bin ``source`` step by step; true if it ended empty."""
    def put(item, a, b):
        bins[a].remove(item)
        bins[b].append(item)
        fill[a] -= int(sizes[item])
        fill[b] += int(sizes[item])

    while bins[source]:
        best = None  # (room left in the other bin, what goes, other bin, what comes back)
        for other in order:
            room = capacity - fill[other]
            if other == source or not bins[other] or not room or fill[other] < fill[source]:
                continue
            back = [((i,), int(sizes[i])) for i in bins[other]]
            back += [((i, j), int(sizes[i] + sizes[j])) for x, i in enumerate(bins[other]) for j in bins[other][:x]]
            for item in bins[source]:
                size = int(sizes[item])
                for given, weight in [((), 0), *back]:
                    gain = size - weight
                    if 0 < gain <= room and (best is None or (room - gain, -gain) < best[0]):
                        best = ((room - gain, -gain), item, other, given)
            if best and best[0][0] == 0:
                break
        if best is None:
            return False
        _, item, other, given = best
        put(item, source, other)
        for i in given:
            put(i, other, source)
    return True


def packed(parts: DataFrame, capacity: int = 1024) -> DataFrame:
    """The rows of ``parts`` (doc_id, piece, start, length, ...) with sequence_id and offset.

    Full pieces are sequences of their own. The others are dealt by a hash of their row into groups of about
    GROUP_PIECES and packed group by group; a group leaves at most a few sequences underfull, so the share lost
    falls with the size of a group and doesn't depend on the number of groups. Row numbers are stored with
    the pieces first, so a task that runs again packs the same rows. Sequences are numbered by group; those of full pieces are negative.
    """
    stored = materialize(parts.withColumn("row_", F.monotonically_increasing_id()), "pieces")
    full = stored.where(F.col("length") == capacity)
    short = stored.where(F.col("length") < capacity)
    groups = max(1, math.ceil(short.count() / GROUP_PIECES))
    dealt = short.select("row_", "length", F.pmod(F.xxhash64("row_"), F.lit(groups)).alias("group_"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row_", ignore_index=True)
        sizes = frame["length"].to_numpy()
        bins = local_search(_best_fit(sizes, capacity), sizes, capacity)
        number, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        for n, members in enumerate(bins):
            at = 0
            for i in members:
                number[i], offset[i] = n, at
                at += int(sizes[i])
        return pd.DataFrame({"row_": frame["row_"], "sequence_id": number + (int(frame["group_"].iloc[0]) << 32),
                             "offset": offset})

    places = dealt.groupBy("group_").applyInPandas(pack, "row_ bigint, sequence_id bigint, offset bigint")
    return short.join(places, "row_").drop("row_").unionByName(
        full.withColumns({"sequence_id": -F.col("row_") - 1, "offset": F.lit(0).cast("bigint")}).drop("row_"))


def pack_documents(
    docs: DataFrame, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Sequences of at most ``capacity`` ids: doc_id, piece, start, length, ids, sequence_id, offset of every piece.

    Every row of ``docs`` gives its pieces, repeated rows and rows with a null id too; no rows give none.
    """
    return packed(pieces(docs, capacity, id_col, text_col), capacity)
