"""Spelling variant grouping: one-edit neighbours by way of a reduced alphabet.

Letters are hashed to a few symbols. Words that are one edit apart have reduced words that are equal or one edit apart, so the full
one-edit neighbourhood of every reduced word is generated and joined with the reduced vocabulary, and what meets there is verified on
the words themselves. Neighbours that no word reduces to are left out by a bitmap of the reduced vocabulary before anything is shuffled.

Spark takes tables of words for as small as their compressed files, and neighbourhoods for no larger than the words they are made from, so
joins of these are told to merge: none is ever collected in the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.bits import Bits, bitmap
from loglens.llm.common import LOWER, POWERS, WHITE, mix64, prefix_sums, span_hashes, text_chunks, words_of
from loglens.sources.shared import materialize

MIN_LENGTH, MIN_COUNT = 5, 3
#: Every so manieth run, by its checksum, loses a letter.
SLIP = 97
CHUNK = 2 << 20
#: The fewest symbols of the reduced alphabet, and words per reduced word of the shortest length.
SYMBOLS, PER_REDUCED = 6, 8
#: Words per block of the neighbourhood's arrays.
_BLOCK = 4096

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True


def _checksums(seeds: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of data[start:end], each gone on with from its seed (the crc32 of what stands ahead)."""
    order = np.argsort(starts - ends, kind="stable")  # longest first
    starts, lengths = starts[order], (ends - starts)[order]
    state = seeds[order] ^ np.uint32(0xFFFFFFFF)
    # Few words are long: what is left of them goes through zlib.
    steps = int(min(lengths[0], 64)) if len(lengths) else 0
    for i in range(steps):
        n = int(np.searchsorted(-lengths, -i, "left"))
        state[:n] = _CRC[(state[:n] ^ data[starts[:n] + i]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-lengths, -64, "left"))):
        state[i] = zlib.crc32(data[starts[i] + 64:starts[i] + lengths[i]].tobytes(), int(state[i]))
    out = np.empty_like(state)
    out[order] = state
    return out


def words(docs: DataFrame, id_col: str, text_col: str, slip: int = SLIP) -> DataFrame:
    """word, n: the runs of letters of all texts, A-Z lower-cased, some without a letter as their checksum says."""
    def run(batches):
        for batch in batches:
            seeds = np.array([zlib.crc32(f"{i}:".encode()) for i in batch.column(0).to_pylist()], np.uint32)
            for row, data, offsets in text_chunks(batch.column(1), CHUNK):
                inside = _LETTER[data]
                inside[1:] |= data[:-1] == 0xC3
                data = np.where(inside, LOWER[data], np.uint8(0x20))
                starts, ends, rows = words_of(data, offsets, WHITE)
                hashes = span_hashes(prefix_sums(data), starts, ends)
                order = np.lexsort((hashes, rows))
                new = np.ones(len(order), bool)
                new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(order)))
                at = order[first]
                starts, ends, hashes = starts[at], ends[at], hashes[at]
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                lengths = points[ends] - points[starts]
                sums = _checksums(seeds[row + rows[at]], data, starts, ends)
                slips = sums % slip == 0
                view, out = data.tobytes(), Counter()
                for i in np.flatnonzero(slips & (lengths > MIN_LENGTH)).tolist():
                    word, gone = view[starts[i]:ends[i]].decode(), int(sums[i]) % int(lengths[i])
                    out[word[:gone] + word[gone + 1:]] += int(n[i])
                kept = np.flatnonzero(~slips & (lengths >= MIN_LENGTH))
                found, where = np.unique(hashes[kept], return_index=True)
                total = np.zeros(len(found), np.int64)
                np.add.at(total, np.searchsorted(found, hashes[kept]), n[kept])
                for i, m in zip(kept[where].tolist(), total.tolist()):
                    out[view[starts[i]:ends[i]].decode()] += m
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], ["word", "n"])

    texts = docs.where(F.col(text_col).isNotNull()).select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("binary"))
    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _symbols(column: pa.Array, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of each word, one row per word, and lengths; a letter's symbol is its code point's remainder."""
    points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in column.to_pylist()]
    lengths = np.array([len(p) for p in points], np.int64)
    out = np.zeros((len(points), int(lengths.max(initial=0))), np.uint64)
    if len(points):
        out[np.arange(out.shape[1]) < lengths[:, None]] = np.concatenate(points) % np.uint32(symbols) + np.uint64(1)
    return out, lengths


def _blocks(batch: pa.RecordBatch, symbols: int):
    """(words, symbols, lengths, prefix sums of the hash) of some words at a time, words of like lengths together."""
    order = np.argsort([len(w) for w in batch.column(0).to_pylist()], kind="stable")
    column = batch.column(0).take(pa.array(order))
    for at in range(0, len(column), _BLOCK):
        part = column.slice(at, _BLOCK)
        reduced, lengths = _symbols(part, symbols)
        up, _ = POWERS.upto(reduced.shape[1] + 2)
        sums = np.zeros((len(part), reduced.shape[1] + 1), np.uint64)
        np.cumsum(reduced * up[:reduced.shape[1]], axis=1, out=sums[:, 1:])
        yield part, reduced, lengths, sums


def _named(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return mix64(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def reduced(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """word, name: the hash of the reduced word."""
    def run(batches):
        for batch in batches:
            for part, _, lengths, sums in _blocks(batch, symbols):
                yield pa.RecordBatch.from_arrays([part, pa.array(_named(sums[:, -1], lengths).view(np.int64))], ["word", "name"])

    return vocabulary.select("word").mapInArrow(run, "word string, name bigint")


def _neighbourhood(reduced: np.ndarray, lengths: np.ndarray, sums: np.ndarray, symbols: int):
    """(words, names) of the reduced words themselves and of all that are one edit away, an edit's place and symbol at a time."""
    up, down = POWERS.upto(reduced.shape[1] + 2)
    base, back, whole, every = up[1], down[1], sums[:, -1], np.arange(len(lengths))
    yield every, _named(whole, lengths)
    for i in range(reduced.shape[1] + 1):
        at = every[lengths >= i]
        before, rest = sums[at, i], whole[at] - sums[at, i]
        for s in range(1, symbols + 1):  # insert ahead of place i
            yield at, _named(before + np.uint64(s) * up[i:i + 1] + rest * base, lengths[at] + 1)
        if i == reduced.shape[1]:
            return
        at = every[lengths > i]
        own = reduced[at, i]
        yield at, _named(sums[at, i] + (whole[at] - sums[at, i + 1]) * back, lengths[at] - 1)
        for s in range(1, symbols + 1):
            put = own != s
            yield at[put], _named(whole[at[put]] + (np.uint64(s) - own[put]) * up[i], lengths[at[put]])


def neighbourhoods(vocabulary: DataFrame, symbols: int, known) -> DataFrame:
    """word, name: the reduced words one edit or none away to which (probably) a word reduces."""
    def run(batches):
        for batch in batches:
            for part, own, lengths, sums in _blocks(batch, symbols):
                bits: Bits = known.value
                found = [(at[hit], names[hit]) for at, names in _neighbourhood(own, lengths, sums, symbols)
                         for hit in [bits.has(names)]]
                at, names = np.concatenate([a for a, _ in found]), np.concatenate([n for _, n in found])
                # the same neighbour comes from several edits
                order = np.lexsort((names, at))
                at, names = at[order], names[order]
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1]) | (names[1:] != names[:-1])
                yield pa.RecordBatch.from_arrays([part.take(pa.array(at[new])), pa.array(names[new].view(np.int64))], ["word", "name"])

    return vocabulary.select("word").mapInArrow(run, "word string, name bigint")


def near_pairs(vocabulary: DataFrame, symbols: int | None = None) -> DataFrame:
    """word, near: all ordered pairs of words of ``vocabulary`` (word) that differ by exactly one edit.

    ``symbols`` of the reduced alphabet: by default as many as leave a bounded number of words per short reduced word.
    """
    symbols = symbols or max(SYMBOLS, int((vocabulary.count() / PER_REDUCED) ** (1 / MIN_LENGTH)) + 1)
    own = materialize(reduced(vocabulary, symbols), "reduced")
    known = vocabulary.sparkSession.sparkContext.broadcast(bitmap(own.select("name")))
    met = neighbourhoods(vocabulary, symbols, known).hint("merge").join(own.select(F.col("word").alias("near"), "name"), "name")
    return met.where(_one_edit(F.col("word"), F.col("near"))).select("word", "near")


def _one_edit(a: Column, b: Column) -> Column:
    return (a != b) & (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b, 1) == 1)


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form: every round doubles the steps that a pointer spans."""
    reached = forms.select("word", F.col("form").alias("root"))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(reached.join(further.hint("merge"), "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reached = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return reached


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", symbols: int | None = None) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of five letters or more and at least three occurrences.

    A word's form is its near word of largest n, the first in code-point order among equals, if it is at least twice as frequent;
    the root is where forms lead. As n doubles on the way, a way is short and never round. Null texts have no words, a null id counts as an
    empty one, repeated rows count as often as they occur, other columns are not looked at.
    """
    vocabulary = materialize(words(docs, id_col, text_col).where(F.col("n") >= MIN_COUNT), "vocabulary")
    other = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    near = near_pairs(vocabulary, symbols).join(other.hint("merge"), "near").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = materialize(vocabulary.join(near.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best")).alias("best")).select(
        "word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots.hint("merge"), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
