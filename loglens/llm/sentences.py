"""Removal of repeated runs of consecutive sentences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import LOWER, NOT_WORD, WHITE, prefix_sums, span_hashes, text_chunks, words_of
from loglens.sources.shared import materialize

#: A run has so many sentences and words at least; one sentence of LONG words is a run by itself.
RUN, RUN_WORDS, LONG = 2, 16, 50

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def split_sentences(data: np.ndarray, offsets: np.ndarray):
    """Row, first byte, hash and number of words of each sentence with a word.

    Sentences end at a stop before white space, at a line's end or at the text's; hashes are of their lower-cased words.
    """
    low = LOWER[data]
    starts, ends, rows = words_of(low, offsets, NOT_WORD)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.astype(np.uint64), empty
    after = np.append(WHITE[data[1:]], True)
    stops = np.cumsum((_STOP[data] & after) | (data == 0x0A))
    number = stops[starts]
    new = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (rows[1:] != rows[:-1])]))
    words = prefix_sums(span_hashes(prefix_sums(low), starts, ends))
    ends = np.append(new[1:], len(starts))
    return rows[new], starts[new], span_hashes(words, new, ends), ends - new


def runs(rows: np.ndarray, words: np.ndarray, sentences: int, least: int, long: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end sentence of the shortest run from each sentence, of that up to each sentence, and of each sentence of ``long`` words.

    Those inside of it cover every run: where none from a sentence ends in it, the shortest one up to its end reaches back.
    """
    total = np.concatenate([[0], np.cumsum(words)])
    every = np.arange(len(rows))
    end = np.maximum(np.searchsorted(total, total[:-1] + least), every + sentences)
    own = (end <= len(rows)) & (end <= np.searchsorted(rows, rows, "right"))
    first, end = every[own], end[own]
    back = np.minimum(np.searchsorted(total, total[1:] - least, "right") - 1, every + 1 - sentences)
    own = (back >= 0) & (back >= np.searchsorted(rows, rows))
    alone = every[words >= long]
    both = np.unique(np.stack([np.concatenate([first, back[own], alone]), np.concatenate([end, every[own] + 1, alone + 1])]), axis=1)
    return both[0], both[1]


def spans(docs: DataFrame, sentences: int, words: int, long: int) -> DataFrame:
    """id, mark, pos, n (its sentences), span (its hash) of every run of docs (id, mark, text)."""
    def find(batches):
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(2)):
                rows, _, hashes, sizes = split_sentences(data, offsets)
                first, end = runs(rows, sizes, sentences, words, long)
                names = span_hashes(prefix_sums(hashes), first, end)
                at = pa.array(rows[first] + row)
                pos = first - np.searchsorted(rows, rows[first])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(pos.astype(np.int32)),
                     pa.array((end - first).astype(np.int32)), pa.array(names.view(np.int64))],
                    ["id", "mark", "pos", "n", "span"])

    return docs.mapInArrow(find, "id bigint, mark bigint, pos int, n int, span bigint")


def repeated_sentences(docs: DataFrame, sentences: int, words: int, long: int) -> DataFrame:
    """id, mark, gone (numbers of sentences covered by a repeated run that isn't its first) of docs (id, mark, text)."""
    every = materialize(spans(docs, sentences, words, long), "spans")
    # a table of its own, so that the rows of a very common run are dealt by the join alone and can be split
    many = materialize(every.groupBy("span").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("span"), "repeated-spans")
    shared = materialize(every.join(many, "span", "left_semi"), "shared-spans")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "mark", "pos")
    first = materialize(shared.groupBy("span").agg(F.min(place).alias("first")), "first-spans")
    later = shared.join(first, "span").where(
        "NOT (first.id <=> id AND first.mark = mark AND first.pos = pos)").groupBy("id", "mark").agg(
            F.collect_set(F.struct("pos", "n")).alias("runs"))
    return later.select("id", "mark", F.array_distinct(F.flatten(F.transform(
        "runs", lambda r: F.sequence(r["pos"], r["pos"] + r["n"] - 1)))).alias("gone"))


def deduplicated(
    docs: DataFrame, sentences: int = RUN, words: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text",
    long: int = LONG,
) -> DataFrame:
    """doc_id, n_sentences, n_removed, text (what is left) of every row.

    A run is any number of consecutive sentences that are ``sentences`` at least and have ``words`` words, or one sentence of ``long``
    words. Runs of equal sentences are repeated; the first, by (id, position), stays, and each
    sentence of another goes with the white space behind it. Texts too short for a run hold none. Null texts stay null, with 0 sentences;
    the null id is the last; rows with the same id and text count as one.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("plain"))
    rows = rows.select("id", F.xxhash64("plain").alias("mark"), F.col("plain").cast("binary").alias("text"))
    filled = rows.select("id", "mark", F.coalesce("text", F.lit("").cast("binary")).alias("text"))
    gone = materialize(repeated_sentences(filled, sentences, words, long), "repeated-sentences")
    joined = rows.join(gone.withColumnsRenamed({"id": "i", "mark": "m"}),
                       F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left")

    def cut(batches):
        for batch in batches:
            ids, filled, gone = batch.column(0), batch.column(1).fill_null(b""), batch.column(2)
            for row, data, offsets in text_chunks(filled):
                rows, starts, _, _ = split_sentences(data, offsets)
                bounds = np.searchsorted(rows, np.arange(len(offsets)))
                counts, removed, texts = [], [], []
                for n, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    text = data[offsets[n]:offsets[n + 1]]
                    out = gone[row + n]
                    drop = np.zeros(b - a, bool)
                    if out.is_valid:
                        drop[out.values.to_numpy()] = True
                        edges = np.append(starts[a:b], offsets[n + 1]) - offsets[n]
                        edges[0] = 0
                        text = text[~np.repeat(drop, np.diff(edges))]
                    counts.append(int(b - a))
                    removed.append(int(drop.sum()))
                    texts.append(text.tobytes() if batch.column(1)[row + n].is_valid else None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(counts)), pa.array(counts, pa.int32()), pa.array(removed, pa.int32()),
                     pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_sentences", "n_removed", "text"])

    return joined.select("id", "text", "gone").mapInArrow(
        cut, "doc_id bigint, n_sentences int, n_removed int, text string")
