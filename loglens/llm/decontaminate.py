"""Benchmark decontamination by spaced seeds and substitution-tolerant verification.

Seeds of fixed masks are hashed from every place of the texts and of the benchmark's items, and joined. A joined pair says which text, which
item and how far they are shifted against each other; there the aligned words are compared. Texts are known by two hashes, so copies are
compared once. Seeds that (probably) no item has are left out by a bitmap of bounded size before anything is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.bits import bitmap
from loglens.llm.common import NOT_WORD, mix64, prefix_sums, span_hashes, text_chunks, words_of
from loglens.sources.shared import materialize

#: Places of a window that a seed compares; the places between them may differ. Any 13 words of which 11 agree
#: hold at least one of them in agreement (checked by a test).
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 5, 6), (0, 2, 3, 4, 7), (0, 1, 4, 6, 7))
WINDOW, AGREEING = 13, 11


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each row's begin."""
    starts, ends, rows = words_of(data, offsets, NOT_WORD)
    return span_hashes(prefix_sums(data), starts, ends), np.searchsorted(rows, np.arange(len(offsets)))


def _seeds(words: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    runs = max(len(words) - mask[-1], 0)
    out = np.full(runs, number + 1, np.uint64)
    for place in mask:
        out = mix64(out * np.uint64(0x2545F4914F6CDD1D) + words[place:place + runs])
    return out


def _named(text: "F.Column", prefix: str) -> list["F.Column"]:
    return [F.xxhash64(text).alias(f"{prefix}h"), F.hash(text).alias(f"{prefix}g")]


def _bodies(rows: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """Hashes and lower-cased bytes of the texts; null and empty ones have no words."""
    text = F.col(text_col)
    return rows.where(F.length(text) > 0).select(*_named(text, prefix), F.encode(F.lower(text), "UTF-8").alias(f"{prefix}body"))


def _seed_rows(bodies: DataFrame, prefix: str, known=None) -> DataFrame:
    """h, g, place, seed of every place and mask of texts that have a window; with ``known`` of the seeds it (probably) holds."""
    names = [f"{prefix}h", f"{prefix}g", f"{prefix}place", "seed"]

    def run(batches):
        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)]
            for row, data, offsets in text_chunks(batch.column(2)):
                words, bounds = _words(data, offsets)
                lengths = np.diff(bounds)
                for number, mask in enumerate(MASKS):
                    seeds = _seeds(words, mask, number)
                    own = np.searchsorted(bounds, np.arange(len(seeds)), "right") - 1
                    inside = (np.arange(len(seeds)) + mask[-1] < bounds[own + 1]) & (lengths[own] >= WINDOW)
                    if known is not None:
                        inside &= known.value.has(seeds)
                    at = np.flatnonzero(inside)
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array(k[row + own[at]]) for k in keys], pa.array(at - bounds[own[at]]), pa.array(seeds[at].view(np.int64))],
                        names)

    schema = f"{prefix}h bigint, {prefix}g int, {prefix}place bigint, seed bigint"
    return bodies.mapInArrow(run, schema)


def _aligned(own: np.ndarray, text: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """First word in ``text``, words and agreeing words of the overlap at this shift, from its first good window to its last."""
    begin, end = max(0, -shift), min(len(own), len(text) - shift)
    if end - begin < WINDOW:
        return None
    sums = np.concatenate([[0], np.cumsum(own[begin:end] == text[begin + shift:end + shift])])
    good = np.flatnonzero(sums[WINDOW:] - sums[:-WINDOW] >= AGREEING)
    if not len(good):
        return None
    first, last = int(good[0]), int(good[-1]) + WINDOW
    return begin + shift + first, last - first, int(sums[last] - sums[first])


def _verify(batches):
    for batch in batches:
        out = [[] for _ in range(6)]
        # pairs of a text follow each other more often than not
        seen: dict[bytes, np.ndarray] = {}

        def hashed(text: bytes) -> np.ndarray:
            if text not in seen:
                if len(seen) > 64:
                    seen.clear()
                seen[text] = _words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
            return seen[text]

        for h, g, item, text, own, shifts in zip(*[c.to_pylist() for c in batch.columns]):
            for shift in sorted(shifts):
                if found := _aligned(hashed(own), hashed(text), shift):
                    for column, value in zip(out, (h, g, item, *found)):
                        column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:]]],
            ["h", "g", "item_id", "first_word", "n_words", "n_agreeing"])


def overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
             item_text_col: str = "text") -> DataFrame:
    """h, g (hashes of the text), item_id, first_word, n_words, n_agreeing of the overlaps of the distinct texts of ``docs``.

    Words are runs of letters and digits, lower-cased. An overlap is where 13 words of the item stand
    with at most two substituted; it runs from the first such window at a shift to the last. Null or empty texts have none;
    items of fewer than 13 words, null items and null item texts match nothing.
    """
    context = docs.sparkSession.sparkContext
    items = materialize(benchmark.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("item_text")).distinct(), "benchmark")
    item_bodies = _bodies(items.select("item_text").distinct(), "item_text", "i_")
    seeds = materialize(_seed_rows(item_bodies, "i_"), "item-seeds")
    known = context.broadcast(bitmap(seeds.select("seed").distinct()))
    bodies = _bodies(docs.select(F.col(text_col).alias("text")), "text", "")
    met = _seed_rows(bodies, "", known).distinct().join(seeds, "seed").select(
        "h", "g", "i_h", "i_g", (F.col("place") - F.col("i_place")).alias("shift")).distinct()
    pairs = materialize(met.groupBy("h", "g", "i_h", "i_g").agg(F.collect_list("shift").alias("shifts")), "seed-pairs")
    texts = bodies.join(pairs.select("h", "g").distinct(), ["h", "g"], "left_semi").dropDuplicates(["h", "g"])
    named = _bodies(items, "item_text", "i_").distinct()
    numbers = items.select("item_id", *_named(F.col("item_text"), "i_"))
    sides = pairs.join(texts, ["h", "g"]).join(named, ["i_h", "i_g"]).join(numbers, ["i_h", "i_g"]).select(
        "h", "g", "item_id", "body", "i_body", "shifts")
    schema = "h bigint, g int, item_id bigint, first_word bigint, n_words bigint, n_agreeing bigint"
    return materialize(sides.mapInArrow(_verify, schema), "overlaps")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, first_word, n_words, n_agreeing of every overlap; repeated rows repeat theirs."""
    found = overlaps(docs, benchmark, text_col)
    return docs.select(F.col(id_col).alias("doc_id"), *_named(F.col(text_col), "")).join(found, ["h", "g"]).drop("h", "g")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any overlap, all columns as they are."""
    found = overlaps(docs, benchmark, text_col).select("h", "g").distinct()
    # the columns travel as one, so none of them can clash with the hashes
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), *_named(F.col(text_col), ""))
    return whole.join(found, ["h", "g"], "left_anti").select("document.*")
