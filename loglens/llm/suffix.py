"""Removal of repeated byte strings: anchors bring equal strings together, a Burrows-Wheeler interval search finds them.

Every ``length``-byte string of a text is a window. The least hash among the short grams inside a window is its anchor, so
equal windows have equal anchors, and consecutive windows mostly share one: such a run with the bytes it
covers is a segment. A window can only be repeated in another segment of the same anchor (or
twice in its own). Segments that occur twice are repeated throughout; the bytes of the others,
once each, meet those of the other segments of their anchor in one suffix array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import POWERS, mix64, prefix_sums, text_chunks
from loglens.sources.shared import materialize

LENGTH = 400
GRAM = 32
#: Segments of one anchor go to one suffix array up to this many bytes; beyond, window by window through a shuffle.
ARRAY_BYTES = 2 << 20
#: Anchors are gathered in one suffix array until it has so many bytes.
FILL_BYTES = 512 << 10


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of ``width`` values."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def segments(data: np.ndarray, length: int, gram: int):
    """anchor, first window, end window and number of anchor places of each segment of one text."""
    sums = prefix_sums(data)
    _, down = POWERS.upto(len(sums))
    grams = mix64((sums[gram:] - sums[:-gram]) * down[:len(data) - gram + 1])
    least = sliding_least(grams, length - gram + 1)
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    ends = np.append(starts[1:], len(least))
    anchors = least[starts]
    reach = length - gram
    places = [int(np.count_nonzero(grams[a:b + reach] == v)) for a, b, v in zip(starts, ends, anchors)]
    return anchors, starts, ends, places


def all_segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Per segment: id, mark (of its row's text), anchor, a and b (its windows), places, name (of its bytes)."""
    import xxhash

    schema = "id bigint, mark bigint, anchor bigint, a int, b int, places int, name1 bigint, name2 bigint"

    def run(batches):
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            for row, data, offsets in text_chunks(batch.column(2)):
                parts, rows = [[] for _ in range(6)], []
                for n, (p, q) in enumerate(zip(offsets[:-1], offsets[1:])):
                    if q - p < length:
                        continue
                    own = data[p:q]
                    anchors, starts, ends, places = segments(own, length, gram)
                    view = memoryview(own)
                    names = np.frombuffer(b"".join(
                        xxhash.xxh3_128_digest(view[a:b + length - 1]) for a, b in zip(starts, ends)), np.int64)
                    for part, values in zip(parts, (
                            anchors.view(np.int64), starts, ends, places, names[::2], names[1::2])):
                        part.append(values)
                    rows.append(np.full(len(starts), row + n))
                if rows:
                    at = pa.array(np.concatenate(rows))
                    kinds = (np.int64, np.int32, np.int32, np.int32, np.int64, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(at), marks.take(at)] +
                        [pa.array(np.concatenate(p).astype(k)) for p, k in zip(parts, kinds)],
                        ["id", "mark", "anchor", "a", "b", "places", "name1", "name2"])

    return docs.select("id", "mark", "text").mapInArrow(run, schema)


def suffix_order(symbols: np.ndarray, reach: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes ordered by their first ``reach`` symbols at least; places of suffixes; ranks by the first 4 symbols."""
    n = len(symbols)
    bits = max(1, int(size).bit_length())
    first = max(1, min(4, 62 // bits))
    padded = np.zeros(n + first, np.int64)
    padded[:n] = symbols + 1
    key = np.zeros(n, np.int64)
    for i in range(first):
        key = (key << bits) | padded[i:i + n]
    order = np.argsort(key)
    rank = _ranks(key, order)
    short, done = rank, first
    while done < reach and rank[order[-1]] < n - 1:
        after = np.zeros(n, np.int64)
        after[:n - done] = rank[done:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)
        rank = _ranks(key, order)
        done *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place, short


def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    sorted_ = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
    return rank


def repeated_windows(texts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Per text: for each of its windows, whether the same bytes start elsewhere in any of the texts.

    Intervals of suffixes with a common prefix are extended backward by every symbol before them, breadth first. A step at depth d
    yields the intervals of prefixes of d+1 bytes; the border behind such an interval, if no shorter prefix set it, is
    the place of a common prefix of d bytes, and only then is the interval extended further. Borders still
    unset at depth ``length`` stand between suffixes that share that many bytes.
    """
    marks = len(texts)
    symbols = np.concatenate([np.append(t.astype(np.int64) + marks, n) for n, t in enumerate(texts)])
    n = len(symbols)
    order, place, short = suffix_order(symbols, length, marks + 256)
    before = np.where(order > 0, symbols[order - 1], symbols[-1])
    back = place[order - 1]
    # the intervals of the first symbols' ranks begin the search
    ranks = short[order]
    known = np.ones(n + 1, bool)
    known[1:n] = ranks[1:] != ranks[:-1]
    low = np.flatnonzero(known[:-1])
    high = np.flatnonzero(known[1:])
    depth = max(1, min(4, 62 // max(1, int(marks + 256).bit_length())))
    while depth < length and len(low):
        low, high = _extended(low, high, before, back, marks + 256)
        new = ~known[high + 1]
        low, high = low[new], high[new]
        known[high + 1] = True
        depth += 1
    same = ~known
    hit = np.zeros(n, bool)
    hit[order] = same[:-1] | same[1:]
    out, at = [], 0
    for t in texts:
        out.append(hit[at:at + max(len(t) - length + 1, 0)])
        at += len(t) + 1
    return out


def _extended(low, high, before, back, size):
    """The intervals of all one-symbol extensions to the left."""
    single = low == high
    alone = back[low[single]]
    low, high = low[~single], high[~single]
    if not len(low):
        return alone, alone
    sizes = high - low + 1
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1]) + np.repeat(low - (ends - sizes), sizes)
    key = np.repeat(np.arange(len(low)), sizes) * size + before[at]
    by = np.argsort(key, kind="stable")
    key, to = key[by], back[at][by]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return (np.concatenate([alone, np.minimum.reduceat(to, starts)]),
            np.concatenate([alone, np.maximum.reduceat(to, starts)]))


def _ranges(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _searched(bodies: DataFrame, length: int) -> DataFrame:
    """id, mark, x, y: repeated windows of the single segments; all of an anchor's segments are in one array."""
    def search(rows):
        found = repeated_windows([np.frombuffer(r[5], np.uint8) for r in rows], length)
        out = [(r[1], r[2], r[3] + x, r[3] + y) for r, hit in zip(rows, found) if r[4] for x, y in _ranges(hit)]
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
            ["id", "mark", "x", "y"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[0] != rows[-1][0] and size >= FILL_BYTES:
                    yield search(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield search(rows)

    return (bodies.repartition("anchor").sortWithinPartitions("anchor")
            .select("anchor", "id", "mark", "a", "single", "body")
            .mapInArrow(run, "id bigint, mark bigint, x int, y int"))


def _by_window(bodies: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many bytes: every window is a row, and equal ones are counted."""
    import xxhash

    def run(batches):
        for batch in batches:
            for i, m, a, single, body in zip(*(c.to_pylist() for c in batch.columns)):
                view = memoryview(body)
                n = len(body) - length + 1
                names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[x:x + length]) for x in range(n)), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * n, pa.int64()), pa.array([m] * n, pa.int64()), pa.array([single] * n, pa.bool_()),
                     pa.array(np.arange(a, a + n, dtype=np.int32)), pa.array(names[::2]), pa.array(names[1::2])],
                    ["id", "mark", "single", "x", "w1", "w2"])

    windows = bodies.select("id", "mark", "a", "single", "body").mapInArrow(
        run, "id bigint, mark bigint, single boolean, x int, w1 bigint, w2 bigint")
    counts = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return windows.where("single").join(counts, ["w1", "w2"]).select(
        "id", "mark", "x", (F.col("x") + 1).alias("y"))


def repeated(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """id, mark, x, y: ranges of windows that start anywhere else, from docs (id, mark, text as bytes)."""
    parts = materialize(all_segments(docs, length, gram), "segments")
    # a table of its own, so that the rows of a common anchor are dealt by the join alone and can be split
    shared = materialize(parts.groupBy("anchor").agg(F.sum("places").alias("n")).where("n > 1").select("anchor"), "anchors")
    near = materialize(parts.join(shared, "anchor", "left_semi"), "shared-anchors")
    named = materialize(near.groupBy("anchor", "name1", "name2").agg(
        F.count(F.lit(1)).alias("copies"), F.max("places").alias("places"),
        F.min(F.struct("id", "mark", "a", "b")).alias("one")), "distinct-segments")
    whole = near.join(named.where("copies > 1").select("anchor", "name1", "name2"), ["anchor", "name1", "name2"]).select(
        "id", "mark", F.col("a").alias("x"), F.col("b").alias("y"))
    open_ = named.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("copies") == 1, 1)).alias("singles"),
        F.max("places").alias("most"), F.sum(F.expr(f"one.b - one.a + {length}")).alias("bytes")
    ).where("singles > 0 AND (n > 1 OR most > 1)").select("anchor", "bytes")
    wanted = materialize(named.join(open_, "anchor").select(
        "anchor", "bytes", "one.*", (F.col("copies") == 1).alias("single")), "open-segments")
    by_row = wanted.groupBy("id", "mark").agg(F.collect_list(F.struct("anchor", "bytes", "a", "b", "single")).alias("parts"))
    texts = docs.select("id", "mark", "text").join(
        by_row.withColumnsRenamed({"id": "i", "mark": "m"}), F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")))
    # rows with the same id and text would give their segments twice
    bodies = materialize(texts.select("id", "mark", F.explode("parts").alias("p"), "text").select(
        "id", "mark", "p.*", F.expr(f"substring(text, p.a + 1, p.b - p.a + {length - 1})").alias("body"))
        .dropDuplicates(["id", "mark", "anchor", "a"]), "segment-bytes")
    return whole.unionByName(_searched(bodies.where(F.col("bytes") <= ARRAY_BYTES), length)).unionByName(
        _by_window(bodies.where(F.col("bytes") > ARRAY_BYTES), length))


def deduplicated(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (start, end), kept (bytes) of every row.

    Texts are UTF-8 bytes, null ones empty. Each byte covered by a string of ``length`` bytes that also starts anywhere else goes, in the
    same text or another one, judged on the input; matches don't cross texts. Repeated rows are texts of their own, so all of their long
    strings are repeated. A null id is an id like others.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("plain"))
    rows = rows.select("id", F.xxhash64("plain").alias("mark"), F.col("plain").cast("binary").alias("text"))
    found = repeated(rows, length, gram)
    gone = materialize(found.groupBy("id", "mark").agg(
        F.collect_set(F.struct("x", "y")).alias("ranges")), "repeated-ranges")
    joined = rows.join(gone.withColumnsRenamed({"id": "i", "mark": "m"}),
                       F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left")
    schema = ("doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
              "spans array<struct<start: bigint, end: bigint>>, kept binary")

    def cut(batches):
        for batch in batches:
            out = []
            for i, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                edge = np.zeros(len(data) + 1, np.int64)
                if ranges.is_valid:
                    flat = ranges.values
                    np.add.at(edge, flat.field("x").to_numpy(), 1)
                    np.add.at(edge, flat.field("y").to_numpy() + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = _ranges(gone)
                out.append((i, len(data), int(gone.sum()), len(spans),
                            [{"start": a, "end": b} for a, b in spans], data[~gone].tobytes()))
            kinds = pa.schema([
                ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
            for start in range(0, len(out), 256):
                columns = list(zip(*out[start:start + 256]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    return joined.select("id", "text", "ranges").mapInArrow(cut, schema)
