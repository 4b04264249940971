"""Exact token-bucket rate limiting in event time.

A bucket holds up to ``burst`` tokens, starts full, gains ``max_lines`` tokens per ``window_ms``
and gives one token per line; a line that finds no token is dropped. Everything is integer: with
the common divisor removed, a line costs ``cost`` units, a millisecond brings ``gain`` units and
the bucket holds ``cap = burst * cost``. The code tracks the *debt* ``v = cap - tokens``.

Lines are counted per (key, millisecond). The counts are cut into ten-minute chunks, so that no
task replays a whole key, although a bucket is sequential by nature. Per chunk two facts are needed on entry:

* ``u``, the debt of a bucket that may also give fractions of a line. Its step is
  ``u -> min(cap, max(u - elapsed, 0) + lines * cost)``, and a chain of such steps is again
  "shift, then clamp": three numbers per chunk, chained over the chunks of a key.
* the debt's phase. The true debt is the one number in ``(u - cost, u]`` whose distance to the
  clock has a fixed remainder modulo ``cost``. The remainder changes only when the bucket fills up,
  which takes ``u - elapsed < cost``. What the moments of a chunk do to any remainder is a short
  list of pieces, and those are chained as well.

With both, every chunk is replayed on its own.
"""

from __future__ import annotations

import time as clock
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from math import gcd

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loglens.functions.parse import line_bytes
from loglens.operators.ordering import top_per_group
from loglens.sources.shared import delete, materialize, tables_in

CHUNK_MS = 600_000
# On streams, how far a line's stamp may be ahead of the batch's time, and how late a line may
# come before a bucket that has filled up is forgotten.
TOLERANCE_MS = 60_000
# Chunk number below that of any time.
BEFORE_ALL = -(2 ** 62)


@dataclass(frozen=True)
class RateLimit:
    """``max_lines`` per ``window_ms`` with bursts of ``burst``; 0 lines means no limit."""

    max_lines: int = 0
    window_ms: int = 1000
    burst: int = 100

    def __post_init__(self):
        if self.max_lines < 0 or self.window_ms <= 0 or self.burst < 0:
            raise ValueError(f"not a rate limit: {self}")

    @property
    def gain(self) -> int:
        return self.max_lines // gcd(self.max_lines, self.window_ms)

    @property
    def cost(self) -> int:
        return self.window_ms // gcd(self.max_lines, self.window_ms)

    @property
    def cap(self) -> int:
        return self.burst * self.cost


@dataclass(frozen=True)
class ByteLimit:
    """``max_bytes`` per ``window_ms`` with bursts of ``burst`` bytes; 0 bytes means no limit."""

    max_bytes: int = 0
    window_ms: int = 1000
    burst: int = 1_000_000

    def __post_init__(self):
        if self.max_bytes < 0 or self.window_ms <= 0 or self.burst < 0:
            raise ValueError(f"not a rate limit: {self}")

    @property
    def gain(self) -> int:
        return self.max_bytes // gcd(self.max_bytes, self.window_ms)

    @property
    def cost(self) -> int:
        return self.window_ms // gcd(self.max_bytes, self.window_ms)

    @property
    def cap(self) -> int:
        return self.burst * self.cost


_ARROW = {"string": pa.string(), "bigint": pa.int64()}


def _values(column: pa.Array) -> list:
    if pa.types.is_integer(column.type) and column.null_count == 0:
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _rows(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        yield from zip(*[_values(batch.column(i)) for i in range(width)])


def _batches(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]], size: int = 20_000):
    names = [name for name, _ in fields]
    while held := list(islice(rows, size)):
        columns = [pa.array(values, kind) for values, (_, kind) in zip(zip(*held), fields)]
        yield pa.RecordBatch.from_arrays(columns, names)


def _over_sorted(df: DataFrame, keys: list[str], order: list[str], columns: list[str],
                 step, schema: str) -> DataFrame:
    """Run ``step(rows) -> rows`` over partitions hashed by ``keys`` and sorted by keys and order.

    Rows stream through: a step keeps a few numbers per key, or at most the moments of the one
    chunk it is in.
    """
    fields = [(name, _ARROW[kind]) for name, kind in (part.split() for part in schema.split(","))]
    width = len(columns)

    def run(batches):
        return _batches(step(_rows(batches, width)), fields)

    # The shuffle goes by a column made for it. Were it by the keys themselves, Spark would drop it
    # behind a join on the same keys, and then may still split that join's skewed partitions.
    return (df.select(*columns, F.xxhash64(*keys).alias("_slot"))
            .repartition("_slot").sortWithinPartitions(*keys, *order)
            .mapInArrow(run, schema))


def _chunk_shapes(counted: DataFrame, limit: RateLimit | ByteLimit) -> DataFrame:
    """Per chunk: first and last time, and the shift and clamp of ``u`` from after its first
    arrival's wait to its end.

    Each moment is itself a shift and clamp of three numbers, and so is a chain of them; a chunk has
    a moment per millisecond at most, which bounds its list.
    """
    def long(value: int) -> Column:
        return F.lit(value).cast("bigint")

    def after(state: Column, moment: Column) -> Column:
        waited = (moment["_ms"] - state["last"]) * long(limit.gain)
        added = moment["_n"] * long(limit.cost)

        def end(bound: Column) -> Column:
            return F.least(F.greatest(bound - waited, long(0)) + added, long(limit.cap))

        return F.struct(
            moment["_ms"].alias("last"), end(state["low"]).alias("low"), end(state["high"]).alias("high"),
            (state["shift"] + added - waited).alias("shift"))

    lists = counted.groupBy("_key", "_chunk").agg(F.sort_array(F.collect_list(F.struct("_ms", "_n"))).alias("moments"))
    first = F.col("moments")[0]["_ms"]
    begin = F.struct(first.alias("last"), long(0).alias("low"), long(limit.cap).alias("high"), long(0).alias("shift"))
    return lists.select(
        "_key", "_chunk", first.alias("_first"), F.aggregate("moments", begin, after).alias("_end")).select(
        "_key", "_chunk", "_first", F.col("_end.last").alias("_last"), F.col("_end.low").alias("_low"),
        F.col("_end.high").alias("_high"), F.col("_end.shift").alias("_shift"))


def _chunk_starts(limit: RateLimit | ByteLimit):
    """Per chunk: time of the arrival before it (null for the first) and ``u`` after that."""
    gain = limit.gain

    def step(rows):
        owner, u, last_ms = None, 0, None
        for key, chunk, first, last, low, high, shift in rows:
            if key != owner:
                owner, u, last_ms = key, 0, None
            yield key, chunk, last_ms, u
            waited = 0 if last_ms is None else (first - last_ms) * gain
            u = min(max(max(u - waited, 0) + shift, low), high)
            last_ms = last

    return step


def _phase_pieces(moments: list[tuple[int, int]], cost: int) -> list[tuple[int, int, int]]:
    """What moments ``(clock remainder, u left)`` do to any phase: sorted pieces
    ``(begin, end, phase after)`` of [0, cost); phases in no piece stay as they are.

    A moment sets all phases from ``clock + left + 1`` round to ``clock`` to ``clock``. Phases
    once set to the same value stay together, so few groups are left after a while.
    """
    begins, ends = [0], [cost]           # phases not touched so far
    places, groups = [], []              # present phase of each group, sorted
    joined, pieces = [], []              # group -> group it went into; (begin, end, group)
    for clock, left in moments:
        first, group, caught = (clock + left + 1) % cost, len(joined), False
        for low, high in [(first, clock + 1)] if first <= clock else [(0, clock + 1), (first, cost)]:
            i, j = bisect_left(places, low), bisect_left(places, high)
            for other in groups[i:j]:
                joined[other] = group
            caught |= i < j
            del places[i:j], groups[i:j]
            i, j = bisect_right(ends, low), bisect_left(begins, high)
            if i < j:
                pieces += [(max(b, low), min(e, high), group)
                           for b, e in zip(begins[i:j], ends[i:j])]
                caught = True
                rest = [(b, e) for b, e in ((begins[i], low), (high, ends[j - 1])) if b < e]
                begins[i:j], ends[i:j] = [b for b, _ in rest], [e for _, e in rest]
        if caught:
            joined.append(group)
            at = bisect_left(places, clock)
            places.insert(at, clock)
            groups.insert(at, group)
    final = dict(zip(groups, places))
    merged = []
    for begin, end, group in sorted(pieces):
        while joined[group] != group:
            joined[group] = joined[joined[group]]
            group = joined[group]
        if merged and merged[-1][1] == begin and merged[-1][2] == final[group]:
            begin = merged.pop()[0]
        merged.append((begin, end, final[group]))
    return merged


def _phase_changes(limit: RateLimit):
    """Per chunk: how it changes the phase it is entered with, as numbered pieces. Number -1
    stands for the chunk itself."""
    gain, cost, cap = limit.gain, limit.cost, limit.cap

    def pieces(current, moments):
        # A saturated bucket leaves a piece for each moment that keeps its one phase: nothing to chain.
        for i, (begin, end, after) in enumerate(_phase_pieces(moments, cost)):
            if end - begin > 1 or after != begin:
                yield (*current, i, begin, end, after)

    def step(rows):
        current, at, moments = None, None, []
        for key, chunk, ms, n, start_ms, start_u in rows:
            if chunk != at or key != current[0]:
                yield from pieces(current, moments)
                current, at, moments = (key, chunk), chunk, []
                yield key, chunk, -1, 0, 0, 0
                u, last = start_u, start_ms
            left = 0 if last is None else u - (ms - last) * gain
            if left <= 0:
                left, moments = 0, [(ms * gain % cost, 0)]
            elif left < cost:
                moments.append((ms * gain % cost, left))
            u = left + n * cost
            if u > cap:
                u = cap
            last = ms
        yield from pieces(current, moments)

    return step


def _chunk_phases():
    """Per chunk: the phase on entry."""

    def step(rows):
        owner, phase, after = None, 0, 0
        for key, chunk, number, begin, end, value in rows:
            if key != owner:
                owner, phase, after = key, 0, 0
            if number < 0:
                phase = after
                yield key, chunk, phase
            elif begin <= phase < end:
                after = value

    return step


def _accepted(limit: RateLimit):
    """Per millisecond: how many lines find a token, and the debt after them; where none does,
    only for the last of a chunk. The real bucket, chunk by chunk."""
    gain, cost, cap = limit.gain, limit.cost, limit.cap

    def step(rows):
        current, at, taken, last, debt = None, None, 1, 0, 0
        for key, chunk, ms, n, start_ms, start_u, phase in rows:
            if chunk != at or key != current:
                if not taken:
                    yield current, last, 0, debt
                current, at = key, chunk
                if start_ms is None:
                    debt, last = 0, ms
                else:
                    last = start_ms
                    debt = start_u - (start_u + last * gain - phase) % cost
            debt -= (ms - last) * gain
            if debt < 0:
                debt = 0
            taken = (cap - debt) // cost
            if taken > n:
                taken = n
            last = ms
            if taken:
                debt += taken * cost
                yield key, ms, taken, debt
        if not taken:
            yield current, last, 0, debt

    return step


def accepted_counts(pairs: DataFrame, limit: RateLimit, carried: DataFrame | None = None) -> DataFrame:
    """``(_key, _ms, accepted, debt)`` for the lines counted in ``pairs (_key, _ms, _n)``.

    ``pairs`` are read up to three times, so they should be stored. ``carried (_key, _last, _debt)`` holds buckets as
    an earlier batch left them; no line of a key may be older than that.
    """
    counted = pairs.select("_key", "_ms", "_n")
    if carried is not None:
        phase = F.pmod(F.col("_last") * limit.gain + F.col("_debt"), F.lit(limit.cost))
        carried = carried.select("_key", "_last", "_debt", phase.cast("bigint").alias("_clock"))
    return _over_sorted(
        _chunks(counted, limit, carried), ["_key", "_chunk"], ["_ms"],
        ["_key", "_chunk", "_ms", "_n", "_start_ms", "_start_u", "_phase"], _accepted(limit),
        "_key string, _ms bigint, accepted bigint, debt bigint")


def _starts(counted: DataFrame, limit: RateLimit | ByteLimit, carried: DataFrame | None) -> DataFrame:
    """``u`` and the time before it at the start of every chunk of ``counted (_key, _chunk, _ms, _n)``."""
    shapes = _chunk_shapes(counted, limit)
    if carried is not None:
        # A carried bucket acts like a chunk ahead of all others that ends in its debt.
        shapes = shapes.unionByName(carried.select(
            "_key", F.lit(BEFORE_ALL).alias("_chunk"), F.col("_last").alias("_first"), "_last",
            F.col("_debt").alias("_low"), F.col("_debt").alias("_high"),
            F.lit(0).cast("bigint").alias("_shift")))
    return _over_sorted(
        shapes, ["_key"], ["_chunk"],
        ["_key", "_chunk", "_first", "_last", "_low", "_high", "_shift"], _chunk_starts(limit),
        "_key string, _chunk bigint, _start_ms bigint, _start_u bigint")


def _chunks(counted: DataFrame, limit: RateLimit, carried: DataFrame | None) -> DataFrame:
    """Counts cut by time, each chunk with the state its bucket has on entry."""
    per_chunk, per_key = ["_key", "_chunk"], ["_key"]
    counted = counted.withColumn("_chunk", F.floor(F.col("_ms") / CHUNK_MS))
    starts = _starts(counted, limit, carried)
    if limit.cost == 1:
        return counted.join(starts, per_chunk).withColumn("_phase", F.lit(0))
    begun = counted.join(materialize(starts, "starts"), per_chunk)
    changes = _over_sorted(
        begun, per_chunk, ["_ms"], ["_key", "_chunk", "_ms", "_n", "_start_ms", "_start_u"],
        _phase_changes(limit),
        "_key string, _chunk bigint, _number bigint, _begin bigint, _end bigint, _after bigint")
    if carried is not None:
        zero = F.lit(0).cast("bigint")
        changes = changes.unionByName(carried.select(
            "_key", F.lit(BEFORE_ALL).alias("_chunk"), zero.alias("_number"), zero.alias("_begin"),
            F.lit(limit.cost).cast("bigint").alias("_end"), F.col("_clock").alias("_after")))
    phases = _over_sorted(
        changes, per_key, ["_chunk", "_number"],
        ["_key", "_chunk", "_number", "_begin", "_end", "_after"], _chunk_phases(),
        "_key string, _chunk bigint, _phase bigint")
    return begun.join(phases, per_chunk)


def _keyed(lines: DataFrame, key: tuple[str, ...] | None, time: Column) -> DataFrame:
    """Lines with the bucket they belong to as one text, and their millisecond."""
    if not key:
        text = F.lit("all")
    elif len(key) == 1:
        text = F.coalesce(F.concat(F.lit("="), F.col(key[0]).cast("string")), F.lit("null"))
    else:
        text = F.to_json(F.struct(*key), {"ignoreNullFields": "false"})
    return lines.withColumns({"_key": text, "_ms": time})


def arrivals(lines: DataFrame, *, key: tuple[str, ...] | None = ("source",), time: str | Column = "event_ms",
             by: tuple[str, ...] = ()) -> DataFrame:
    """``(_key, _ms, *by, _n, _bytes)``: lines and bytes of every bucket and millisecond, as a stored table.

    It holds all that a limit and the counters need to know of the lines that come in, so neither reads them again.
    """
    time = F.col(time) if isinstance(time, str) else time
    return materialize(_arrivals(_keyed(lines, key, time), by), "arrivals")


def _arrivals(keyed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return keyed.groupBy("_key", "_ms", *by).agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(line_bytes(F.col("value"))), F.lit(0)).alias("_bytes"))


def _per_moment(arrived: DataFrame) -> DataFrame:
    return arrived.groupBy("_key", "_ms").agg(F.sum("_n").alias("_n"))


def _take(keyed: DataFrame, granted: DataFrame, limit: RateLimit, order: list[str]) -> DataFrame:
    """The lines whose place in their (key, millisecond) is among the accepted ones."""
    # No more than ``burst`` lines of one millisecond can ever pass.
    candidates = top_per_group(
        keyed, ["_key", "_ms"], [F.col(c) for c in order], limit.burst, "_position",
        F.struct(*order))
    taken = granted.filter(F.col("accepted") > 0).select("_key", "_ms", "accepted")
    return candidates.join(taken, ["_key", "_ms"]).filter(F.col("_position") <= F.col("accepted"))


def grant(lines: DataFrame, limit: RateLimit, *, key: tuple[str, ...] | None = ("source",),
          time: str = "event_ms", arrived: DataFrame | None = None) -> DataFrame:
    """``(_key, _ms, accepted)``: how many lines of each bucket and millisecond pass.

    ``arrived`` is the result of ``arrivals`` for the same key and time, if there already is one.
    """
    if arrived is None:
        arrived = materialize(_keyed(lines, key, F.col(time)).groupBy("_key", "_ms").agg(
            F.count(F.lit(1)).alias("_n")), "arrivals")
    elif set(arrived.columns) - {"_key", "_ms", "_n", "_bytes"}:
        arrived = materialize(_per_moment(arrived), "arrivals")
    return accepted_counts(arrived, limit)


def rate_limit(lines: DataFrame, limit: RateLimit, *, key: tuple[str, ...] | None = ("source",),
               time: str = "event_ms", granted: DataFrame | None = None) -> DataFrame:
    """The lines that find a token, one bucket per ``key`` (``None``: one for all).

    ``time`` is a non-null column of epoch milliseconds. Lines of the same key and millisecond
    are taken by source and line number. ``granted`` is the result of ``grant`` if there
    already is one.
    """
    if limit.max_lines == 0:
        return lines
    if granted is None:
        granted = grant(lines, limit, key=key, time=time)
    kept = _take(_keyed(lines, key, F.col(time)), granted, limit, ["source", "line_number"])
    return kept.select(*lines.columns)


def _room(limit: ByteLimit):
    """Per millisecond: the debt that its first line meets."""
    gain, cost, cap = limit.gain, limit.cost, limit.cap

    def step(rows):
        current, at, u, last = None, None, 0, 0
        for key, chunk, ms, n, start_ms, start_u in rows:
            if chunk != at or key != current:
                current, at = key, chunk
                u, last = (0, ms) if start_ms is None else (start_u, start_ms)
            u -= (ms - last) * gain
            if u < 0:
                u = 0
            if u < cap:
                yield key, ms, u
            u += n * cost
            if u > cap:
                u = cap
            last = ms

    return step


def rate_limit_bytes(lines: DataFrame, limit: ByteLimit, *, key: tuple[str, ...] | None = ("source",),
                     time: str = "event_ms") -> DataFrame:
    """The lines that find as many tokens as they have bytes, one bucket per ``key``.

    A refused line takes what is left in the bucket, so a source that sends too much is held back until it slows down, and what a
    moment does to a bucket depends on its bytes alone: it is a shift and a clamp. So chunks of time are replayed
    in parallel, also those of one key. Empty lines always pass. Lines of the same key and millisecond are taken by source and line number.
    """
    if limit.max_bytes == 0:
        return lines
    keyed = _keyed(lines, key, F.col(time)).withColumn("_size", line_bytes(F.coalesce("value", F.lit(""))))
    counted = materialize(keyed.groupBy("_key", "_ms").agg(F.sum("_size").alias("_n")), "arrivals").withColumn(
        "_chunk", F.floor(F.col("_ms") / CHUNK_MS))
    begun = counted.join(_starts(counted, limit, None), ["_key", "_chunk"])
    room = _over_sorted(
        begun, ["_key", "_chunk"], ["_ms"], ["_key", "_chunk", "_ms", "_n", "_start_ms", "_start_u"], _room(limit),
        "_key string, _ms bigint, _debt bigint")
    order = [F.col("source"), F.col("line_number")]
    # No more than ``burst`` lines with bytes can pass in a millisecond, so no more are summed up.
    filled = top_per_group(keyed.filter("_size > 0").join(room, ["_key", "_ms"]), ["_key", "_ms"], order, limit.burst,
                           "_position", F.struct(*order))
    upto = Window.partitionBy("_key", "_ms").orderBy("_position").rowsBetween(Window.unboundedPreceding, 0)
    kept = filled.withColumn("_sum", F.sum("_size").over(upto)).filter(
        F.col("_debt") + F.col("_sum") * F.lit(limit.cost).cast("bigint") <= F.lit(limit.cap).cast("bigint"))
    return kept.select(*lines.columns).unionByName(keyed.filter("_size = 0").select(*lines.columns))


def rate_limit_batch(batch: DataFrame, limit: RateLimit, state_dir: str, batch_id: int, *,
                     key: tuple[str, ...] | None = ("source",), time: str | None = None,
                     now_ms: int | None = None, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """The same for one micro-batch of a stream, called from ``foreachBatch``.

    Without ``time`` lines arrive at ``now_ms``, by default the moment of the call. With ``time``,
    a column of epoch milliseconds, stamps count as at most ``tolerance_ms`` ahead of it, so that a wrong one
    holds a bucket up for no longer; a line older than its bucket counts as arriving at the bucket's time.

    Buckets pass from batch to batch as a small table per batch under ``state_dir`` (shared
    storage). A repeated batch starts from the table of the batch before it and replaces its own. Buckets that were
    full ``tolerance_ms`` before the newest line are dropped, as they equal no bucket. The result reads tables under
    ``state_dir`` that the next call deletes.
    """
    if limit.max_lines == 0:
        return batch
    return limited_batch(batch, limit, state_dir, batch_id, key=key, time=time, now_ms=now_ms,
                         tolerance_ms=tolerance_ms)[0]


def limited_batch(batch: DataFrame, limit: RateLimit, state_dir: str, batch_id: int, *,
                  key: tuple[str, ...] | None = ("source",), time: str | None = None, now_ms: int | None = None,
                  tolerance_ms: int = TOLERANCE_MS, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lines that ``rate_limit_batch`` lets through, with the tables of arrivals (also ``by`` further columns) and of accepted counts."""
    spark = batch.sparkSession
    now_ms = int(clock.time() * 1000) if now_ms is None else now_ms
    own = F.lit(now_ms).cast("bigint") if time is None else F.least(
        F.col(time), F.lit(now_ms + tolerance_ms).cast("bigint"))
    earlier = [i for i in _state_batches(spark, state_dir) if i < batch_id]
    keyed = _keyed(batch, key, own).withColumn("_own_ms", F.col("_ms"))
    carried = None
    if earlier:
        carried = spark.read.schema("_key string, _last bigint, _debt bigint").parquet(
            f"{state_dir}/batch={max(earlier)}")
        keyed = keyed.join(carried, "_key", "left").withColumn(
            "_ms", F.greatest("_ms", "_last")).drop("_last", "_debt")
    delete(spark, f"{state_dir}/work")
    with tables_in(f"{state_dir}/work"):
        arrived = materialize(_arrivals(keyed, by), "arrivals")
        moments = materialize(_per_moment(arrived), "moments") if by else arrived
        granted = materialize(accepted_counts(moments, limit, carried), "granted")
    after = granted.groupBy("_key").agg(
        F.max("_ms").alias("_last"), F.max_by("debt", "_ms").alias("_debt"))
    if carried is not None:
        after = carried.join(after, "_key", "left_anti").unionByName(after)
    newest = after.agg(F.max("_last")).first()[0]
    if newest is not None:
        full = F.col("_last") + F.ceil(F.col("_debt") / limit.gain)
        after = after.filter(full > newest - tolerance_ms)
    after.write.mode("overwrite").parquet(f"{state_dir}/batch={batch_id}")
    for old in sorted(earlier)[:-1]:
        delete(spark, f"{state_dir}/batch={old}")
    order = ["_own_ms", *[c for c in ("source", "line_number", "position", "value") if c in batch.columns]]
    return _take(keyed, granted, limit, order).select(*batch.columns), arrived, granted


def _state_batches(spark: SparkSession, state_dir: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path
    pattern = path(f"{state_dir}/batch=*/_SUCCESS")
    system = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    return [int(s.getPath().getParent().getName().split("=")[1])
            for s in system.globStatus(pattern) or []]
