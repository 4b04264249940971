"""First, last, merged and running: operators that depend on line order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loglens.functions.parse import parse
from loglens.operators.filters import line_condition
from loglens.sources.shared import materialize

FILE_ORDER = ("source", "line_number")
# Lines per block of a running total; line numbers are unique in a source, so no block is larger.
BLOCK_LINES = 65_536


# Up to so many first rows of every task meet in one.
MAX_FIRST = 10_000


def first_n(lines: DataFrame, n: int, order: tuple[str, ...] = FILE_ORDER) -> DataFrame:
    """The first ``n`` rows in file order; 0 keeps all.

    Many rows are cut off where they stand: rows are dealt by ranges of the order, the counts of the ranges say
    in which of them the n-th row is, and whole ranges ahead of it stay. The order has to be total.
    """
    if n <= 0:
        return lines
    if n <= MAX_FIRST:
        return lines.orderBy(*order).limit(n)
    stored, starts = _ranged(lines, order)
    # One number per shuffle partition.
    wanted = {part: (first, before) for part, (first, before) in starts.items() if before < n}
    if not wanted:
        return stored.drop("_part", "_row")
    cut = max(wanted, key=lambda part: wanted[part][1])
    first, before = wanted[cut]
    kept = F.col("_part").isin([p for p in wanted if p != cut]) | (
        (F.col("_part") == cut) & (F.col("_row") < first + n - before))
    return stored.filter(kept).drop("_part", "_row")


def _ranged(rows: DataFrame, order: tuple[str, ...]) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """Rows in stored ranges of the order, with ``_part`` and ``_row``; per range its first ``_row`` and the number of rows before it."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({
        "_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    stored = materialize(ranged, "ordered")
    counts = stored.groupBy("_part").agg(F.min("_row").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    starts, before = {}, 0
    for part in sorted(counts):
        starts[part["_part"]] = (part["first"], before)
        before += part["n"]
    return stored, starts


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], n: int,
                  position: str, spread: Column) -> DataFrame:
    """Rows at positions 1..n of each group, with their ``position``.

    Spark keeps only ``n`` rows per group and task ahead of the shuffle as long as ``n`` is
    within its group-limit threshold. For larger ``n`` a group is first cut into 64 parts by
    ``spread`` and each part reduced to ``n`` rows, so no task sorts a whole hot group.
    """
    threshold = int(rows.sparkSession.conf.get(
        "spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > threshold:
        part = F.pmod(F.xxhash64(spread), F.lit(64))
        split = Window.partitionBy(*keys, "_part").orderBy(*order)
        rows = (rows.withColumn("_part", part)
                .withColumn(position, F.row_number().over(split))
                .filter(F.col(position) <= n).drop("_part", position))
    whole = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(position, F.row_number().over(whole)).filter(F.col(position) <= n)


def tail_n(lines: DataFrame, n: int = 10, pattern: str | None = None,
           min_severity: str | None = None) -> DataFrame:
    """The last ``n`` matching lines of every source, with ``tail_pos`` 1..n in file order.

    The pattern ignores case, as the tail command does.
    """
    wanted = lines.filter(line_condition(
        F.col("value"), pattern, ignore_case=True, min_severity=min_severity))
    last = top_per_group(
        wanted, ["source"], [F.desc("line_number")], n, "_back", F.col("line_number"))
    # At most n rows per source are left.
    held = F.count(F.lit(1)).over(Window.partitionBy("source"))
    return last.select(
        *lines.columns, (held - F.col("_back") + 1).cast("bigint").alias("tail_pos"))


def number_in_order(rows: DataFrame, order: tuple[str, ...], name: str) -> DataFrame:
    """Global 1-based position of every row in the given (total) order.

    Rows are range-partitioned and sorted once and kept as a table; each partition's first
    position then follows from the per-partition counts.
    """
    stored, starts = _ranged(rows, order)
    spark = rows.sparkSession
    # A row per shuffle partition: spark.sql.shuffle.partitions bounds the broadcast.
    table = spark.createDataFrame(
        [(part, before - first) for part, (first, before) in starts.items()], "_part int, _shift bigint")
    return stored.join(F.broadcast(table), "_part").select(
        (F.col("_row") + F.col("_shift") + 1).alias(name), *rows.columns)


def merge(lines: DataFrame, *, now: str, sort: bool = True, by: str = "timestamp",
          year: int | None = None, numbered: bool = False) -> DataFrame:
    """All lines of several sources as one sequence.

    ``lines`` carries ``source_pos``, the place of its file among the arguments. Sorted, the
    order is the stamp as text (or the ``event_time``), ties by argument place and line number;
    unsorted it is argument place and line number. ``numbered`` adds the global ``seq``.
    """
    kept = ["source_pos", "source", "line_number", "value"]
    if sort:
        if by not in ("timestamp", "event_time"):
            raise ValueError(f"cannot merge by {by!r}")
        stamped = parse(lines, now=now, year=year, keep=("source_pos", "value"))
        rows = stamped.select(*kept, by)
        order = (by, "source_pos", "line_number")
    else:
        rows = lines.select(*kept)
        order = ("source_pos", "line_number")
    return number_in_order(rows, order, "seq") if numbered else rows.orderBy(*order)


def running_total(lines: DataFrame, amount: Column, name: str) -> DataFrame:
    """Sum of ``amount`` over the earlier lines of the same source.

    Per-block totals are summed up first, then every block adds its own running sum to the
    total before it, so that one long source is spread over many tasks.
    """
    blocked = lines.withColumns({
        "_block": F.floor((F.col("line_number") - 1) / BLOCK_LINES), "_amount": amount})
    totals = blocked.groupBy("source", "_block").agg(F.sum("_amount").alias("_total"))
    blocks_before = Window.partitionBy("source").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = totals.select(
        "source", "_block",
        F.coalesce(F.sum("_total").over(blocks_before), F.lit(0)).alias("_before"))
    lines_before = Window.partitionBy("source", "_block").orderBy("line_number").rowsBetween(
        Window.unboundedPreceding, -1)
    within = blocked.withColumn(
        "_within", F.coalesce(F.sum("_amount").over(lines_before), F.lit(0)))
    return within.join(starts, ["source", "_block"]).select(
        *lines.columns, (F.col("_before") + F.col("_within")).alias(name))
