"""Counts, distributions and their JSON reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loglens.functions.parse import hour_of, line_bytes
from loglens.functions.severity import LEVELS
from loglens.sources.shared import materialize

BAR_WIDTH = 40


def _by(source: bool) -> list[str]:
    return ["source"] if source else []


def _length_columns(length: Column) -> list[Column]:
    total, count = F.coalesce(F.sum(length), F.lit(0)), F.count(F.lit(1))
    return [
        count.alias("total_lines"), total.alias("total_bytes"),
        F.coalesce(F.min(length), F.lit(0)).alias("min_line_length"),
        F.coalesce(F.max(length), F.lit(0)).alias("max_line_length"),
        F.when(count > 0, F.call_function("div", total, count)).otherwise(0).cast("bigint")
        .alias("avg_line_length"),
    ]


def line_stats(lines: DataFrame, by_source: bool = False) -> DataFrame:
    """Line count, bytes, and shortest / longest / mean (rounded down) line; zeros when empty."""
    return lines.groupBy(*_by(by_source)).agg(*_length_columns(line_bytes(F.col("value"))))


def first_last_timestamp(entries: DataFrame) -> DataFrame:
    """Stamps of the first and last line of each source in file order (not the extremes)."""
    return entries.groupBy("source").agg(
        F.min_by("timestamp", "line_number").alias("first_timestamp"),
        F.max_by("timestamp", "line_number").alias("last_timestamp"))


def severity_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("severity").agg(F.count(F.lit(1)).alias("lines"))


def source_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("source").agg(F.count(F.lit(1)).alias("lines"))


def _counts_unless_empty(rows: DataFrame, column: str) -> DataFrame:
    # The empty group goes after counting: a filter ahead of it would parse every line twice.
    return (rows.groupBy(column).agg(F.count_if(F.col(column) != "").alias("lines"))
            .filter(F.col("lines") > 0))


def host_counts(entries: DataFrame) -> DataFrame:
    return _counts_unless_empty(entries, "hostname")


def severity_distribution(entries: DataFrame) -> DataFrame:
    """Count and percentage by level."""
    # The window runs over the grouped rows, one per level.
    whole = Window.partitionBy(F.lit(0))
    return severity_counts(entries).withColumn(
        "pct", F.col("lines") * 100.0 / F.sum("lines").over(whole))


def hourly_distribution(entries: DataFrame) -> DataFrame:
    """Lines per hour of day; lines whose stamp has no clock part do not count."""
    return _counts_unless_empty(
        entries.select(hour_of(F.col("timestamp")).alias("hour")), "hour")


def hourly_histogram(entries: DataFrame) -> DataFrame:
    """All 24 hours with their counts and a bar of up to 40 marks."""
    spark = entries.sparkSession
    hours = spark.range(0, 24, 1, 1).select(
        F.lpad(F.col("id").cast("string"), 2, "0").alias("hour"))
    # Both sides have at most 24 and 100 rows (two digits).
    filled = hours.join(F.broadcast(hourly_distribution(entries)), "hour", "left").select(
        "hour", F.coalesce("lines", F.lit(0)).alias("lines"))
    peak = F.max("lines").over(Window.partitionBy(F.lit(0)))
    length = F.when(peak > 0, F.floor(F.col("lines") * float(BAR_WIDTH) / peak)).otherwise(0)
    return filled.select("hour", "lines", F.repeat(F.lit("#"), length.cast("int")).alias("bar"))


def _nonzero_levels() -> Column:
    """Level counts of the aggregate columns named like the levels, in rank order."""
    counts = F.map_from_arrays(
        F.array(*[F.lit(level) for level in LEVELS]), F.array(*[F.col(level) for level in LEVELS]))
    return F.map_filter(counts, lambda _, n: n > 0)


def _level_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == level).alias(level) for level in LEVELS]


def stats_file_json(lines: DataFrame, *, detailed: bool = False) -> DataFrame:
    """One JSON report per source; ``detailed`` adds the counts by hour of day.

    ``lines`` are parsed rows that still have their raw ``value``. Lines are counted once, by
    source and hour (at most 101 groups per source); the reports add those groups up.
    """
    narrow = lines.select(
        "source", "line_number", "timestamp", "severity",
        line_bytes(F.col("value")).alias("length"), hour_of(F.col("timestamp")).alias("hour"))
    groups = narrow.groupBy("source", "hour").agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"),
        F.min("length").alias("shortest"), F.max("length").alias("longest"),
        F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"),
        F.min_by("timestamp", "line_number").alias("first"),
        F.max_by("timestamp", "line_number").alias("last"), *_level_counts())
    hours = F.array_sort(F.collect_list(
        F.when(F.col("hour") != "", F.struct("hour", "n"))))
    rows = groups.groupBy("source").agg(
        F.sum("n").alias("total_lines"), F.sum("bytes").alias("total_bytes"),
        F.min("shortest").alias("min_line_length"), F.max("longest").alias("max_line_length"),
        F.min_by("first", "first_line").alias("first_timestamp"),
        F.max_by("last", "last_line").alias("last_timestamp"),
        *[F.sum(level).alias(level) for level in LEVELS], hours.alias("hours"))
    fields = [
        F.col("source").alias("file"), "total_lines", "total_bytes",
        F.expr("total_bytes div total_lines").alias("avg_line_length"),
        "min_line_length", "max_line_length", "first_timestamp", "last_timestamp",
        _nonzero_levels().alias("severity_counts"),
    ]
    if detailed:
        fields.append(F.map_from_entries("hours").alias("hourly_distribution"))
    return rows.select("source", F.to_json(F.struct(*fields)).alias("json"))


def interval_counts(lines: DataFrame, time: str, interval: str) -> DataFrame:
    """Lines and bytes of every interval that has lines; for batch and streaming rows."""
    return (lines.groupBy(F.window(F.col(time), interval).alias("w"))
            .agg(F.count(F.lit(1)).alias("lines"),
                 F.sum(line_bytes(F.col("value"))).alias("bytes"))
            .select(F.col("w.start").alias("interval_start"), "lines", "bytes"))


def running_sums(rows: DataFrame, index: Column, names: tuple[str, ...], group: int = 1024) -> DataFrame:
    """``rows`` with the sums of the named columns over all rows of smaller index, as ``before_<name>``.

    Indices are unique integers within 40 bits. Rows are summed up by groups of consecutive indices; what is ahead of a group is made of
    one dyadic range of groups for every bit set in its number. So nothing is ever sorted or summed in one place.
    """
    # Used three times, so whatever made the rows runs once.
    numbered = materialize(rows.withColumn("_index", index + F.lit(1 << 40)).withColumn(
        "_group", F.floor(F.col("_index") / group)), "indexed")
    levels = (1 << 41).bit_length() - (group.bit_length() - 1)
    sums = numbered.groupBy("_group").agg(*[F.sum(n).alias(n) for n in names])
    at = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    ranges = sums.select(at.alias("_level"), "_group", *names).groupBy(
        "_level", F.call_function("shiftright", "_group", "_level").alias("_range")).agg(*[F.sum(n).alias(n) for n in names])
    needed = sums.select("_group", at.alias("_level")).withColumn(
        "_own", F.call_function("shiftright", "_group", "_level")).filter("_own % 2 = 1").select(
        "_group", "_level", (F.col("_own") - 1).alias("_range"))
    ahead = needed.join(ranges, ["_level", "_range"]).groupBy("_group").agg(*[F.sum(n).alias(f"_ahead_{n}") for n in names])
    earlier = Window.partitionBy("_group").orderBy("_index").rowsBetween(Window.unboundedPreceding, -1)
    within = numbered.withColumns({f"before_{n}": F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in names})
    return within.join(ahead, "_group", "left").select(
        *rows.columns, *[(F.col(f"before_{n}") + F.coalesce(f"_ahead_{n}", F.lit(0))).alias(f"before_{n}") for n in names])


def cumulative(per_interval: DataFrame, interval_ms: int, names: tuple[str, ...]) -> DataFrame:
    """``interval_start``, its own ``lines``, and the named totals from the start up to the end of every interval.

    The first of the names counts lines.
    """
    kind = dict(per_interval.dtypes)["interval_start"]
    epoch = F.lit("1970-01-01 00:00:00").cast(kind) if kind == "timestamp_ntz" else F.timestamp_millis(F.lit(0))
    index = F.floor(F.timestamp_diff("MILLISECOND", epoch, F.col("interval_start")) / interval_ms)
    return running_sums(per_interval, index, names).select(
        "interval_start", F.col(names[0]).alias("lines"), *[(F.col(f"before_{n}") + F.col(n)).alias(n) for n in names])


def interval_stats(lines: DataFrame, time: str, interval_ms: int) -> DataFrame:
    """Lines and bytes only, of lines that go through no collector."""
    counted = interval_counts(lines, time, f"{interval_ms} milliseconds").select(
        "interval_start", F.col("lines").alias("total_lines"), F.col("bytes").alias("bytes_processed"))
    return cumulative(counted, interval_ms, ("total_lines", "bytes_processed"))
