"""The whole collector as one plan: rate limit, filter, parse, enrich, format."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from loglens.functions import severity as sev
from loglens.functions.formats import formatted
from loglens.functions.parse import line_bytes, parse
from loglens.functions.tags import add_global_tags, override_hostname
from loglens.operators.filters import FilterSpec
from loglens.operators import stats
from loglens.operators.ordering import number_in_order
from loglens.operators.ratelimit import RateLimit, arrivals, grant, limited_batch, rate_limit, rate_limit_batch
from loglens.sources.shared import materialize


@dataclass(frozen=True)
class CollectorConfig:
    """``now`` stamps lines without a stamp, ``None`` those of a stream with their batch's time; ``rate_key=None`` means
    one bucket for all lines."""

    now: str | None
    year: int | None = None
    rate: RateLimit | None = None
    rate_key: tuple[str, ...] | None = None
    rate_time: str | None = "event_ms"
    filter: FilterSpec = field(default_factory=FilterSpec)
    tags: dict[str, str] = field(default_factory=dict)
    hostname: str | None = None
    output_format: str = "plain"
    strip_cr: bool = False


def _unlimited(config: CollectorConfig) -> bool:
    return config.rate is None or config.rate.max_lines == 0


def _limited(lines: DataFrame, config: CollectorConfig, granted: DataFrame | None = None) -> DataFrame:
    if _unlimited(config):
        return lines
    if lines.isStreaming:
        raise ValueError("limit a stream per micro-batch: collect_batch in foreachBatch")
    return rate_limit(
        lines, config.rate, key=config.rate_key, time=config.rate_time, granted=granted)


def _entries(lines: DataFrame, config: CollectorConfig, keep: tuple[str, ...] = ()) -> tuple[DataFrame, Column]:
    """Lines past the limit as entries with their ``output``, and which of them come through.

    The raw line decides what it can; a predicate on severities waits for the entry, so that no line is parsed twice.
    """
    spec, value = config.filter, F.col("value")
    passes, lowest = F.lit(True), sev.rank_of(spec.min_severity)
    if not spec.severities:
        passes = spec.condition(value)
    elif spec.exclude:
        passes = replace(spec, include=(), severities=(), strict_severity=False).condition(value)
    entries = parse(lines.withColumn("_passes", passes), now=config.now, year=config.year, strip_cr=config.strip_cr,
                    keep=("value", "_passes", *keep))
    passes, rank = F.col("_passes"), F.col("severity_rank")
    if spec.severities:
        passes = passes & spec.condition(value, rank)
    if lowest > 0:
        passes = passes & (rank >= lowest)
    entries = override_hostname(add_global_tags(entries, config.tags), config.hostname)
    return entries.withColumn("output", formatted(config.output_format)), passes


def collect(lines: DataFrame, config: CollectorConfig, granted: DataFrame | None = None,
            keep: tuple[str, ...] = ()) -> DataFrame:
    """Entries that come through, with the raw ``value``, the columns named in ``keep`` and the ``output`` text.

    The limit sees every line, before any filter. Without a limit this works on streaming lines
    too.
    """
    entries, passes = _entries(_limited(lines, config, granted), config, keep)
    return entries.filter(passes).drop("_passes")


def collect_batch(batch: DataFrame, config: CollectorConfig, state_dir: str, batch_id: int) -> DataFrame:
    """``collect`` for one micro-batch, with the limit's buckets carried on in ``state_dir``.

    ``rate_time=None`` limits by the time of arrival instead of the lines' stamps.
    """
    if config.rate is not None:
        batch = rate_limit_batch(batch, config.rate, state_dir, batch_id,
                                 key=config.rate_key, time=config.rate_time)
    return collect(batch, replace(config, rate=None))


#: The five totals of a collector.
TOTALS = ("total_lines", "bytes_processed", "dropped_lines", "filtered_lines", "bytes_written")


def read_metrics() -> list[Column]:
    return [F.count(F.lit(1)).alias("total_lines"),
            F.coalesce(F.sum(line_bytes(F.col("value"))), F.lit(0)).alias("bytes_processed")]


def written_metrics() -> list[Column]:
    return [F.count(F.lit(1)).alias("filtered_lines"),
            F.coalesce(F.sum(F.octet_length("output") + 1), F.lit(0)).cast("bigint").alias("bytes_written")]


class Counters:
    """The totals of rows that were collected, known once these have been written.

    Lines are counted on their way: those that come in by the scan, or with a limit by its table of arrivals, those that go out by the
    task that writes them. So nothing is read again, and as a finished task counts once, none counts twice when an executor is lost.
    """

    def __init__(self, written: Observation, read: Observation | None = None, known: dict[str, int] | None = None) -> None:
        self._written, self._read, self._known = written, read, known

    def totals(self) -> dict[str, int]:
        """Waits for the first write of the rows."""
        counted = dict(self._known or {"dropped_lines": 0}) | self._written.get
        if self._read is not None:
            counted |= self._read.get
        return {name: int(counted[name]) for name in TOTALS}


def _came_in(arrived: DataFrame, granted: DataFrame) -> dict[str, int]:
    read = arrived.agg(F.sum("_n").alias("n"), F.sum("_bytes").alias("bytes")).first()
    accepted = granted.agg(F.sum("accepted")).first()[0] or 0
    return {"total_lines": read["n"] or 0, "bytes_processed": read["bytes"] or 0, "dropped_lines": (read["n"] or 0) - accepted}


def collect_counted(lines: DataFrame, config: CollectorConfig, state_dir: str | None = None,
                    batch_id: int | None = None) -> tuple[DataFrame, Counters]:
    """``collect``, or with ``state_dir`` and ``batch_id`` ``collect_batch``, and the counters of what it gives.

    The rows should be written once; a second write is not counted.
    """
    written, read, known = Observation(), None, None
    if _unlimited(config):
        read = Observation()
        rows = collect(lines.observe(read, *read_metrics()), config)
    elif state_dir is None:
        arrived = arrivals(lines, key=config.rate_key, time=config.rate_time)
        granted = materialize(grant(lines, config.rate, arrived=arrived), "granted")
        known, rows = _came_in(arrived, granted), collect(lines, config, granted)
    else:
        passed, arrived, granted = limited_batch(
            lines, config.rate, state_dir, batch_id, key=config.rate_key, time=config.rate_time)
        known, rows = _came_in(arrived, granted), collect(passed, replace(config, rate=None))
    return rows.observe(written, *written_metrics()), Counters(written, read, known)


def counters(lines: DataFrame, config: CollectorConfig) -> DataFrame:
    """One row: lines and bytes read, lines dropped by the limit, lines and bytes written. Runs the collector over the lines at once."""
    rows, counted = collect_counted(lines, config)
    rows.select("output").write.format("noop").mode("overwrite").save()
    totals = counted.totals()
    return lines.sparkSession.createDataFrame(
        [tuple(totals[n] for n in TOTALS)], ", ".join(f"{n} bigint" for n in TOTALS))


def interval_start(ms: Column, interval_ms: int) -> Column:
    return F.timestamp_millis(F.floor(ms / interval_ms) * interval_ms)


def interval_deltas(lines: DataFrame, config: CollectorConfig, interval_ms: int, time: str = "event_ms",
                    state_dir: str | None = None, batch_id: int | None = None) -> DataFrame:
    """The totals of every interval that has lines, by the lines' ``time``; of a micro-batch with ``state_dir`` and ``batch_id``.

    Without a limit the lines are read once: those that don't come through stay as rows that count as read only. With one, its table of
    arrivals counts them, and buckets of time hold whole milliseconds, so the limit has to go by the same ``time``.
    """
    zero = F.lit(0).cast("bigint")
    start = interval_start(F.col(time), interval_ms).alias("interval_start")
    if _unlimited(config):
        entries, passes = _entries(lines, config, (time,))
        return entries.groupBy(start).agg(
            *read_metrics(), F.lit(0).cast("bigint").alias("dropped_lines"), F.count_if(passes).alias("filtered_lines"),
            F.coalesce(F.sum(F.when(passes, F.octet_length("output") + 1)), zero).cast("bigint").alias("bytes_written"))
    if config.rate_time != time:
        raise ValueError(f"the limit goes by {config.rate_time!r}, the intervals by {time!r}")
    if state_dir is None:
        arrived = arrivals(lines, key=config.rate_key, time=time)
        granted = materialize(grant(lines, config.rate, arrived=arrived), "granted")
        passed = rate_limit(lines, config.rate, key=config.rate_key, time=time, granted=granted)
    else:
        passed, arrived, granted = limited_batch(lines, config.rate, state_dir, batch_id, key=config.rate_key, time=time)
    written = collect(passed, replace(config, rate=None), keep=(time,))
    at = interval_start(F.col("_ms"), interval_ms).alias("interval_start")
    parts = [
        arrived.groupBy(at).agg(F.sum("_n").alias("total_lines"), F.sum("_bytes").alias("bytes_processed"),
                                F.sum("_n").alias("dropped_lines")),
        granted.groupBy(at).agg((-F.sum("accepted")).alias("dropped_lines")),
        written.groupBy(start).agg(*written_metrics())]
    padded = [p.select("interval_start", *[(F.col(n) if n in p.columns else zero).alias(n) for n in TOTALS]) for p in parts]
    return reduce(DataFrame.unionByName, padded).groupBy("interval_start").agg(*[F.sum(n).alias(n) for n in TOTALS])


def interval_stats(lines: DataFrame, config: CollectorConfig, interval_ms: int, time: str = "event_ms") -> DataFrame:
    """The five totals from the start up to the end of every interval, and the interval's own ``lines``."""
    return stats.cumulative(interval_deltas(lines, config, interval_ms, time), interval_ms, TOTALS)


def _stage_rows(lines: DataFrame, config: CollectorConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Partial sums of the three stages: read (per source), let through, written."""
    if _unlimited(config):
        read = materialize(lines.groupBy("source").agg(*read_metrics()), "read")
        granted, accepted = None, read.agg(F.sum("total_lines").alias("accepted"))
    else:
        arrived = arrivals(lines, key=config.rate_key, time=config.rate_time, by=("source",))
        read = arrived.groupBy("source").agg(F.sum("_n").alias("total_lines"), F.sum("_bytes").alias("bytes_processed"))
        granted = materialize(grant(lines, config.rate, arrived=arrived), "granted")
        accepted = granted.agg(F.sum("accepted").alias("accepted"))
    return read, accepted, collect(lines, config, granted).groupBy("severity").agg(*written_metrics())


def _totals(stages: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """The stages' rows under each other with 0 and null where a stage has no such column."""
    names = ("total_lines", "bytes_processed", "accepted", "filtered_lines", "bytes_written")

    def padded(rows: DataFrame) -> DataFrame:
        numbers = [(F.col(n) if n in rows.columns else F.lit(0)).cast("bigint").alias(n)
                   for n in names]
        labels = [(F.col(n) if n in rows.columns else F.lit(None)).cast("string").alias(n)
                  for n in ("source", "severity")]
        return rows.select(*numbers, *labels)

    return reduce(DataFrame.unionByName, [padded(rows) for rows in stages])


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).alias(name)


def stats_json(lines: DataFrame, config: CollectorConfig, *, start_time: str, last_update: str) -> DataFrame:
    """The counters with the counts by level (of written lines) and by source (of all lines) as
    one JSON object; its size grows with the number of sources, not of lines."""
    level = F.when(F.col("severity").isNotNull(), F.struct(
        F.array_position(F.array(*[F.lit(name) for name in sev.LEVELS]), F.col("severity")),
        "severity", "filtered_lines"))
    source = F.when(F.col("source").isNotNull(), F.struct("source", "total_lines"))
    dropped = F.coalesce(F.sum(F.col("total_lines") - F.col("accepted")), F.lit(0))
    row = _totals(_stage_rows(lines, config)).agg(
        _total("total_lines"), _total("filtered_lines"), dropped.alias("dropped_lines"),
        _total("bytes_processed"), _total("bytes_written"),
        F.array_sort(F.collect_list(level)).alias("levels"),
        F.array_sort(F.collect_list(source)).alias("sources"))
    by_level = F.map_from_entries(F.transform(
        "levels", lambda x: F.struct(x["severity"], x["filtered_lines"])))
    return row.select(F.to_json(F.struct(
        "total_lines", "filtered_lines", "dropped_lines", "bytes_processed", "bytes_written",
        F.lit(start_time).alias("start_time"), F.lit(last_update).alias("last_update"),
        by_level.alias("severity_counts"),
        F.map_from_entries("sources").alias("source_counts"))).alias("json"))


def _without_brace(json: Column) -> Column:
    """A JSON object without its last character."""
    return F.regexp_replace(json, r"\}\z", "")


def stats_json_parts(lines: DataFrame, config: CollectorConfig, *, start_time: str, last_update: str,
                     per_part: int = 1000) -> DataFrame:
    """``part, json``: the text of ``stats_json`` in parts, which make the object when put together in their order.

    The first part has the totals and counts by level, each of those that follow the counts of ``per_part`` sources,
    the last closes the object. So no row grows with the number of sources.
    """
    read, accepted, written = _stage_rows(lines, config)
    read = materialize(read, "read")
    level = F.when(F.col("severity").isNotNull(), F.struct(
        F.array_position(F.array(*[F.lit(name) for name in sev.LEVELS]), F.col("severity")), "severity", "filtered_lines"))
    dropped = F.coalesce(F.sum(F.col("total_lines") - F.col("accepted")), F.lit(0))
    # sources are summed up first, so the list has a row per level
    sums = read.agg(F.sum("total_lines").alias("total_lines"), F.sum("bytes_processed").alias("bytes_processed"))
    row = _totals((sums, accepted, written)).agg(
        _total("total_lines"), _total("filtered_lines"), dropped.alias("dropped_lines"), _total("bytes_processed"),
        _total("bytes_written"), F.array_sort(F.collect_list(level)).alias("levels"))
    head = F.to_json(F.struct(
        "total_lines", "filtered_lines", "dropped_lines", "bytes_processed", "bytes_written",
        F.lit(start_time).alias("start_time"), F.lit(last_update).alias("last_update"),
        F.map_from_entries(F.transform("levels", lambda x: F.struct(x["severity"], x["filtered_lines"]))).alias("severity_counts")))
    first = row.select(F.lit(0).cast("bigint").alias("part"), F.concat(
        _without_brace(head), F.lit(',"source_counts":{')).alias("json"))
    numbered = number_in_order(read.filter("source IS NOT NULL").select("source", "total_lines"), ("source",), "place")
    pair = F.to_json(F.create_map(F.col("source"), F.col("total_lines")))
    pairs = numbered.select(
        "place", F.floor((F.col("place") - 1) / per_part).alias("group"),
        _without_brace(F.ltrim(pair, F.lit("{"))).alias("text"))
    grouped = pairs.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("pairs"))
    middle = grouped.select((F.col("group") + 1).cast("bigint").alias("part"), F.concat(
        F.when(F.col("group") > 0, ",").otherwise(""),
        F.array_join(F.transform("pairs", lambda x: x["text"]), ",")).alias("json"))
    last = lines.sparkSession.createDataFrame([((1 << 62), "}}")], "part bigint, json string")
    return first.unionByName(middle).unionByName(last)
