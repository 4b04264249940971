"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loglens.functions import formats, severity as sev
from loglens.functions.parse import parse, severity_rank
from loglens.functions.tags import add_global_tags, override_hostname, parse_tag_items, parse_tags
from loglens.operators import filters, ordering, search, stats
from loglens.operators.filters import FilterSpec, Pattern
from loglens.operators.ratelimit import ByteLimit, RateLimit, rate_limit, rate_limit_batch, rate_limit_bytes
from loglens.plans import collector
from loglens.plans.collector import CollectorConfig
from loglens.plans.fixtures import (
    NOW, doc_lines, original_position, raw_logs, replace_files, write_log_files)
from loglens.sources import lines as source, sinks
from loglens.sources.shared import new_path
from loglens.streaming import monitor, streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PER_SOURCE = RateLimit(max_lines=1, window_ms=3_600_000, burst=3)
PER_TYPE = RateLimit(max_lines=3, window_ms=7_200_000, burst=2)
GLOBAL = RateLimit(max_lines=2, window_ms=1_800_000, burst=5)
BYTES = ByteLimit(max_bytes=100, window_ms=3_600_000, burst=400)
SPAN_MS = 6 * 3_600_000
COLLECTOR = CollectorConfig(
    now=NOW, rate=GLOBAL,
    filter=FilterSpec(
        include=(Pattern("error", ignore_case=True), Pattern("user [0-9]+")),
        exclude=(r'\{"k": 9[0-9]\}',), min_severity="INFO"),
    tags={"env": "prod", "dc": "a"}, hostname="edge1", output_format="json")
STREAM = CollectorConfig(
    now=NOW, filter=FilterSpec(include=(Pattern("click|purchase"),), min_severity="WARNING"),
    tags={"env": "prod"}, output_format="plain")


def query(function: Query) -> Query:
    QUERIES[function.__name__.removeprefix("q_")] = function
    return function


def _entries(spark: SparkSession, sf: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return parse(raw_logs(spark, sf), now=NOW, year=2024, keep=keep)


def _named(df: DataFrame) -> DataFrame:
    return df.select("source", "line_number", "value")


# --- sources ---------------------------------------------------------------------------------

@query
def read_lines(spark, sf):
    folder = write_log_files(raw_logs(spark, sf))
    return original_position(source.read_lines(spark, [folder]))


@query
def read_multi(spark, sf):
    folder = write_log_files(raw_logs(spark, sf))
    wanted = [f"{folder}/src{n}.*.log" for n in (0, 3, 1, 0, 4, 2)]
    return original_position(source.read_lines(spark, wanted))


@query
def read_skip_missing(spark, sf):
    folder = write_log_files(raw_logs(spark, sf))
    present, missing = source.read_existing(
        spark, [f"{folder}/none.log", *(f"{folder}/src{n}.*.log" for n in range(5))])
    return original_position(present).withColumn("missing", F.lit(len(missing)).cast("bigint"))


# --- projections and scalar functions ---------------------------------------------------------

@query
def parse_log(spark, sf):
    return _entries(spark, sf).select(
        "source", "line_number", "timestamp", "severity", "hostname", "process", "pid", "message",
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"))


@query
def parse_documents(spark, sf):
    return parse(doc_lines(spark, sf), now=NOW).select(
        "source", "line_number", "timestamp", "severity", "hostname", "process", "message")


@query
def severity_from_string(spark, sf):
    word = F.regexp_extract("value", r"(DEBUG|INFO|WARN|ERROR|CRIT|FATAL|notice|Warning|click|view)", 1)
    return raw_logs(spark, sf).select(
        "source", "line_number", word.alias("token"),
        sev.from_string(word).alias("level"), sev.from_string(F.lower(word)).alias("lower_level"))


@query
def severity_to_string(spark, sf):
    rank = (F.col("line_number") % 7 - 1).cast("int")
    return raw_logs(spark, sf).select(
        "source", "line_number", rank.cast("bigint").alias("rank"), sev.to_string(rank).alias("level"))


@query
def detect_severity(spark, sf):
    value, no_token = F.col("value"), F.lit("")
    return doc_lines(spark, sf).select(
        "source", "line_number",
        sev.to_string(sev.line_rank(value, no_token)).alias("severity"),
        sev.to_string(sev.line_rank(value, no_token, word_boundary=True)).alias("word_severity"))


@query
def format_json(spark, sf):
    tagged = add_global_tags(_entries(spark, sf), {"zone": "b", "app": 'x"y'})
    return tagged.select("source", "line_number", formats.to_json().alias("json"))


@query
def format_plain(spark, sf):
    return _entries(spark, sf).select("source", "line_number", formats.to_plain().alias("plain"))


@query
def format_csv(spark, sf):
    return _entries(spark, sf).select("source", "line_number", formats.to_csv().alias("csv"))


@query
def format_syslog(spark, sf):
    return _entries(spark, sf).select(
        "source", "line_number", formats.to_syslog().alias("syslog"),
        formats.to_syslog(rfc_codes=True).alias("syslog_rfc"))


@query
def match_position(spark, sf):
    return search.match_position(doc_lines(spark, sf), "[a-z]+err[a-z]*")


@query
def q_parse_tags(spark, sf):
    items = F.array(
        F.concat(F.lit("type="), "event_type"), F.concat(F.lit("src="), "source"),
        F.concat(F.lit("type="), F.col("line_number").cast("string"), F.lit("=x")),
        F.lit("flag"))
    return raw_logs(spark, sf).select(
        "source", "line_number",
        F.to_json(formats.sorted_tags(parse_tags(items))).alias("tags"))


# --- filters ----------------------------------------------------------------------------------

def _passing(spark, sf, spec: FilterSpec) -> DataFrame:
    return _named(raw_logs(spark, sf).filter(spec.condition(F.col("value"))))


@query
def filter_include(spark, sf):
    return _passing(spark, sf, FilterSpec(include=(Pattern("ERROR|CRIT"), Pattern("KERNEL", True))))


@query
def filter_exclude(spark, sf):
    return _passing(spark, sf, FilterSpec(exclude=("kernel", r"\[INFO\]")))


@query
def filter_severity_set(spark, sf):
    lines = raw_logs(spark, sf)
    value = F.col("value")
    loose = FilterSpec(severities=("ERROR", "DEBUG"), min_severity="INFO")
    strict = FilterSpec(severities=("ERROR", "DEBUG"), min_severity="INFO", strict_severity=True)
    return lines.select(
        "source", "line_number", loose.condition(value).alias("passes"),
        strict.condition(value).alias("passes_strict"))


@query
def filter_composite(spark, sf):
    return _passing(spark, sf, FilterSpec(
        include=(Pattern("purchase"),), exclude=("app\\[[0-9]*7\\]",),
        severities=("WARNING", "CRITICAL"), min_severity="WARNING"))


@query
def min_severity(spark, sf):
    lines = raw_logs(spark, sf).select(
        "source", "line_number", severity_rank(F.col("value")).cast("bigint").alias("rank"))
    return lines.filter(F.col("rank") >= sev.rank_of("WARNING"))


@query
def invert_match(spark, sf):
    return _named(search.filter_lines(
        raw_logs(spark, sf), "user|kernel", invert=True, min_severity="ERROR"))


@query
def filter_lines(spark, sf):
    return _named(search.filter_lines(raw_logs(spark, sf), "click|view", min_severity="WARNING"))


@query
def filter_json(spark, sf):
    return search.filter_json(raw_logs(spark, sf), now=NOW, pattern="signup", min_severity="INFO")


# --- search -----------------------------------------------------------------------------------

@query
def q_search(spark, sf):
    return _named(search.search(raw_logs(spark, sf), r"(user|app\[)", min_severity="ERROR"))


@query
def search_icase(spark, sf):
    return _named(search.search(raw_logs(spark, sf), "warning|Debug", ignore_case=True))


@query
def search_entries(spark, sf):
    return search.search_entries(raw_logs(spark, sf), "ERROR|purchase", now=NOW).select(
        "source", "line_number", "timestamp", "severity", "hostname", "process", "message")


@query
def search_context(spark, sf):
    found = search.search_context(doc_lines(spark, sf), "nterr|therr", ignore_case=True)
    return found.select("source", "line_number", "value", "is_match")


@query
def search_context_csv(spark, sf):
    found = search.search_context(
        raw_logs(spark, sf), "kernel: error", context=1, min_severity="ERROR")
    return search.search_csv(found)


@query
def search_max_count(spark, sf):
    return _named(search.search(raw_logs(spark, sf), "quoted", max_count=25))


@query
def search_count(spark, sf):
    return search.search_count(doc_lines(spark, sf), "the", invert=True)


# --- order ------------------------------------------------------------------------------------

@query
def tail_n(spark, sf):
    return ordering.tail_n(raw_logs(spark, sf), 10, pattern="USER|app", min_severity="WARNING").select(
        "source", "line_number", "value", "tail_pos")


@query
def limit_first(spark, sf):
    return _named(ordering.first_n(raw_logs(spark, sf), 100))


def _with_position(spark, sf) -> DataFrame:
    # Argument order src4, src3, .. src0.
    return raw_logs(spark, sf).withColumn(
        "source_pos", 4 - F.substring("source", 4, 1).cast("int"))


@query
def merge_sorted(spark, sf):
    merged = ordering.merge(_with_position(spark, sf), now=NOW, numbered=True)
    return merged.select("seq", "timestamp", "source", "line_number", "value")


@query
def merge_by_time(spark, sf):
    merged = ordering.merge(
        _with_position(spark, sf), now=NOW, by="event_time", year=2024, numbered=True)
    return merged.select("seq", "source", "line_number", "value")


@query
def merge_unsorted(spark, sf):
    merged = ordering.merge(_with_position(spark, sf), now=NOW, sort=False, numbered=True)
    return merged.select("seq", "source", "line_number", "value")


# --- aggregates -------------------------------------------------------------------------------

@query
def severity_counts(spark, sf):
    return stats.severity_counts(_entries(spark, sf))


@query
def source_counts(spark, sf):
    return stats.source_counts(raw_logs(spark, sf))


@query
def host_counts(spark, sf):
    return stats.host_counts(_entries(spark, sf))


@query
def stats_summary(spark, sf):
    return stats.line_stats(doc_lines(spark, sf), by_source=True)


@query
def stats_total(spark, sf):
    return stats.line_stats(raw_logs(spark, sf))


@query
def first_last_timestamp(spark, sf):
    return stats.first_last_timestamp(_entries(spark, sf))


@query
def severity_distribution(spark, sf):
    return stats.severity_distribution(_entries(spark, sf))


@query
def hourly_distribution(spark, sf):
    return stats.hourly_distribution(_entries(spark, sf))


@query
def hourly_histogram(spark, sf):
    return stats.hourly_histogram(_entries(spark, sf))


@query
def command_counts(spark, sf):
    return search.command_counts(raw_logs(spark, sf), "purchase", min_severity="ERROR")


@query
def stats_file_json(spark, sf):
    return stats.stats_file_json(_entries(spark, sf, keep=("value",)), detailed=True)


@query
def stats_json(spark, sf):
    return collector.stats_json(raw_logs(spark, sf), COLLECTOR, start_time=NOW, last_update=NOW)


@query
def stats_json_parts(spark, sf):
    return collector.stats_json_parts(
        raw_logs(spark, sf), COLLECTOR, start_time=NOW, last_update=NOW, per_part=2)


@query
def interval_lines(spark, sf):
    return _interval_text(stats.interval_stats(raw_logs(spark, sf), "ts", SPAN_MS))


@query
def interval_stats(spark, sf):
    return _interval_text(collector.interval_stats(raw_logs(spark, sf), COLLECTOR, SPAN_MS))


@query
def interval_stats_unlimited(spark, sf):
    return _interval_text(collector.interval_stats(raw_logs(spark, sf), STREAM, SPAN_MS))


def _interval_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("interval_start", F.date_format("interval_start", "yyyy-MM-dd HH:mm:ss"))


# --- rate limit and collector ----------------------------------------------------------------

@query
def q_rate_limit(spark, sf):
    return _named(rate_limit(raw_logs(spark, sf), PER_SOURCE))


@query
def rate_limit_window(spark, sf):
    return rate_limit(raw_logs(spark, sf), PER_TYPE, key=("event_type",)).select(
        "source", "line_number", "event_type")


@query
def rate_limit_global(spark, sf):
    return _named(rate_limit(raw_logs(spark, sf), GLOBAL, key=None))


@query
def q_rate_limit_bytes(spark, sf):
    return _named(rate_limit_bytes(raw_logs(spark, sf), BYTES))


@query
def collector_batch(spark, sf):
    return collector.collect(raw_logs(spark, sf), COLLECTOR).select(
        "source", "line_number", "output")


@query
def collector_counters(spark, sf):
    return collector.counters(raw_logs(spark, sf), COLLECTOR)


# --- enrichment and sinks --------------------------------------------------------------------

@query
def global_tags(spark, sf):
    own = F.create_map(F.lit("env"), F.lit("test"), F.lit("type"), F.col("event_type"))
    tagged = _entries(spark, sf, keep=("event_type",)).withColumn("tags", own)
    given = parse_tag_items(["env=prod", "rack=r=1", "bare"])
    return add_global_tags(tagged, given).select(
        "source", "line_number", F.to_json(formats.sorted_tags(F.col("tags"))).alias("tags"))


@query
def hostname_override(spark, sf):
    return override_hostname(_entries(spark, sf), "collector-7").select(
        "source", "line_number", "hostname", "parsed_hostname")


@query
def export_range(spark, sf):
    return filters.entries_in_range(
        raw_logs(spark, sf), "2024-01-05", "2024-01-09 12:00:00", now=NOW, year=2024).select(
        "source", "line_number", "timestamp", "message")


@query
def export_range_by_time(spark, sf):
    return filters.entries_in_range(
        raw_logs(spark, sf), "2024-01-05", "2024-01-09 12:00:00", by="event_time", now=NOW, year=2024).select(
        "source", "line_number", "timestamp", "message")


def _export(spark, sf, output_format: str) -> DataFrame:
    ranged = filters.entries_in_range(raw_logs(spark, sf), end="2024-01-20", now=NOW, year=2024)
    return ordering.first_n(ranged, 500).select(
        "source", "line_number", formats.formatted(output_format).alias("text"))


@query
def export_json(spark, sf):
    return _export(spark, sf, "json")


@query
def export_csv(spark, sf):
    return _export(spark, sf, "export_csv")


@query
def export_plain(spark, sf):
    return _export(spark, sf, "export_plain")


@query
def write_roundtrip(spark, sf):
    path = new_path(spark, "written")
    sinks.write_text(_entries(spark, sf), path, output_format="plain", compression="gzip")
    again = source.read_unnumbered(spark, [path]).withColumn("source", F.lit("again"))
    return parse(again, now=NOW).groupBy("timestamp", "severity", "message").agg(
        F.count(F.lit(1)).alias("lines"))


@query
def write_table_roundtrip(spark, sf):
    path = new_path(spark, "table")
    sinks.write_table(_entries(spark, sf), path)
    return spark.read.parquet(path).select(
        F.col("date").cast("string").alias("date"), "source", "line_number", "severity", "message")


@query
def size_buckets(spark, sf):
    return sinks.size_buckets(raw_logs(spark, sf), 4096).select(
        "source", "line_number", "bytes_before", "file_no")


@query
def retention_plan(spark, sf):
    dated = _entries(spark, sf).withColumn("date", F.to_date("event_time").cast("string"))
    return sinks.retention_plan(dated, 5)


# --- streams ---------------------------------------------------------------------------------

def _finish(rows: DataFrame, out: str, sink: streams.Hook | None = None,
            output_mode: str = "append") -> None:
    """Run a stream over what is there now."""
    streams.run(rows, f"{out}-checkpoint", [sink or streams.parquet_sink(out)],
                output_mode=output_mode).awaitTermination()


def _result(rows: DataFrame, name: str) -> DataFrame:
    """What a stream writes over what is there now."""
    out = new_path(rows.sparkSession, name)
    _finish(rows, out)
    return rows.sparkSession.read.schema(rows.schema).parquet(out).drop("batch")


@query
def stream_tail(spark, sf):
    folder = write_log_files(raw_logs(spark, sf))
    rows = _result(streams.follow(
        spark, source.expand(spark, folder), start="earliest", pattern="CLICK|user",
        min_severity="WARNING"), "tail")
    return rows.select(source.base_name(F.col("source")).substr(1, 4).alias("source"), "value")


@query
def stream_watch(spark, sf):
    folder = write_log_files(raw_logs(spark, sf))
    rows = _result(streams.watch(spark, folder, start="earliest", min_severity="ERROR"), "watch")
    return rows.select(F.col("filename").substr(1, 4).alias("source"), "value")


@query
def stream_replace(spark, sf):
    """Files are followed, replaced under the same names by those of later days, and followed on."""
    raw = raw_logs(spark, sf)
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    folder, later = write_log_files(raw.filter(early)), write_log_files(raw.filter(~early))
    out = new_path(spark, "replaced")
    rows = streams.watch(spark, folder, start="earliest")
    _finish(rows, out)
    replace_files(spark, later, folder)
    _finish(streams.watch(spark, folder, start="earliest"), out)
    found = spark.read.schema(rows.schema).parquet(out)
    return found.select(F.col("filename").substr(1, 4).alias("source"), "value")


@query
def stream_tail_then_follow(spark, sf):
    """The last 25 lines of each file of the earlier days, then all that comes after them."""
    raw = raw_logs(spark, sf)
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    folder, later = write_log_files(raw.filter(early)), write_log_files(raw.filter(~early), "new.log")
    files = source.expand(spark, folder)
    coming = [f"{folder}/{name.rsplit('/', 1)[1]}" for name in source.expand(spark, later)]
    last, rest = streams.tail_then_follow(spark, [*files, *coming], 25)
    replace_files(spark, later, folder)
    rows = last.select("source", "value").unionByName(_result(rest, "rest").select("source", "value"))
    return rows.select(source.base_name(F.col("source")).substr(1, 4).alias("source"), "value")


@query
def stream_collector(spark, sf):
    folder = write_log_files(raw_logs(spark, sf))
    rows = _result(collector.collect(streams.landing(spark, folder), STREAM), "collected")
    return rows.select(
        source.base_name(F.col("source")).substr(1, 4).alias("source"), "severity", "output")


def _replay(spark, sf, out: str, build: Callable[[DataFrame], DataFrame] | None = None,
            sink: streams.Hook | None = None, output_mode: str = "append") -> None:
    """The log table arrives in four slices of time, and the stream runs after each, going on
    from its checkpoint."""
    raw = raw_logs(spark, sf)
    incoming = new_path(spark, "incoming")
    edges = [F.lit(day).cast("timestamp_ntz") for day in ("2024-01-08", "2024-01-16", "2024-01-23")]
    slices = [F.col("ts") < edges[0],
              *[(F.col("ts") >= begin) & (F.col("ts") < end) for begin, end in zip(edges, edges[1:])],
              F.col("ts") >= edges[-1]]
    for part in slices:
        raw.filter(part).write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(raw.schema).parquet(incoming)
        _finish(build(stream) if build else stream, out, sink, output_mode)


def _replayed_ms(batch: DataFrame) -> int | None:
    """The time by which a replayed slice has arrived: its last stamp, whatever this machine's clock says."""
    return batch.agg(F.max("event_ms")).first()[0]


@query
def stream_rate_limit(spark, sf):
    out = new_path(spark, "limited")
    write = streams.parquet_sink(out)
    _replay(spark, sf, out, sink=lambda batch, i: write(
        _named(rate_limit_batch(batch, PER_SOURCE, f"{out}-buckets", i, time="event_ms", now_ms=_replayed_ms(batch))), i))
    return spark.read.schema("source string, line_number bigint, value string").parquet(
        out).drop("batch")


@query
def stream_collector_limited(spark, sf):
    out = new_path(spark, "limited")
    write = streams.parquet_sink(out)
    _replay(spark, sf, out, sink=lambda batch, i: write(
        collector.collect_batch(batch, COLLECTOR, f"{out}-buckets", i).select(
            "source", "line_number", "output"), i))
    return spark.read.schema("source string, line_number bigint, output string").parquet(
        out).drop("batch")


@query
def stream_counters(spark, sf):
    """The five totals of every micro-batch of the limited collector, and those up to it."""
    out = new_path(spark, "counted")
    write = streams.parquet_sink(out)
    _replay(spark, sf, out, sink=monitor.counted_sink(
        COLLECTOR, lambda rows, i: write(rows.select("output"), i), f"{out}-buckets", f"{out}-counters"))
    return monitor.counter_totals(spark, f"{out}-counters")


@query
def stream_stats(spark, sf):
    """The five totals by intervals of the lines' time; every micro-batch adds what it changes."""
    out = new_path(spark, "totals")
    write = streams.parquet_sink(out)
    _replay(spark, sf, out, sink=lambda batch, i: write(collector.interval_deltas(
        batch, COLLECTOR, SPAN_MS, state_dir=f"{out}-buckets", batch_id=i), i))
    deltas = spark.read.schema(
        "interval_start timestamp, " + ", ".join(f"{n} bigint" for n in collector.TOTALS)).parquet(out)
    summed = deltas.groupBy("interval_start").agg(*[F.sum(n).alias(n) for n in collector.TOTALS])
    return _interval_text(stats.cumulative(summed, SPAN_MS, collector.TOTALS))


@query
def stream_interval_lines(spark, sf):
    out = new_path(spark, "totals")
    _replay(spark, sf, out, lambda lines: streams.interval_totals(
        lines.withColumn("time", F.col("ts").cast("timestamp")), "time", "6 hours",
        late="3 hours"), output_mode="update")
    # Every batch wrote the intervals it changed; the last one to do so counts.
    updates = spark.read.schema(
        "interval_start timestamp, lines bigint, bytes bigint, batch bigint").parquet(out)
    latest = updates.groupBy("interval_start").agg(
        F.max_by(F.struct("lines", "bytes"), "batch").alias("last")).select(
        "interval_start", F.col("last.lines").alias("total_lines"), F.col("last.bytes").alias("bytes_processed"))
    return _interval_text(stats.cumulative(latest, SPAN_MS, ("total_lines", "bytes_processed")))
