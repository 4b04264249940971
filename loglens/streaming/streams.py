"""Streams of log lines and the queries run on them."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from loglens.operators.filters import line_condition
from loglens.operators.ordering import tail_n
from loglens.operators.stats import interval_counts
from loglens.sources import tail
from loglens.sources.lines import base_name, listed, plain_path

log = logging.getLogger(__name__)

Hook = Callable[[DataFrame, int], None]


def _qualified(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The path as Hadoop's file systems name it, so that all machines read the same file, and whether it is there."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = named.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(named).toString(), system.exists(named)


def _tail(spark: SparkSession, reader, paths: list[str], **options) -> DataFrame:
    tail.register(spark)
    return reader.format(tail.TailSource.name()).option("paths", json.dumps(paths)).options(
        **{k: v for k, v in options.items() if v is not None}).load()


def last_offset(spark: SparkSession, checkpoint: str) -> str | None:
    """The offset of the last micro-batch that a query of one tail source planned, as its checkpoint has it; none before the first."""
    try:
        files = listed(spark, [f"{checkpoint}/offsets"]).collect()
    except AnalysisException:  # no such folder yet
        return None
    numbers = {int(name): r[0] for r in files if (name := r[0].rsplit("/", 1)[-1]).isdigit()}
    if not numbers:
        return None
    text = spark.read.text(numbers[max(numbers)], wholetext=True).first()[0]
    offsets = text.rstrip("\n").split("\n")[2:]  # behind a version and the batch's settings
    return offsets[0] if len(offsets) == 1 else None


def _followed(spark: SparkSession, paths: list[str]) -> list[str]:
    found = {path: _qualified(spark, path) for path in dict.fromkeys(paths)}
    for path, (_, there) in found.items():
        if not there:
            log.warning("nothing to follow yet: %s", path)
    return [name for name, _ in found.values()]


def follow(spark: SparkSession, paths: list[str], *, start: str = "latest",
           pattern: str | None = None, min_severity: str | None = None,
           max_bytes: int | None = None, last_line: bool = False, checkpoint: str | None = None) -> DataFrame:
    """Lines appended to the given files, ``(source, position, value)``; the pattern ignores case.

    A path that isn't there yet is reported in the log and followed from its beginning once it is. ``max_bytes``
    bounds a micro-batch of a running query, with ``checkpoint`` also the first one of a query that goes on from
    there after a long outage. ``last_line`` also takes a last line without newline, for finished files.
    """
    lines = _tail(spark, spark.readStream, _followed(spark, paths), start=start,
                  maxBytesPerTrigger=max_bytes, lastLine=last_line,
                  resume=last_offset(spark, checkpoint) if checkpoint else None)
    return lines.filter(line_condition(
        F.col("value"), pattern, ignore_case=True, min_severity=min_severity))


def tail_then_follow(spark: SparkSession, paths: list[str], n: int = 10, *, pattern: str | None = None,
                     min_severity: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The last ``n`` matching lines of each file as it is now, and the stream of those that come after them.

    Both meet at the same place in each file, so no line is lost or comes twice.
    """
    named = _followed(spark, paths)
    now = json.dumps(tail.TailReader({"paths": json.dumps(named)}).initialOffset())
    there = _tail(spark, spark.read, named, until=now).withColumnRenamed("position", "line_number")
    last = tail_n(there, n, pattern, min_severity).withColumnRenamed("line_number", "position")
    return last, follow(spark, paths, start=now, pattern=pattern, min_severity=min_severity)


def watch(spark: SparkSession, directory: str, *, files: str = "*.log", start: str = "latest",
          pattern: str | None = None, min_severity: str | None = None,
          max_bytes: int | None = None, last_line: bool = False, checkpoint: str | None = None) -> DataFrame:
    """Lines appended to the matching files of a folder, new files included, with ``filename``.

    A folder that does not exist is an error. The other options are those of ``follow``.
    """
    folder, there = _qualified(spark, directory)
    if not there:
        raise FileNotFoundError(directory)
    tail.register(spark)
    lines = (spark.readStream.format(tail.TailSource.name()).option("directory", folder)
             .option("pattern", files).option("start", start).option("lastLine", last_line))
    if max_bytes is not None:
        lines = lines.option("maxBytesPerTrigger", max_bytes)
    if checkpoint is not None and (resume := last_offset(spark, checkpoint)):
        lines = lines.option("resume", resume)
    found = lines.load().filter(line_condition(
        F.col("value"), pattern, ignore_case=True, min_severity=min_severity))
    return found.withColumn("filename", base_name(F.col("source")))


def landing(spark: SparkSession, directory: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Lines of finished files that a shipper drops into a folder."""
    text = (spark.readStream.option("lineSep", "\n")
            .option("maxFilesPerTrigger", max_files_per_trigger).text(directory))
    return text.select(plain_path(F.col("_metadata.file_path")).alias("source"), "value")


def interval_totals(lines: DataFrame, time: str, interval: str, late: str) -> DataFrame:
    """Lines and bytes per interval, for update mode: kept current until ``late`` has passed."""
    return interval_counts(lines.withWatermark(time, late), time, interval)


def run(rows: DataFrame, checkpoint: str, hooks: list[Hook], *, once: bool = True,
        every: str = "1 second", output_mode: str = "append", name: str | None = None,
        on_hook_error: Callable[[str], None] | None = None) -> StreamingQuery:
    """Start a query that hands every micro-batch to the hooks.

    The first hook is the sink: its errors stop the query, so the batch is tried again; ``monitor.ErrorListener``
    hears of that. Errors of the others are logged, told to ``on_hook_error`` and do not disturb the stream. ``once``
    handles what is there and ends.
    """
    sink, others = hooks[0], hooks[1:]

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if others:
            batch = batch.persist()
        sink(batch, batch_id)
        for hook in others:
            try:
                hook(batch, batch_id)
            except Exception as error:
                log.exception("a hook failed on batch %s", batch_id)
                if on_hook_error:
                    on_hook_error(f"batch {batch_id}: {error!r}")
        if others:
            batch.unpersist()

    writer = (rows.writeStream.foreachBatch(on_batch).outputMode(output_mode)
              .option("checkpointLocation", checkpoint))
    if name:
        writer = writer.queryName(name)
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=every).start()


def parquet_sink(path: str) -> Hook:
    """Write every batch to a folder of its own, so that a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write
