"""Log tables derived from the given tables; inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loglens.sources.shared import new_path

NOW = "2024-02-01 00:00:00"
LOG_FILE_LINES = 5_000_000


def _table(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """Columns of a table; one read as fewer pieces than there are cores is spread over them.

    Such a table is small (a piece is at most one file split), a large one stays where it is.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line per event: ``source, line_number, value, ts, event_ms, event_type``.

    Of every six events two go to ``src0`` and one to each of ``src1`` .. ``src4``, so one
    source holds a third of all lines. Numbers follow from the dense event id, no shuffle.
    """
    events = _table(
        spark, sf_dir, "events", "event_id", "event_id", "ts", "user_id", "event_type", "props")
    id_ = F.col("event_id")
    lane = id_ % 6
    turn = F.floor(id_ / 6)
    source = F.concat(F.lit("src"), F.greatest(lane - 1, F.lit(0)).cast("string"))
    number = F.when(lane < 2, turn * 2 + lane + 1).otherwise(turn + 1)
    level = F.element_at(F.array(*[F.lit(w) for w in (
        "DEBUG", "INFO", "WARN", "ERROR", "CRIT", "FATAL", "notice", "Warning")]),
        (turn % 8 + 1).cast("int"))
    iso = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    named = F.concat(
        F.date_format("ts", "MMM "), F.lpad(F.date_format("ts", "d"), 2, " "),
        F.date_format("ts", " HH:mm:ss"))
    host = F.concat(F.lit(" host"), (F.col("user_id") % 7).cast("string"), F.lit(" "))
    value = (
        F.when(id_ % 5 == 0, F.concat(
            iso, F.lit(" ["), level, F.lit("] user "), F.col("user_id").cast("string"),
            F.lit(" "), "props"))
        .when(id_ % 5 == 1, F.concat(
            iso, F.lit(" "), level, F.lit(" "), "event_type", F.lit(" v="), "props"))
        .when(id_ % 5 == 2, F.concat(
            named, host, F.lit("app["), id_.cast("string"), F.lit("]: "), "event_type",
            F.lit(" "), level))
        .when(id_ % 5 == 3, F.concat(named, host, F.lit("kernel: "), "event_type"))
        .otherwise(F.concat("event_type", F.lit(' "quoted" \\ '), "props")))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return events.select(
        source.alias("source"), number.cast("bigint").alias("line_number"),
        # As the output of a generator the text is a plain column to the operators above, as it
        # is in a real log table; else every predicate would repeat the templates.
        F.explode(F.array(value)).alias("value"), "ts",
        F.timestamp_diff("MILLISECOND", epoch, F.col("ts")).alias("event_ms"), "event_type")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document: ``source`` is the document, numbered from 1."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "doc_id", "text")
    return docs.select(
        F.col("doc_id").cast("string").alias("source"),
        F.posexplode(F.split("text", "\n")).alias("_pos", "value"),
    ).select("source", (F.col("_pos") + 1).cast("bigint").alias("line_number"), "value")


def write_log_files(lines: DataFrame, extension: str = "log") -> str:
    """Lines as flat files ``<source>.<block>.<extension>`` of at most 5,000,000 lines each.

    Returns the folder. Every file keeps its lines in order; block ``k`` of a source starts
    after line ``k * 5000000``.
    """
    spark = lines.sparkSession
    root = new_path(spark, "logs")
    block = F.floor((F.col("line_number") - 1) / LOG_FILE_LINES)
    (lines.select("source", block.alias("block"), "line_number", "value")
        .repartition("source", "block")
        .sortWithinPartitions("source", "block", "line_number")
        .select("source", "block", "value")
        .write.partitionBy("source", "block").text(f"{root}/staged", lineSep="\n"))
    # Spark names its part files itself; give them the flat names a log folder has.
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(f"{root}/flat"))
    for status in system.globStatus(path(f"{root}/staged/source=*/block=*/part-*")):
        part = status.getPath()
        block_name = part.getParent().getName().split("=", 1)[1]
        source_name = part.getParent().getParent().getName().split("=", 1)[1]
        name = f"{root}/flat/{source_name}.{block_name}.{extension}"
        if not system.rename(part, path(name)):
            raise RuntimeError(f"cannot name a log file {name}")
    return f"{root}/flat"


def replace_files(spark: SparkSession, new: str, old: str) -> None:
    """Move the files of one folder over those of the same names in another."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(old).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(path(new)):
        target = path(old, status.getPath().getName())
        system.delete(target, False)
        if not system.rename(status.getPath(), target):
            raise RuntimeError(f"cannot replace {target.toString()}")


def original_position(lines: DataFrame) -> DataFrame:
    """Map file names written by ``write_log_files`` back to source and line number."""
    name = F.element_at(F.split("source", "/"), -1)
    parts = F.split(name, r"\.")
    return lines.withColumns({
        "source": parts[0],
        "line_number": F.col("line_number") + parts[1].cast("bigint") * LOG_FILE_LINES})
