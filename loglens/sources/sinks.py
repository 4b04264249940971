"""Writing entries, bounding output files, and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loglens.functions.formats import formatted
from loglens.operators.ordering import running_total
from loglens.sources.shared import materialize

# Hadoop codecs. The one for zstd needs Hadoop's native library on the executors;
# without it the write fails, nothing is silently left uncompressed.
COMPRESSIONS = {
    "none": "none", "gzip": "gzip", "zstd": "org.apache.hadoop.io.compress.ZStandardCodec"}


def write_text(entries: DataFrame, path: str, *, output_format: str = "plain",
               compression: str = "none", mode: str = "append",
               max_records_per_file: int = 0, header: str | None = None) -> None:
    """Append formatted lines as text files, each of at most ``max_records_per_file`` lines.

    ``header`` (as ``formats.csv_header()``) stands ahead of the lines in every file.
    """
    if compression not in COMPRESSIONS:
        raise ValueError(f"unknown compression: {compression!r}")
    if header is not None:
        # One column that is named like the header; nothing in it is quoted or cut again.
        (entries.select(formatted(output_format).alias(header)).write.mode(mode)
            .options(header=True, sep="\u0001", quote="", escape="\u0002", escapeQuotes=False, emptyValue="",
                     ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n",
                     compression=COMPRESSIONS[compression], maxRecordsPerFile=max_records_per_file).csv(path))
        return
    (entries.select(formatted(output_format).alias("value")).write.mode(mode)
        .option("lineSep", "\n").option("compression", COMPRESSIONS[compression])
        .option("maxRecordsPerFile", max_records_per_file).text(path))


#: Folder of entries without a time.
UNDATED = "undated"


def write_table(entries: DataFrame, path: str, *, mode: str = "append", rows_per_file: int = 5_000_000) -> None:
    """Write typed entries as parquet, one folder per day of ``event_time`` and one for entries without.

    Days are counted first, and each is dealt to as many tasks as it has files of ``rows_per_file`` rows: so a day has few files, however many
    tasks read the input, and a hot day is written by many.
    """
    dated = entries.withColumn("date", F.coalesce(F.to_date("event_time").cast("string"), F.lit(UNDATED)))
    counts = materialize(dated.groupBy("date").agg(
        F.ceil(F.count(F.lit(1)) / rows_per_file).cast("int").alias("_files")), "days")
    files = counts.agg(F.sum("_files")).first()[0] or 1
    # One row per day; its size is known, as it is stored. The file follows from the row, so a task that runs again deals alike.
    salted = dated.join(counts, "date").withColumn(
        "_file", F.pmod(F.xxhash64("source", "line_number", "message"), F.col("_files")))
    salted.repartition(files, "date", "_file").drop("_files", "_file").write.mode(mode).partitionBy("date").parquet(path)


def size_buckets(rows: DataFrame, max_bytes: int, text: str = "value") -> DataFrame:
    """File number of every line per source, such that a file starts within ``max_bytes``.

    A line goes to the file its start offset falls in, so a file exceeds the size by less
    than one line.
    """
    size = F.octet_length(text).cast("bigint") + 1
    placed = running_total(rows, size, "bytes_before")
    return placed.withColumn("file_no", F.expr(f"bytes_before div {int(max_bytes)}"))


def retention_plan(entries: DataFrame, keep: int, date: str = "date") -> DataFrame:
    """Dates of the output with their line counts; the newest ``keep`` are kept."""
    per_date = entries.groupBy(date).agg(F.count(F.lit(1)).alias("lines"))
    # One row per date: the age of the output bounds the unpartitioned window.
    newest = Window.orderBy(F.desc(date))
    return per_date.withColumn("keep", F.dense_rank().over(newest) <= keep)


def apply_retention(spark: SparkSession, path: str, keep: int, date: str = "date") -> tuple[list[str], list[str]]:
    """Delete all but the newest ``keep`` date folders of a table; returns (kept, dropped)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    prefix = f"{date}="
    folders = sorted(
        (s.getPath() for s in system.listStatus(root)
         if s.isDirectory() and s.getPath().getName().startswith(prefix)
         and not s.getPath().getName().endswith(("__HIVE_DEFAULT_PARTITION__", f"={UNDATED}"))),
        key=lambda p: p.getName(), reverse=True)
    for folder in folders[keep:]:
        system.delete(folder, True)
    names = [p.getName()[len(prefix):] for p in folders]
    return names[:keep], names[keep:]
