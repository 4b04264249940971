"""Text files as numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# A table per split or file of up to this many rows is broadcast (about 200 bytes a row, 50 MB in all);
# beyond it the planner joins by shuffle.
MAX_BROADCAST_SPLITS = 250_000


def _matches(spark: SparkSession, path: str):
    """What is at a path or matches a glob: a list in the JVM, of which nothing but its length need come here."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target) or ()


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path`` of the files that paths stand for, one row for each time; Spark lists them, many folders as a job."""
    # The content of files that only their names are asked of is never read.
    return spark.read.format("binaryFile").load(paths).select("path")


def expand(spark: SparkSession, path: str) -> list[str]:
    """Files a path stands for, in order of their names: glob matches, and the visible files of a folder."""
    if not len(_matches(spark, path)):
        return []
    name = F.regexp_replace("path", "^file:/+", "/")
    return [r[0] for r in listed(spark, [path]).select(name.alias("path")).orderBy("path").collect()]


def split_missing(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """Paths of the list, duplicates dropped, as (those that exist, those that do not)."""
    unique = list(dict.fromkeys(paths))
    found = {p: len(_matches(spark, p)) > 0 for p in unique}
    return [p for p in unique if found[p]], [p for p in unique if not found[p]]


def _distinct(spark: SparkSession, paths: list[str]) -> list[str]:
    """The list with no file in it twice, be it by name, by glob or within a listed folder.

    Mostly no file is, which Spark finds out; only else the names come here.
    """
    unique = list(dict.fromkeys(paths))
    if len(unique) == 1 or any(not len(_matches(spark, p)) for p in unique):
        return unique
    files = listed(spark, unique)
    if files.groupBy("path").count().where("count > 1").isEmpty():
        return unique
    return [r[0] for r in files.distinct().orderBy("path").collect()]


def plain_path(uri: Column) -> Column:
    """Path of a ``_metadata.file_path``: scheme of local files removed, escapes resolved."""
    path = F.regexp_replace(uri, "^file:/+", "/")
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _text(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(_distinct(spark, paths))


def _max_splits(text: DataFrame) -> int:
    """Upper bound for the number of file splits a text scan is cut into."""
    spark = text.sparkSession
    conf = spark._jsparkSession.sessionState().conf()
    total = int(text._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parallel = max(spark.sparkContext.defaultParallelism, 1)
    split_bytes = min(
        conf.filesMaxPartitionBytes(), max(conf.filesOpenCostInBytes(), total // parallel))
    # the names stay in the JVM
    return total // max(split_bytes, 1) + len(text._jdf.inputFiles())


def read_unnumbered(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(source, value)`` rows in one scan, for work that needs no line numbers."""
    return _text(spark, paths).select(
        plain_path(F.col("_metadata.file_path")).alias("source"), "value")


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(source, line_number, value)`` rows, numbered from 1 in each file.

    Lines never move: a first light scan counts the lines of every file split, running totals
    of those counts give each split its first number, and the second scan adds the position
    within the split. Only the per-split table is shuffled. A path listed twice is read once.
    """
    text = _text(spark, paths)
    # The row id must sit directly on the scan: it counts the rows of a task in read order.
    scan = text.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_row"),
        "value")
    counts = scan.groupBy("_file", "_split").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_file").orderBy("_split").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = counts.select(
        "_file", "_split", "_first", "_n",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    if _max_splits(text) <= MAX_BROADCAST_SPLITS:
        starts = F.broadcast(starts)
    # Both scans must be cut alike. They are, unless the cluster changes size between planning
    # them and the input is small; then the job stops instead of numbering wrongly.
    position = F.col("_row") - F.col("_first")
    number = F.when(
        position.between(0, F.col("_n") - 1), F.col("_before") + position + 1,
    ).otherwise(F.raise_error(F.lit("file splits differ between two scans")).cast("bigint"))
    return scan.join(starts, ["_file", "_split"], "left").select(
        plain_path(F.col("_file")).alias("source"), number.alias("line_number"), "value")


def read_existing(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """Lines of the paths that exist, and the list of those that do not."""
    present, missing = split_missing(spark, paths)
    if not present:
        empty = spark.createDataFrame([], "source string, line_number bigint, value string")
        return empty, missing
    return read_lines(spark, present), missing


def read_in_order(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines with ``source_pos``, the place of their file in the argument list."""
    files = {}
    for path in dict.fromkeys(paths):
        for name in expand(spark, path):
            files.setdefault(name, len(files))
    order = spark.createDataFrame(list(files.items()), "source string, source_pos int")
    if len(files) <= MAX_BROADCAST_SPLITS:
        order = F.broadcast(order)
    return read_lines(spark, list(files)).join(order, "source", "left")
