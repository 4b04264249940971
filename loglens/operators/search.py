"""Search and filter commands over numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loglens.functions.formats import csv_quote, to_json
from loglens.functions.parse import parse
from loglens.operators.filters import Pattern, line_condition
from loglens.operators.ordering import first_n
from loglens.sources.shared import materialize

_KEY = ["source", "line_number"]


def search(lines: DataFrame, pattern: str, *, ignore_case: bool = False, invert: bool = False,
           min_severity: str | None = None, max_count: int = 0) -> DataFrame:
    """Matching lines; ``max_count`` keeps the first ones in file order, 0 keeps all."""
    found = lines.filter(line_condition(
        F.col("value"), pattern, ignore_case=ignore_case, invert=invert,
        min_severity=min_severity))
    return first_n(found, max_count)


def search_count(lines: DataFrame, pattern: str, **options) -> DataFrame:
    """Number of matches, after ``max_count``."""
    return search(lines, pattern, **options).agg(F.count(F.lit(1)).alias("matches"))


def search_entries(lines: DataFrame, pattern: str, *, now: str, ignore_case: bool = False) -> DataFrame:
    """Matching lines as parsed entries."""
    return parse(search(lines, pattern, ignore_case=ignore_case), now=now)


def _block_lines(context: int) -> int:
    """Lines per block, such that a block has few ranges and a range few blocks."""
    return max(64, 4 * (context + 1))


def context_ranges(hits: DataFrame, context: int) -> DataFrame:
    """``(source, _block, _ranges)``: what to show of every block of lines, as ranges of line numbers.

    Matches of a block of a source become ranges; those that touch are one. A range that reaches into the block before or after is
    handed to it. A block has at most a match per line, so no list grows with the input, and a hot source
    is as many groups as it has blocks with matches.
    """
    size = _block_lines(context)
    block = F.floor((F.col("line_number") - 1) / size)
    lists = hits.groupBy("source", block.alias("_own")).agg(F.sort_array(F.collect_set("line_number")).alias("at"))
    apart = 2 * context + 1
    first = F.filter("at", lambda x, i: (i == 0) | (x - F.get("at", i - 1) > apart))
    last = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) - x > apart))
    ranges = lists.select("source", F.explode(F.arrays_zip(first.alias("first"), last.alias("last"))).alias("r")).select(
        "source", F.greatest(F.col("r.first") - context, F.lit(1)).alias("from"), (F.col("r.last") + context).alias("to"))
    reached = F.sequence(F.floor((F.col("from") - 1) / size), F.floor((F.col("to") - 1) / size))
    return ranges.select("source", F.explode(reached).alias("_block"), F.struct("from", "to").alias("range")).groupBy(
        "source", "_block").agg(F.collect_list("range").alias("_ranges"))


def search_context(lines: DataFrame, pattern: str, *, context: int = 2, max_count: int = 0, **options) -> DataFrame:
    """Matches with ``context`` lines around them, each once; ``is_match`` marks the matches.

    What to show is kept as a table of ranges by blocks of lines. Its size decides how it is joined: few ranges are broadcast and no line
    moves, many are joined by shuffle on the block, of which every line belongs to one. Whether a shown line is a match is
    looked up in the line itself.
    """
    matches = line_condition(F.col("value"), pattern, **options)
    found = lines.filter(matches).select(*_KEY)
    if max_count > 0:
        found = materialize(first_n(found, max_count), "matches")
        until = found.agg(F.max(F.struct(*_KEY)).alias("last")).select("last.*").first()
        matches = matches & (F.struct(*_KEY) <= F.struct(
            F.lit(until["source"]).alias("source"), F.lit(until["line_number"]).cast("bigint").alias("line_number")))
    near = materialize(context_ranges(found, context), "context")
    block = F.floor((F.col("line_number") - 1) / _block_lines(context))
    shown = F.exists("_ranges", lambda r: F.col("line_number").between(r["from"], r["to"]))
    return lines.withColumn("_block", block).join(near, ["source", "_block"]).filter(shown).select(
        *lines.columns, F.coalesce(matches, F.lit(False)).alias("is_match"))


def search_csv(found: DataFrame) -> DataFrame:
    """Search result rows ``line_number,"line",is_match`` as text."""
    return found.select("source", "line_number", F.concat_ws(
        ",", F.col("line_number").cast("string"), csv_quote(F.col("value")),
        F.col("is_match").cast("int").cast("string")).alias("csv"))


def match_position(lines: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Place (1-based), length in characters and text of the first match of every matching line."""
    checked = Pattern(pattern, ignore_case).check()
    regex = F.lit(checked.java)
    text = F.regexp_substr("value", regex)
    return lines.filter(checked.found_in(F.col("value"))).select(
        *_KEY, text.alias("match_text"),
        F.regexp_instr("value", regex).cast("bigint").alias("match_start"),
        F.length(text).cast("bigint").alias("match_length"))


def filter_lines(lines: DataFrame, pattern: str | None = None, *, ignore_case: bool = False,
                 invert: bool = False, min_severity: str | None = None) -> DataFrame:
    """Lines that pass; without a pattern ``invert`` has nothing to turn."""
    return lines.filter(line_condition(
        F.col("value"), pattern, ignore_case=ignore_case, invert=invert,
        min_severity=min_severity))


def filter_json(lines: DataFrame, *, now: str, **options) -> DataFrame:
    """Lines that pass, as JSON objects."""
    entries = parse(filter_lines(lines, **options), now=now)
    return entries.select(*_KEY, to_json().alias("json"))


def command_counts(lines: DataFrame, pattern: str | None = None, **options) -> DataFrame:
    """Processed and matched line counts of a filter command, in one pass."""
    passed = line_condition(F.col("value"), pattern, **options)
    return lines.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(passed).alias("matched"))
