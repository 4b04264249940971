"""Tag maps and host names of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def parse_tag_items(items: list[str]) -> dict[str, str]:
    """``k=v`` settings of a job: split at the first '=', items without one are ignored."""
    return {k: v for k, sep, v in (item.partition("=") for item in items) if sep}


def parse_tags(items: Column) -> Column:
    """The same over an ``array<string>`` column; of equal keys the last one wins."""
    pairs = F.transform(
        F.filter(items, lambda item: F.contains(item, F.lit("="))),
        lambda item: F.struct(
            F.substring_index(item, "=", 1).alias("key"),
            F.substr(item, F.instr(item, "=") + 1).alias("value")))
    # Keep a pair when no later pair has its key, so the map never sees a duplicate.
    last = F.filter(pairs, lambda pair, i: ~F.exists(
        F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == pair["key"]))
    return F.map_from_entries(last)


def add_global_tags(entries: DataFrame, tags: dict[str, str]) -> DataFrame:
    """Put ``tags`` on every entry; on a shared key the global value wins."""
    if not tags:
        return entries
    names = list(tags)
    given = F.create_map(*[F.lit(x) for pair in tags.items() for x in pair])
    kept = F.map_filter("tags", lambda key, _: ~key.isin(names))
    return entries.withColumn("tags", F.map_concat(kept, given))


def override_hostname(entries: DataFrame, hostname: str | None) -> DataFrame:
    """Replace the host of every entry; the parsed one stays in ``parsed_hostname``."""
    if hostname is None:
        return entries
    return entries.withColumn("parsed_hostname", F.col("hostname")).withColumn(
        "hostname", F.lit(hostname))
