"""Entry -> text: JSON, plain, CSV and syslog lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Column orders of the CSV forms.
CSV_COLUMNS = ("timestamp", "severity", "source", "hostname", "process", "message")
EXPORT_CSV_COLUMNS = (
    "timestamp", "severity", "source", "hostname", "process", "line_number", "message")

# Syslog facility local0, and the severity codes of RFC 5424 by rank.
_FACILITY = 16
_RFC_CODES = (7, 6, 4, 3, 2)


def sorted_tags(tags: Column) -> Column:
    """The tag map with keys in order, null when empty so that JSON leaves the field out."""
    return F.when(F.size(tags) > 0, F.map_from_entries(F.array_sort(F.map_entries(tags))))


def to_json() -> Column:
    return F.to_json(F.struct(
        "timestamp", "severity", "source", "hostname", "process", "line_number", "message",
        sorted_tags(F.col("tags")).alias("tags")))


def to_plain() -> Column:
    host = F.when(F.col("hostname") == "", "").otherwise(F.concat("hostname", F.lit(" ")))
    process = F.when(F.col("process") == "", "").otherwise(F.concat("process", F.lit(": ")))
    return F.concat("timestamp", F.lit(" ["), "severity", F.lit("] "), host, process, "message")


def to_export_plain() -> Column:
    return F.concat("timestamp", F.lit(" ["), "severity", F.lit("] "), "message")


def csv_quote(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_header(columns: tuple[str, ...] = CSV_COLUMNS) -> str:
    return ",".join(columns)


def to_csv(columns: tuple[str, ...] = CSV_COLUMNS) -> Column:
    """All fields quoted, quotes doubled; the line number stays bare."""
    return F.concat_ws(",", *[
        F.col(c).cast("string") if c == "line_number" else csv_quote(F.col(c)) for c in columns])


def to_syslog(rfc_codes: bool = False) -> Column:
    """``<priority>1 stamp host process - - - message``; '-' stands for an empty field.

    The priority adds the rank to the facility; ``rfc_codes`` uses the standard codes instead.
    """
    rank = F.col("severity_rank")
    code = F.get(F.array(*[F.lit(c) for c in _RFC_CODES]), rank) if rfc_codes else rank

    def or_dash(name: str) -> Column:
        return F.when(F.col(name) == "", "-").otherwise(F.col(name))

    return F.concat(
        F.lit("<"), (code + _FACILITY * 8).cast("string"), F.lit(">1 "), "timestamp", F.lit(" "),
        or_dash("hostname"), F.lit(" "), or_dash("process"), F.lit(" - - - "), "message")


FORMATS = {
    "plain": to_plain, "json": to_json, "csv": to_csv, "syslog": to_syslog,
    "export_plain": to_export_plain,
    "export_csv": lambda: to_csv(EXPORT_CSV_COLUMNS),
}


def formatted(name: str) -> Column:
    if name not in FORMATS:
        raise ValueError(f"unknown output format: {name!r}")
    return FORMATS[name]()
