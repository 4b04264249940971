"""Raw line -> typed log entry, as Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loglens.functions import severity as sev
from loglens.functions.schema import ENTRY_COLUMNS

# Fixed formats: the pieces of the two accepted line shapes. A blank is any white space but a
# newline, which no line contains.
_BLANK = r"[^\S\n]"
_CLOCK = r"\d{2}:\d{2}:\d{2}"
_REST = r"[^\r\n]*"
_NAMED_STAMP = rf"\w{{3}}{_BLANK}+\d{{1,2}}{_BLANK}+{_CLOCK}"
_ISO_STAMP = rf"\d{{4}}-\d{{2}}-\d{{2}}{_BLANK}+{_CLOCK}"
_SYSLOG = (
    rf"({_NAMED_STAMP})"
    rf"{_BLANK}+(\S+)"                                # host
    rf"{_BLANK}+(\S+?)(?:\[(\d+)\])?:"                # process[pid]:
    rf"{_BLANK}*({_REST})"                            # message
)
_ISO = (
    rf"({_ISO_STAMP})"
    rf"{_BLANK}+\[?(\w+)\]?"                          # level word, used up even if no level
    rf"{_BLANK}*({_REST})"                            # message
)
# One pass over the line yields every field, separated by newlines: the groups of the shape
# that did not match are empty. Fields: stamp, host, process, pid, level word, message.
_LINE = rf"^(?:{_SYSLOG}|{_ISO})\z"
_FIELDS = "\n$1$6\n$2\n$3\n$4\n$7\n$5$8"

# Month names of the syslog stamp.
_MONTHS = "Jan-Feb-Mar-Apr-May-Jun-Jul-Aug-Sep-Oct-Nov-Dec"

_HOUR = rf"(\d{{2}}):\d{{2}}:\d{{2}}"


def severity_rank(value: Column, word_boundary: bool = False) -> Column:
    """Rank of a raw line without parsing the rest of it; for predicates on raw lines."""
    token = F.regexp_extract(value, rf"^{_ISO}\z", 2)
    return sev.line_rank(value, token, word_boundary)


def hour_of(timestamp: Column) -> Column:
    """Two-digit hour of a stamp, '' when it has no clock part."""
    return F.regexp_extract(timestamp, _HOUR, 1)


def line_bytes(value: Column) -> Column:
    return F.octet_length(value).cast("bigint")


def event_time(timestamp: Column, year: int | None) -> Column:
    """Time point of a stamp; month-name stamps carry no year and need one, else null."""
    text = F.regexp_replace(timestamp, r"\s+", " ")
    iso = F.when(F.substr(timestamp, F.lit(5), F.lit(1)) == "-", text)
    if year is not None:
        # Every name takes four places of the list; no three letters span its dashes.
        month = F.floor((F.instr(F.lit(_MONTHS), F.substr(text, F.lit(1), F.lit(3))) + 3) / 4)
        named = F.concat(F.lit(f"{year}-"), month.cast("string"), F.lit("-"), F.substr(text, F.lit(5)))
        iso = F.coalesce(iso, named)
    return F.try_to_timestamp(iso)


def _moment(now: str | None) -> Column:
    """``now`` as text; without it the time of the query, on streams that of the micro-batch."""
    return F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def with_event_ms(lines: DataFrame, *, now: str | None = None, year: int | None = None) -> DataFrame:
    """Raw lines with ``event_ms``, their own stamp as epoch milliseconds, else that of ``now``."""
    stamp = F.regexp_extract("value", rf"^({_ISO_STAMP}|{_NAMED_STAMP})", 1)
    time = F.coalesce(event_time(stamp, year), _moment(now).cast("timestamp"))
    return lines.withColumn("event_ms", F.unix_millis(time))


def parse(lines: DataFrame, *, now: str | None = None, year: int | None = None, strip_cr: bool = False,
          word_boundary: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parse ``(source, line_number, value)`` rows into entries.

    ``now`` stamps the lines that carry no stamp of their own. A fixed one gives the same rows whenever the query runs;
    without it the query's time is used, on streams that of each micro-batch. Columns named in ``keep`` travel along unchanged; ``line_number``
    is 0 where the input has none (streams).
    """
    value = F.regexp_replace("value", r"\r\z", "") if strip_cr else F.col("value")
    number = F.col("line_number").cast("bigint") if "line_number" in lines.columns else F.lit(0).cast("bigint")
    extra = [c for c in keep if c not in ENTRY_COLUMNS]

    split = lines.select(
        "source", number.alias("line_number"), *extra, value.alias("_value"),
        F.regexp_replace(value, F.lit(_LINE), F.lit(_FIELDS)).alias("_marked"))
    matched = F.col("_marked").startswith("\n") & ~F.col("_value").contains("\n")
    # The output of a generator is a plain column to whatever comes after: predicates on an entry's fields stay above it, where
    # they cost a look at the field, instead of being moved below with a regular expression of their own each.
    cut = split.select("*", F.explode(F.array(F.when(matched, F.split("_marked", "\n")))).alias("_f"))

    def field(position: int) -> Column:
        return F.coalesce(F.col("_f")[position], F.lit(""))

    stamped = cut.select(
        "source", "line_number", *extra,
        F.coalesce(F.col("_f")[1], _moment(now)).alias("timestamp"),
        sev.line_rank(F.col("_value"), field(5), word_boundary).alias("severity_rank"),
        field(2).alias("hostname"), field(3).alias("process"), field(4).alias("pid"),
        F.coalesce(F.col("_f")[6], F.col("_value")).alias("message"))
    return stamped.select(
        "timestamp",
        _moment(now).cast("timestamp").alias("ingest_time"),
        event_time(F.col("timestamp"), year).alias("event_time"),
        sev.to_string(F.col("severity_rank")).alias("severity"), "severity_rank",
        "source", "hostname", "process", "pid", "message",
        F.create_map().cast("map<string,string>").alias("tags"),
        "line_number", *extra)
