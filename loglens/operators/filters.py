"""Line predicates as Columns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loglens.functions import severity as sev
from loglens.functions.parse import parse, severity_rank


@dataclass(frozen=True)
class Pattern:
    """A regular expression searched anywhere in a line (Java syntax)."""

    regex: str
    ignore_case: bool = False

    @property
    def java(self) -> str:
        return f"(?i){self.regex}" if self.ignore_case else self.regex

    def check(self) -> "Pattern":
        """Compile on the driver, so that a bad pattern fails before any job starts."""
        try:
            SparkSession.active()._jvm.java.util.regex.Pattern.compile(self.java)
        except IllegalArgumentException as error:
            raise ValueError(f"invalid pattern {self.regex!r}") from error
        return self

    def found_in(self, text: Column) -> Column:
        return text.rlike(self.check().java)


def _any(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


@dataclass(frozen=True)
class FilterSpec:
    """Which lines pass.

    A line that an ``exclude`` pattern matches fails. Without ``include`` and ``severities``
    every other line passes; any ``include`` match passes. A severity set is an alternative to
    the patterns: with it, lines below ``min_severity`` fail and lines of a listed level pass.
    What is still undecided passes only if there are no ``include`` patterns - so a severity set
    alone rejects nothing at or above the minimum. ``strict_severity`` makes it reject.
    """

    include: tuple[Pattern, ...] = ()
    exclude: tuple[str, ...] = ()
    severities: tuple[str, ...] = ()
    min_severity: str = "DEBUG"
    strict_severity: bool = False

    def condition(self, value: Column, rank: Column | None = None) -> Column:
        rank = severity_rank(value) if rank is None else rank
        wanted = [sev.rank_of(name) for name in self.severities]
        verdict = F.lit(not self.include and not (wanted and self.strict_severity))
        if wanted:
            verdict = (rank >= sev.rank_of(self.min_severity)) & (rank.isin(wanted) | verdict)
        if self.include:
            verdict = _any([p.found_in(value) for p in self.include]) | verdict
        if self.exclude:
            verdict = ~_any([Pattern(p).found_in(value) for p in self.exclude]) & verdict
        return verdict


def at_least(value: Column, level: str) -> Column:
    """Lines of at least this level."""
    return severity_rank(value) >= sev.rank_of(level)


def line_condition(value: Column, pattern: str | None, *, ignore_case: bool = False,
                   invert: bool = False, min_severity: str | None = None) -> Column:
    """Predicate of the search, tail and filter commands; ``invert`` turns the pattern only."""
    condition = F.lit(True)
    if pattern is not None:
        found = Pattern(pattern, ignore_case).found_in(value)
        condition = ~found if invert else found
    if min_severity is not None:
        condition = condition & at_least(value, min_severity)
    return condition


def in_time_range(entries: DataFrame, start: str | None = None, end: str | None = None,
                  by: str = "timestamp") -> DataFrame:
    """Entries from ``start`` to ``end``, both inclusive.

    ``by="timestamp"`` compares stamp texts, so an end of ``2025-12-04`` leaves that day out;
    ``by="event_time"`` compares time points.
    """
    if by not in ("timestamp", "event_time"):
        raise ValueError(f"cannot range over {by!r}")

    def bound(text: str) -> Column:
        return F.lit(text) if by == "timestamp" else F.lit(text).cast("timestamp")

    if start is not None:
        entries = entries.filter(F.col(by) >= bound(start))
    if end is not None:
        entries = entries.filter(F.col(by) <= bound(end))
    return entries


def may_be_in_range(value: Column, start: str | None, end: str | None, now: str | None) -> Column:
    """A test of raw lines that every line passes whose entry is ``in_time_range``, and that needs no parsing.

    It compares the ten characters of a leading date. Lines that begin with one either have it in their stamp or are stamped
    with ``now``; so where ``now`` is unknown or might be in the range, or a bound begins with no date, all lines pass.
    """
    day = r"\d{4}-\d{2}-\d{2}"
    if now is None or not all(re.match(day, text) for text in (now, start or now, end or now)):
        return F.lit(True)
    if (start is None or now[:10] >= start[:10]) and (end is None or now[:10] <= end[:10]):
        return F.lit(True)
    dated = (F.substr(value, F.lit(5), F.lit(1)) == "-") & (F.substr(value, F.lit(8), F.lit(1)) == "-")
    date, inside = F.substr(value, F.lit(1), F.lit(10)), F.lit(True)
    if start is not None:
        inside = inside & (date >= start[:10])
    if end is not None:
        inside = inside & (date <= end[:10])
    return F.coalesce(~dated | inside, F.lit(True))


def entries_in_range(lines: DataFrame, start: str | None = None, end: str | None = None, by: str = "timestamp", *,
                     now: str | None = None, year: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``in_time_range`` of the entries of raw lines; lines of other days go before they are parsed."""
    near = lines.filter(may_be_in_range(F.col("value"), start, end, now))
    return in_time_range(parse(near, now=now, year=year, keep=keep), start, end, by)
