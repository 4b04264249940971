import pytest
from pyspark.sql import functions as F

from loglens.operators import filters, search
from loglens.operators.filters import FilterSpec, Pattern
from loglens.functions.parse import parse

NOW = "2030-01-01 00:00:00"


def passing(lines, spec, *texts):
    rows = lines(*texts).filter(spec.condition(F.col("value"))).collect()
    return [r.value for r in sorted(rows, key=lambda r: r.line_number)]


ALL = ("ERROR x", "CRITICAL x", "INFO an error", "DEBUG on", "WARNING low")


@pytest.mark.parametrize("spec,expected", [
    (FilterSpec(), ALL),
    (FilterSpec(include=(Pattern("ERROR|CRITICAL"),)), ("ERROR x", "CRITICAL x")),
    (FilterSpec(include=(Pattern("error"),)), ("INFO an error",)),
    (FilterSpec(include=(Pattern("error", True),)), ("ERROR x", "INFO an error")),
    (FilterSpec(include=(Pattern(""),)), ALL),
    (FilterSpec(include=(Pattern(".*"),), exclude=("DEBUG",)), ("ERROR x", "CRITICAL x", "INFO an error", "WARNING low")),
    (FilterSpec(exclude=("x$", "low")), ("INFO an error", "DEBUG on")),
    # A severity set alone rejects nothing at or above the minimum ...
    (FilterSpec(severities=("ERROR",)), ALL),
    (FilterSpec(severities=("ERROR",), min_severity="WARNING"), ("ERROR x", "CRITICAL x", "INFO an error", "WARNING low")),
    # ... unless it is strict.
    (FilterSpec(severities=("ERROR",), strict_severity=True), ("ERROR x", "INFO an error")),
    (FilterSpec(include=(Pattern("on"),), severities=("CRITICAL", "DEBUG"), min_severity="INFO"), ("CRITICAL x", "DEBUG on")),
])
def test_composite(lines, spec, expected):
    assert passing(lines, spec, *ALL) == list(expected)


def test_bad_pattern(spark):
    with pytest.raises(ValueError):
        Pattern("[unbalanced(").check()


@pytest.mark.parametrize("regex,text", [
    (r"\(retry\)", "job (retry) 2"), (r"disk\+tape", "disk+tape"), (r"^vol\d{2}\$", "vol17$")])
def test_metacharacters(lines, regex, text):
    assert passing(lines, FilterSpec(include=(Pattern(regex),)), text, "none") == [text]


def test_long_line(lines):
    text = "hay " * 9_000 + "needle" + " straw" * 5_000
    assert passing(lines, FilterSpec(include=(Pattern("needle"),)), text) == [text]


def test_invert_keeps_severity_test(lines):
    rows = search.filter_lines(lines(*ALL), "x", invert=True, min_severity="WARNING").collect()
    assert sorted(r.value for r in rows) == ["INFO an error", "WARNING low"]
    # Without a pattern there is nothing to invert.
    assert search.filter_lines(lines(*ALL), invert=True).count() == len(ALL)


def test_bad_severity(lines):
    with pytest.raises(ValueError):
        search.filter_lines(lines("x"), min_severity="LOUD")


def test_range_compares_text(lines):
    entries = parse(lines("2031-07-08 21:14:07 INFO a", "2031-07-09 21:14:07 INFO b"), now=NOW)
    assert filters.in_time_range(entries, end="2031-07-09").count() == 1
    assert filters.in_time_range(entries, "2031-07-09 21:14:07", "2031-07-09 21:14:07").count() == 1
    assert filters.in_time_range(entries, end="2031-07-09 21:14:07", by="event_time").count() == 2


def test_search_entries(lines):
    gate = lines(
        "2031-07-09 21:14:07 [INFO] gate opened", "2031-07-09 21:14:50 [ERROR] gate stuck",
        "2031-07-09 21:15:02 [WARNING] gate ajar for 40 s", "2031-07-09 21:15:03 [DEBUG] motor idle",
        "2031-07-09 21:19:44 [CRITICAL] Gate lost")
    assert search.search_entries(gate, "stuck|ajar", now=NOW).count() == 2
    found = search.search_entries(gate, "gate", now=NOW, ignore_case=True)
    assert sorted(r.line_number for r in found.collect()) == [1, 2, 3, 5]


def test_match_position_is_of_the_match(lines):
    row = search.match_position(lines("concat cat"), r"\bcat").first()
    assert (row.match_start, row.match_length, row.match_text) == (8, 3, "cat")


RANGES = [("2025-01-02", "2025-01-04"), ("2025-01-02 10:00:00", None), (None, "2025-01-03"), ("2025-01-03 00:00:00", "2025-01-03 00:00:00"),
          ("2024", "2026"), ("Jan", None)]


@pytest.mark.parametrize("by", ["timestamp", "event_time"])
@pytest.mark.parametrize("now", ["2030-01-01 00:00:00", "2025-01-03 12:00:00", None])
@pytest.mark.parametrize("start, end", RANGES)
def test_raw_test_of_a_range_lets_every_entry_of_it_through(lines, by, now, start, end):
    if by == "event_time" and (start in ("2024", "Jan") or now is None):
        pytest.skip("no time point, or one that changes between two queries")
    rows = lines(*[f"2025-01-0{d} {h}:00:00 {w} x" for d in range(1, 6) for h in ("00", "10") for w in ("INFO", "[ERROR]")],
                 "2025-01-03", "2025-01-03 00:00:00", "2024-99-99 00:00:00 INFO x", "Jan  3 10:00:00 host app: m", "....-..-.", "", "plain")
    slow = filters.in_time_range(parse(rows, now=now, year=2025), start, end, by)
    fast = filters.entries_in_range(rows, start, end, by, now=now, year=2025)
    key = lambda df: sorted((r.line_number, r.message) for r in df.collect())
    assert key(fast) == key(slow)


def test_range_that_holds_now_keeps_lines_that_begin_with_a_date(lines):
    # no level word, so the line is stamped with now
    rows = lines("2025-01-01", "2025-01-03 00:00:00 INFO x")
    found = filters.entries_in_range(rows, "2025-01-03", "2025-01-05", now="2025-01-04 00:00:00")
    assert sorted(r.line_number for r in found.collect()) == [1, 2]


def parses(df):
    """How often the regular expression of a line stands in the plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(r"^(?:(\w{3}")


@pytest.mark.parametrize("name", ["export_range", "export_range_by_time", "collector_batch", "export_json"])
def test_lines_are_parsed_once(spark, name):
    from loglens.plans.queries import QUERIES
    assert parses(QUERIES[name](spark, "/root/testdata/sf0.001")) == 1


def test_intervals_read_and_parse_lines_once(lines):
    from loglens.plans import collector
    rows = lines("a").withColumn("event_ms", F.lit(5).cast("bigint"))
    assert parses(collector.interval_deltas(rows, collector.CollectorConfig(now=NOW, filter=FilterSpec(min_severity="INFO")), 10)) == 1


def test_severity_sets_are_looked_up_in_the_entry(lines):
    from loglens.plans import collector
    config = collector.CollectorConfig(now="2030-01-01 00:00:00", filter=FilterSpec(
        include=(Pattern("a"),), exclude=("b",), severities=("ERROR",), min_severity="WARNING"))
    rows = lines("a ERROR", "b ERROR", "ERROR", "a INFO", "a WARN", "WARN", "ab ERROR")
    entries = collector.collect(rows, config)
    assert parses(entries) == 1
    old = rows.filter(config.filter.condition(F.col("value"))).join(
        parse(rows, now=config.now).filter("severity_rank >= 2").select("line_number"), "line_number")
    assert sorted(r.line_number for r in entries.collect()) == sorted(r.line_number for r in old.collect()) != []
