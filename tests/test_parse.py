import pytest

from loglens.functions import severity as sev
from loglens.functions.parse import parse, with_event_ms
from pyspark.sql import functions as F

NOW = "2030-01-01 00:00:00"

# line -> (timestamp, severity, hostname, process, pid, message)
CASES = {
    "2031-07-09 21:14:07 [INFO] backup of volume 7 began": (
        "2031-07-09 21:14:07", "INFO", "", "", "", "backup of volume 7 began"),
    "2031-07-09 21:14:09 [ERROR] volume 7 refused block 88": (
        "2031-07-09 21:14:09", "ERROR", "", "", "", "volume 7 refused block 88"),
    "2031-07-09 21:15:30 [WARNING] 3 % of volume 7 left": (
        "2031-07-09 21:15:30", "WARNING", "", "", "", "3 % of volume 7 left"),
    "2031-07-09 21:15:31 [DEBUG] cache holds 41 blocks": (
        "2031-07-09 21:15:31", "DEBUG", "", "", "", "cache holds 41 blocks"),
    "2031-07-09 21:16:00 [CRITICAL] volume 7 gone": (
        "2031-07-09 21:16:00", "CRITICAL", "", "", "", "volume 7 gone"),
    "Jul  9 21:14:07 depot3 backupd[881]: volume 7 mounted": (
        "Jul  9 21:14:07", "INFO", "depot3", "backupd", "881", "volume 7 mounted"),
    "Aug 21 06:07:08 h kernel: a: b": ("Aug 21 06:07:08", "INFO", "h", "kernel", "", "a: b"),
    "Aug 21 06:07:08 h a:b:c d": ("Aug 21 06:07:08", "INFO", "h", "a", "", "b:c d"),
    "Aug 21 06:07:08 h p[x]: y": ("Aug 21 06:07:08", "INFO", "h", "p[x]", "", "y"),
    # The content decides over the level token.
    "2031-07-09 21:14:07 [INFO] left debug shell": ("2031-07-09 21:14:07", "DEBUG", "", "", "", "left debug shell"),
    "2031-07-09 21:14:07 CRIT x": ("2031-07-09 21:14:07", "CRITICAL", "", "", "", "x"),
    "2031-07-09 21:14:07 [Crit] x": ("2031-07-09 21:14:07", "INFO", "", "", "", "x"),
    "file transferred": (NOW, "ERROR", "", "", "", "file transferred"),
    # A first word that is no level is used up all the same.
    "2031-07-09 21:14:07 salut monde": ("2031-07-09 21:14:07", "INFO", "", "", "", "monde"),
    "2031-07-09 21:14:07 - text": (NOW, "INFO", "", "", "", "2031-07-09 21:14:07 - text"),
    "2031-07-09T21:14:07 INFO x": (NOW, "INFO", "", "", "", "2031-07-09T21:14:07 INFO x"),
    "2031-07-09 21:14:07.5 INFO x": (NOW, "INFO", "", "", "", "2031-07-09 21:14:07.5 INFO x"),
    "2031-07-09 21:14:07 [INFO] x\r": (NOW, "INFO", "", "", "", "2031-07-09 21:14:07 [INFO] x\r"),
    "": (NOW, "INFO", "", "", "", ""),
    "block 5 lost, ERROR 12": (NOW, "ERROR", "", "", "", "block 5 lost, ERROR 12"),
    "disk nearly full: WARNING": (NOW, "WARNING", "", "", "", "disk nearly full: WARNING"),
    "pump is CRITICAL now": (NOW, "CRITICAL", "", "", "", "pump is CRITICAL now"),
    "set DEBUG flag": (NOW, "DEBUG", "", "", "", "set DEBUG flag"),
    "emergency stop pressed": (NOW, "CRITICAL", "", "", "", "emergency stop pressed"),
    # Letters that only look like a word's letters in other case mappings do not count.
    "crıtıcal crİtİcal": (NOW, "INFO", "", "", "", "crıtıcal crİtİcal"),
    "two\nlines": (NOW, "INFO", "", "", "", "two\nlines"),
    "\n2031-07-09 21:14:07 INFO x": (NOW, "INFO", "", "", "", "\n2031-07-09 21:14:07 INFO x"),
}


def test_lines(lines):
    rows = parse(lines(*CASES), now=NOW).orderBy("line_number").collect()
    got = {line: (r.timestamp, r.severity, r.hostname, r.process, r.pid, r.message)
           for line, r in zip(CASES, rows)}
    assert got == CASES
    assert [r.line_number for r in rows] == list(range(1, len(CASES) + 1))
    assert all(sev.LEVELS[r.severity_rank] == r.severity for r in rows)


def test_strip_cr(lines):
    row = parse(lines("2031-07-09 21:14:07 [INFO] x\r"), now=NOW, strip_cr=True).first()
    assert (row.timestamp, row.message) == ("2031-07-09 21:14:07", "x")


def test_word_boundary(lines):
    rows = parse(lines("file transferred", "an error."), now=NOW, word_boundary=True).collect()
    assert sorted((r.line_number, r.severity) for r in rows) == [(1, "INFO"), (2, "ERROR")]


def test_long_line(lines):
    text = "lorem " * 7_000 + "end"
    assert parse(lines(text), now=NOW).first().message == text


@pytest.mark.parametrize("stamp,year,expected", [
    ("2031-07-09 21:14:07", None, "2031-07-09 21:14:07"),
    ("2031-07-09   21:14:07", None, "2031-07-09 21:14:07"),
    ("2031-13-09 21:14:07", None, None),
    ("Feb  9 01:02:03", 2024, "2024-02-09 01:02:03"),
    ("Dec 31 23:59:59", 2024, "2024-12-31 23:59:59"),
    ("Foo 31 23:59:59", 2024, None),
    ("Feb 30 21:14:07", 2024, None),
    ("Feb  9 01:02:03", None, None),
])
def test_event_time(lines, stamp, year, expected):
    rest = " [INFO] x" if stamp[0].isdigit() else " h p: x"
    row = parse(lines(stamp + rest), now=NOW, year=year).first()
    assert (None if row.event_time is None else str(row.event_time)) == expected


def test_event_ms(lines):
    rows = with_event_ms(lines("1970-01-01 00:00:01 INFO x", "plain"), now="1970-01-01 00:01:00")
    assert [r.event_ms for r in rows.orderBy("line_number").collect()] == [1000, 60_000]


@pytest.mark.parametrize("token,level", [
    ("DEBUG", "DEBUG"), ("info", "INFO"), ("warn", "WARNING"), ("WARNING", "WARNING"),
    ("ERR", "ERROR"), ("error", "ERROR"), ("CRIT", "CRITICAL"), ("fatal", "CRITICAL"),
    ("INVALID", None), ("Error", None), ("", None)])
def test_severity_names(spark, token, level):
    assert spark.range(1).select(sev.from_string(F.lit(token))).first()[0] == level
    if level is None:
        with pytest.raises(ValueError):
            sev.rank_of(token)
    else:
        assert sev.LEVELS[sev.rank_of(token)] == level
