import gzip
import json

import pytest
from pyspark.sql import functions as F

from loglens.functions import formats
from loglens.functions.parse import parse
from loglens.functions.tags import add_global_tags, override_hostname, parse_tag_items, parse_tags
from loglens.operators import stats
from loglens.operators.filters import FilterSpec, Pattern
from loglens.operators.ratelimit import RateLimit
from loglens.plans import collector
from loglens.plans.collector import CollectorConfig
from loglens.sources import sinks

NOW = "2030-01-01 00:00:00"


@pytest.fixture
def entry(lines):
    def make(text):
        return parse(lines(text), now=NOW)
    return make


def test_formats(entry):
    row = entry("Dec  4 10:30:45 web app[9]: disk ERROR").select(
        formats.to_plain(), formats.to_csv(), formats.to_syslog(), formats.to_syslog(True),
        formats.to_export_plain(), formats.to_csv(formats.EXPORT_CSV_COLUMNS)).first()
    assert list(row) == [
        "Dec  4 10:30:45 [ERROR] web app: disk ERROR",
        '"Dec  4 10:30:45","ERROR","a.log","web","app","disk ERROR"',
        "<131>1 Dec  4 10:30:45 web app - - - disk ERROR",
        "<131>1 Dec  4 10:30:45 web app - - - disk ERROR",
        "Dec  4 10:30:45 [ERROR] disk ERROR",
        '"Dec  4 10:30:45","ERROR","a.log","web","app",1,"disk ERROR"']
    bare = entry("2025-01-01 00:00:00 DEBUG x").select(
        formats.to_plain(), formats.to_syslog(), formats.to_syslog(True)).first()
    assert list(bare) == ["2025-01-01 00:00:00 [DEBUG] x", "<128>1 2025-01-01 00:00:00 - - - - - x",
                          "<135>1 2025-01-01 00:00:00 - - - - - x"]
    with pytest.raises(ValueError):
        formats.formatted("xml")


def test_json_escapes_and_field_order(entry):
    message = 'say "hi" \\ back\tslash'
    rows = add_global_tags(entry(message), {"b": "2", "a": "1"})
    text = rows.select(formats.to_json()).first()[0]
    parsed = json.loads(text)
    assert list(parsed) == ["timestamp", "severity", "source", "hostname", "process", "line_number",
                            "message", "tags"]
    assert parsed["message"] == message and list(parsed["tags"]) == ["a", "b"]
    assert "tags" not in json.loads(entry("x").select(formats.to_json()).first()[0])


def test_csv_doubles_quotes(entry):
    assert entry('a "b"').select(formats.to_csv()).first()[0].endswith('"a ""b"""')


def test_tags(spark, entry):
    assert parse_tag_items(["a=b=c", "x", "k=1", "k=2"]) == {"a": "b=c", "k": "2"}
    column = F.array(*[F.lit(x) for x in ("a=b=c", "x", "k=1", "k=2")])
    assert spark.range(1).select(parse_tags(column)).first()[0] == {"a": "b=c", "k": "2"}
    own = entry("x").withColumn("tags", F.create_map(F.lit("a"), F.lit("own"), F.lit("b"), F.lit("own")))
    assert add_global_tags(own, {"a": "given"}).first().tags == {"a": "given", "b": "own"}


def test_hostname(entry):
    rows = entry("Dec  4 10:30:45 web app[9]: x")
    assert override_hostname(rows, None).first().hostname == "web"
    row = override_hostname(rows, "me").first()
    assert (row.hostname, row.parsed_hostname) == ("me", "web")


def test_empty_input(spark, lines):
    none = lines("x").filter("false")
    assert list(stats.line_stats(none).first()) == [0, 0, 0, 0, 0]
    config = CollectorConfig(now=NOW, rate=RateLimit(1))
    none = none.withColumn("event_ms", F.lit(0).cast("bigint"))
    assert list(collector.counters(none, config).first()) == [0, 0, 0, 0, 0]
    report = json.loads(collector.stats_json(none, config, start_time=NOW, last_update=NOW).first().json)
    assert report["total_lines"] == 0 and report["severity_counts"] == {}
    assert stats.hourly_histogram(parse(none, now=NOW)).filter("lines > 0 or bar <> ''").count() == 0


def test_whole_configuration(lines):
    config = CollectorConfig(
        now=NOW, filter=FilterSpec(include=(Pattern("pump|valve"),), exclude=("planned",)),
        tags={"env": "t"}, hostname="h", output_format="syslog")
    raw = lines("ERROR pump a", "ERROR pump planned b", "INFO c")
    rows = collector.collect(raw, config).collect()
    assert [(r.output, r.tags) for r in rows] == [(f"<131>1 {NOW} h - - - - ERROR pump a", {"env": "t"})]
    counted = collector.counters(raw, config).first()
    assert list(counted) == [3, 38, 0, 1, len(rows[0].output) + 1]


def test_gzip_appends(spark, entry, tmp_path):
    path = str(tmp_path / "out")
    for text in ("x ERROR", "y ERROR"):
        sinks.write_text(entry(text).coalesce(1), path, compression="gzip")
    files = (tmp_path / "out").glob("part-*.txt.gz")
    assert sorted(gzip.open(f, "rt").read() for f in files) == [f"{NOW} [ERROR] {c} ERROR\n" for c in "xy"]
    assert spark.read.text(path).count() == 2


def test_zstd_is_real_or_an_error(entry, tmp_path):
    path = tmp_path / "out"
    try:
        sinks.write_text(entry("x ERROR").coalesce(1), str(path), compression="zstd")
    except Exception:
        assert not list(path.glob("part-*"))
    else:
        assert [f.read_bytes()[:4] for f in path.glob("part-*")] == [b"\x28\xb5\x2f\xfd"]


def test_bounded_files_and_bad_compression(lines, tmp_path):
    rows = parse(lines(*[str(i) for i in range(10)]).coalesce(1), now=NOW)
    sinks.write_text(rows, str(tmp_path / "out"), max_records_per_file=4)
    sizes = [len(f.read_text().splitlines()) for f in (tmp_path / "out").glob("part-*")]
    assert sorted(sizes) == [2, 4, 4]
    with pytest.raises(ValueError):
        sinks.write_text(rows, str(tmp_path / "out"), compression="rar")


def test_size_buckets_stay_bounded(lines):
    rows = sinks.size_buckets(lines(*["x" * (i % 7) for i in range(100)]), 50).collect()
    sizes = {}
    for r in rows:
        sizes[r.file_no] = sizes.get(r.file_no, 0) + len(r.value) + 1
    assert sum(sizes.values()) == sum(i % 7 + 1 for i in range(100))
    assert max(sizes.values()) < 50 + 7 and sorted(sizes) == list(range(len(sizes)))


def test_retention(spark, lines, tmp_path):
    path = str(tmp_path / "table")
    sinks.write_table(parse(lines(*[f"2025-01-0{d} 00:00:00 INFO x" for d in (1, 2, 3, 4)]), now=NOW), path)
    plan = sinks.retention_plan(spark.read.parquet(path), 2)
    assert {str(r.date): r.keep for r in plan.collect()} == {
        "2025-01-01": False, "2025-01-02": False, "2025-01-03": True, "2025-01-04": True}
    kept, dropped = sinks.apply_retention(spark, path, 2)
    assert kept == ["2025-01-04", "2025-01-03"] and dropped == ["2025-01-02", "2025-01-01"]
    assert spark.read.parquet(path).count() == 2


def test_csv_header_in_every_file(spark, entry, tmp_path):
    from loglens.functions.formats import csv_header
    texts = ['say "ERROR", then \\ stop ', " , ", 'tab\t"']
    rows = entry(texts[0]).unionByName(entry(texts[1])).unionByName(entry(texts[2])).coalesce(1)
    sinks.write_text(rows, str(tmp_path / "out"), output_format="csv", header=csv_header(), max_records_per_file=2)
    sinks.write_text(rows, str(tmp_path / "bare"), output_format="csv")
    files = [f.read_text().split("\n") for f in sorted((tmp_path / "out").glob("part-*"))]
    assert len(files) == 2 and {f[0] for f in files} == {"timestamp,severity,source,hostname,process,message"}
    bare = [f.read_text() for f in (tmp_path / "bare").glob("part-*")]
    assert "".join("\n".join(f[1:]) for f in files) == "".join(bare)
    back = spark.read.csv(str(tmp_path / "out"), header=True, escape='"', ignoreTrailingWhiteSpace=False,
                          ignoreLeadingWhiteSpace=False)
    assert sorted(r.message for r in back.collect()) == sorted(texts)


def test_days_have_few_files_and_a_hot_day_many_writers(spark, lines, tmp_path):
    path = tmp_path / "table"
    texts = [f"2025-01-01 00:00:{i % 60:02d} INFO hot {i}" for i in range(400)] + [
        f"2025-01-0{d} 00:00:00 INFO x{d}" for d in (2, 3, 4) for _ in range(5)] + ["Jan  1 00:00:00 h app: no year"] * 3
    rows = parse(lines(*texts).repartition(16), now=NOW)
    sinks.write_table(rows, str(path), rows_per_file=50)
    files = {f.name.split("=")[1]: len(list(f.glob("part-*.parquet"))) for f in path.glob("date=*")}
    assert set(files) == {"2025-01-01", "2025-01-02", "2025-01-03", "2025-01-04", sinks.UNDATED}
    assert 2 <= files.pop("2025-01-01") <= 8 and set(files.values()) == {1}
    back = spark.read.parquet(str(path))
    assert back.count() == len(texts)
    assert back.where(F.col("date") == sinks.UNDATED).count() == 3
    # what has no time is no day, so retention leaves it
    kept, dropped = sinks.apply_retention(spark, str(path), 1)
    assert kept == ["2025-01-04"] and len(dropped) == 3 and (path / f"date={sinks.UNDATED}").exists()
    sinks.write_table(rows.limit(0), str(tmp_path / "none"))
