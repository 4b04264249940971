import json
import time

import pytest
from pyspark.sql import functions as F

from loglens.plans import collector
from loglens.plans.collector import CollectorConfig
from loglens.operators.filters import FilterSpec, Pattern
from loglens.sources.tail import TailReader
from loglens.streaming import streams

NOW = "2030-01-01 00:00:00"


def read(reader, start):
    end = reader.latestOffset()
    batches = [b for part in reader.partitions(start, end) for b in reader.read(part)]
    return end, [value for b in batches for value in b.column(2).to_pylist()]


def reader(path, **options):
    return TailReader({"directory": str(path), **options})


@pytest.mark.parametrize("chunk", ["1", "3", "7", "1000"])
def test_chunks_split_on_lines(tmp_path, chunk):
    texts = ["", "a", "bb", "", "ccc" * 5, "é", "last"]
    (tmp_path / "x.log").write_text("\n".join(texts) + "\nhalf")
    assert read(reader(tmp_path, start="earliest", chunkBytes=chunk), {})[1] == texts


def test_latest_half_lines_new_files_and_truncation(tmp_path):
    old = tmp_path / "old.log"
    old.write_text("before\n")
    (tmp_path / "other.txt").write_text("not watched\n")
    source = reader(tmp_path)
    offset = source.initialOffset()
    assert read(source, offset)[1] == []
    with old.open("a") as f:
        f.write("one\ntw")
    offset, rows = read(source, offset)
    assert rows == ["one"]
    (tmp_path / "new.log").write_text("from the start\n")
    with old.open("a") as f:
        f.write("o\n")
    offset, rows = read(source, offset)
    assert sorted(rows) == ["from the start", "two"]
    old.write_text("again\n")
    offset, rows = read(source, offset)
    assert rows == ["again"]
    # A reader made after a restart goes on from the checkpoint's offset.
    with old.open("a") as f:
        f.write("while down\n")
    offset, rows = read(reader(tmp_path), offset)
    assert rows == ["while down"]
    assert read(reader(tmp_path), offset)[1] == []


@pytest.mark.parametrize("after", [
    "x\n", "longer than before, line one\nlonger than before, line two\n", "third line\nforth line\n"])
@pytest.mark.parametrize("restart", [False, True])
def test_replaced_file_is_read_from_its_beginning(tmp_path, after, restart):
    log = tmp_path / "a.log"
    log.write_text("first line\nother line\n")
    source = reader(tmp_path, start="earliest")
    offset, rows = read(source, source.initialOffset())
    assert rows == ["first line", "other line"]
    log.unlink()
    log.write_text(after)
    offset, rows = read(reader(tmp_path) if restart else source, offset)
    assert rows == after.splitlines()


@pytest.mark.parametrize("restart", [False, True])
def test_missed_file_goes_on_where_it_was(tmp_path, restart):
    log = tmp_path / "a.log"
    log.write_text("one\n")
    source = reader(tmp_path, start="earliest")
    offset, _ = read(source, source.initialOffset())
    if restart:
        source = reader(tmp_path)
    log.rename(tmp_path / "away")
    offset, rows = read(source, offset)
    assert rows == []
    (tmp_path / "away").rename(log)
    offset, rows = read(source, offset)
    assert rows == []
    with log.open("a") as f:
        f.write("two\n")
    assert read(source, offset)[1] == ["two"]


def test_file_replaced_after_the_plan_gives_only_new_lines(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("one\ntwo\n")
    source = reader(tmp_path, start="earliest")
    start, end = source.initialOffset(), source.latestOffset()
    parts = source.partitions(start, end)
    log.write_text("new one\nnew two\n")
    assert [b for part in parts for b in source.read(part)] == []
    assert read(source, end)[1] == ["new one", "new two"]


def test_bounded_batches(tmp_path):
    texts = {"a.log": [f"a{i}" for i in range(50)] + ["long" * 40], "b.log": [f"b{i}" for i in range(9)]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    source = reader(tmp_path, start="earliest", maxBytesPerTrigger="40")
    offset, sizes, rows = source.initialOffset(), [], []
    while True:
        end, more = read(source, offset)
        if end == offset:
            break
        offset = end
        sizes.append(sum(len(x) + 1 for x in more if len(x) < 40))
        rows += more
    assert sorted(rows) == sorted(texts["a.log"] + texts["b.log"]) and max(sizes) <= 40 and len(sizes) > 4


def test_last_line_and_bytes_that_are_no_text(tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\n\xff\xfe x\nend")
    source = reader(tmp_path, start="earliest", lastLine="true", chunkBytes="2")
    parts = source.partitions({}, source.latestOffset())
    batches = [b for part in parts for b in source.read(part)]
    values = [v.as_buffer().to_pybytes() for b in batches for v in b.column(2).cast("binary")]
    assert values == [b"one", b"\xff\xfe x", b"end"]
    assert [x for b in batches for x in b.column(1).to_pylist()] == [0, 4, 9]


def test_tail_then_follow(spark, tmp_path):
    log = tmp_path / "a.log"
    log.write_text("".join(f"ERROR {i}\n" for i in range(9)) + "INFO\nERROR ha")
    last, rest = streams.tail_then_follow(spark, [str(log)], 2, pattern="error")
    with log.open("a") as f:
        f.write("lf\nINFO\nERROR new\n")
    run_once(rest, tmp_path / "out", tmp_path / "cp")
    assert sorted(r.value for r in last.collect()) == ["ERROR 7", "ERROR 8"]
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.source, r.value) for r in found} == {(str(log), "ERROR half"), (str(log), "ERROR new")}


def test_paths_that_are_not_there(spark, tmp_path, caplog):
    with pytest.raises(FileNotFoundError):
        streams.watch(spark, str(tmp_path / "none"))
    streams.follow(spark, [str(tmp_path / "none.log")])
    assert "none.log" in caplog.text


def test_options(tmp_path):
    with pytest.raises(ValueError):
        TailReader({})
    with pytest.raises(ValueError):
        reader(tmp_path, start="middle")


def run_once(rows, out, checkpoint, *hooks):
    streams.run(rows, str(checkpoint), [streams.parquet_sink(str(out)), *hooks]).awaitTermination()


def test_follow_resumes_from_checkpoint(spark, tmp_path):
    log, out, checkpoint = tmp_path / "a.log", tmp_path / "out", tmp_path / "cp"
    log.write_text("ERROR 1\nnoise\n")

    def follow():
        run_once(streams.follow(spark, [str(log)], start="earliest", pattern="error"), out, checkpoint)
        return sorted(r.value for r in spark.read.parquet(str(out)).collect())

    assert follow() == ["ERROR 1"]
    with log.open("a") as f:
        f.write("error 2\nhalf err")
    assert follow() == ["ERROR 1", "error 2"]
    with log.open("a") as f:
        f.write("or\n")
    assert follow() == ["ERROR 1", "error 2", "half error"]


def test_watch_while_running(spark, tmp_path):
    folder, out = tmp_path / "logs", tmp_path / "out"
    folder.mkdir()
    (folder / "a.log").write_text("old ERROR\n")
    query = streams.run(
        streams.watch(spark, str(folder), min_severity="ERROR"), str(tmp_path / "cp"),
        [streams.parquet_sink(str(out))], once=False, every="200 milliseconds")
    try:
        deadline = time.time() + 60
        while not query.lastProgress and time.time() < deadline:
            time.sleep(0.2)
        (folder / "b.log").write_text("new ERROR\nINFO\n")
        with (folder / "a.log").open("a") as f:
            f.write("more ERROR\n")
        query.processAllAvailable()
        time.sleep(1)
        query.processAllAvailable()
    finally:
        query.stop()
    rows = spark.read.parquet(str(out)).collect()
    assert sorted((r.filename, r.value) for r in rows) == [
        ("a.log", "more ERROR"), ("b.log", "new ERROR")]


def test_landing_equals_batch_and_hooks(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    texts = [f"2025-01-01 00:00:{i:02d} {w} n{i}" for i, w in enumerate(["INFO", "ERROR", "WARN", "DEBUG"] * 5)]
    for i in range(4):
        (folder / f"f{i}.log").write_text("\n".join(texts[i::4]) + "\n")
    config = CollectorConfig(
        now=NOW, filter=FilterSpec(include=(Pattern("n[0-9]"),), min_severity="WARNING"), tags={"a": "b"})
    seen = []

    def failing(batch, batch_id):
        raise RuntimeError("hook")

    rows = collector.collect(streams.landing(spark, str(folder), max_files_per_trigger=1), config)
    run_once(rows, out, tmp_path / "cp", failing, lambda batch, i: seen.append(batch.count()))
    got = sorted(r.output for r in spark.read.parquet(str(out)).collect())
    lines = spark.read.text(str(folder)).withColumn("source", F.lit("s"))
    assert got == sorted(r.output for r in collector.collect(lines, config).collect())
    assert len(seen) == 4 and sum(seen) == len(got) == 10


def test_sink_errors_stop_the_query(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("x\n")

    def broken(batch, batch_id):
        raise RuntimeError("disk full")

    query = streams.run(streams.landing(spark, str(tmp_path / "in")), str(tmp_path / "cp"), [broken])
    with pytest.raises(Exception, match="disk full"):
        query.awaitTermination()


def test_stream_with_limit_is_refused(spark, tmp_path):
    from loglens.operators.ratelimit import RateLimit
    (tmp_path / "in").mkdir()
    with pytest.raises(ValueError):
        collector.collect(streams.landing(spark, str(tmp_path / "in")),
                          CollectorConfig(now=NOW, rate=RateLimit(1)))


def test_lines_of_a_stream_are_stamped_with_their_batch(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for i in range(2):
        (folder / f"f{i}.log").write_text(f"plain {i}\n")
        time.sleep(1.1 * i)
        run_once(collector.collect(streams.landing(spark, str(folder)), CollectorConfig(now=None)), out, tmp_path / "cp")
    rows = spark.read.parquet(str(out)).orderBy("message").collect()
    assert [r.message for r in rows] == ["plain 0", "plain 1"]
    assert NOW > rows[1].timestamp > rows[0].timestamp > "2024"
    assert all(str(r.ingest_time) == r.timestamp for r in rows)


def test_first_batch_after_an_outage_is_bounded(spark, tmp_path):
    log, out, checkpoint = tmp_path / "a.log", tmp_path / "out", str(tmp_path / "cp")
    log.write_text("one\ntwo\n")
    follow = lambda: streams.follow(spark, [str(log)], start="earliest", max_bytes=40, checkpoint=checkpoint)
    assert streams.last_offset(spark, checkpoint) is None
    run_once(follow(), out, checkpoint)
    offset = streams.last_offset(spark, checkpoint)
    assert [place["pos"] for place in json.loads(offset).values()] == [8]
    with log.open("a") as f:
        f.writelines(f"line {i:03d}\n" for i in range(100))
    paths = json.dumps([next(iter(json.loads(offset)))])
    unbounded = TailReader({"paths": paths, "maxBytesPerTrigger": "40"})
    bounded = TailReader({"paths": paths, "maxBytesPerTrigger": "40", "resume": offset})
    assert [p["pos"] for p in unbounded.latestOffset().values()] == [908]
    assert [p["pos"] for p in bounded.latestOffset().values()] == [44]
    query = streams.run(follow(), checkpoint, [streams.parquet_sink(str(out))], once=False, every="100 milliseconds")
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.read.parquet(str(out)).count() < 102:
            time.sleep(0.5)
    finally:
        query.stop()
    rows = spark.read.parquet(str(out)).groupBy("batch").count().collect()
    assert sum(r["count"] for r in rows) == 102 and max(r["count"] for r in rows) <= 5
