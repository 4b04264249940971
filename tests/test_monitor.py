import json
import time

import pytest
from pyspark.sql import functions as F

from loglens.operators import stats
from loglens.operators.filters import FilterSpec, Pattern
from loglens.operators.ratelimit import RateLimit
from loglens.plans import collector
from loglens.plans.collector import TOTALS, CollectorConfig
from loglens.streaming import monitor, streams

NOW = "2030-01-01 00:00:00"
CONFIG = CollectorConfig(now=NOW, filter=FilterSpec(include=(Pattern("keep"),), min_severity="INFO"), tags={"a": "b"})
LIMITED = CollectorConfig(
    now=NOW, filter=CONFIG.filter, rate=RateLimit(max_lines=1, window_ms=1000, burst=3), rate_key=("source",))


def stamped(spark, rows):
    return spark.createDataFrame(rows, "source string, line_number bigint, value string, event_ms bigint")


def some(n, begin=0):
    words = ["keep ERROR", "drop WARN", "keep DEBUG", "keep", ""]
    return [(f"s{i % 3}", i, f"{words[i % 5]} {i}", i * 150) for i in range(begin, begin + n)]


def expected(spark, rows, config):
    """Totals by separate aggregates over what each step gives."""
    lines = stamped(spark, rows)
    kept = collector._limited(lines, config).count()
    out = [r.output for r in collector.collect(lines, config).collect()]
    return {"total_lines": len(rows), "bytes_processed": sum(len(r[2].encode()) for r in rows),
            "dropped_lines": len(rows) - kept, "filtered_lines": len(out), "bytes_written": sum(len(x.encode()) + 1 for x in out)}


@pytest.mark.parametrize("config", [CONFIG, LIMITED])
def test_counters_of_a_batch(spark, tmp_path, config):
    rows = some(200)
    wanted = expected(spark, rows, config)
    entries, counted = collector.collect_counted(stamped(spark, rows).repartition(4), config)
    entries.write.parquet(str(tmp_path / "out"))
    assert counted.totals() == wanted and wanted["filtered_lines"] > 0
    assert collector.counters(stamped(spark, rows), config).first().asDict() == wanted
    empty = stamped(spark, rows).limit(0)
    assert set(collector.counters(empty, config).first()) == {0}


def test_counters_read_the_input_once(spark, tmp_path):
    """Every read of the table shows in the plan of the one job that writes."""
    stamped(spark, some(50)).write.parquet(str(tmp_path / "in"))
    entries, _ = collector.collect_counted(spark.read.parquet(str(tmp_path / "in")), CONFIG)
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("CollectMetrics") == 2


@pytest.mark.parametrize("config", [CONFIG, LIMITED])
def test_counters_of_micro_batches(spark, tmp_path, config):
    incoming, counters = tmp_path / "in", str(tmp_path / "counters")
    parts = [some(40), some(7, 40), some(60, 47)]
    whole = expected(spark, sum(parts, []), config)
    sink = monitor.counted_sink(config, streams.parquet_sink(str(tmp_path / "out")), str(tmp_path / "state"), counters)
    for part in parts:
        stamped(spark, part).coalesce(1).write.mode("append").parquet(str(incoming))
        stream = spark.readStream.schema(stamped(spark, []).schema).parquet(str(incoming))
        streams.run(stream, str(tmp_path / "cp"), [sink]).awaitTermination()
    rows = monitor.counter_totals(spark, counters).orderBy("batch").collect()
    assert [r.total_lines for r in rows] == [40, 7, 60]
    assert {n: rows[-1][f"all_{n}"] for n in TOTALS} == whole
    assert {n: sum(r[n] for r in rows) for n in TOTALS} == whole
    # a repeated batch replaces its row
    if config is CONFIG:
        sink(stamped(spark, parts[2]), 2)
        assert monitor.counter_totals(spark, counters).where("batch = 2").first().all_total_lines == 107


def test_listener_counts_running_queries(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    texts = [f"keep ERROR {i}" if i % 3 else f"drop {i}" for i in range(30)]
    for i in range(3):
        (folder / f"f{i}.log").write_text("\n".join(texts[i::3]) + "\n")
    heard = []
    listener = monitor.CounterListener(lambda query, batch, totals: heard.append((query, batch, totals)))
    spark.streams.addListener(listener)
    try:
        rows = monitor.observed(streams.landing(spark, str(folder), max_files_per_trigger=1), CONFIG)
        streams.run(rows, str(tmp_path / "cp"), [streams.parquet_sink(str(tmp_path / "out"))], name="counted").awaitTermination()
        deadline = time.time() + 30
        while len(heard) < 3 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    totals = listener.totals("counted")
    assert [h[:2] for h in heard] == [("counted", 0), ("counted", 1), ("counted", 2)]
    written = spark.read.parquet(str(tmp_path / "out")).agg(F.count("*").alias("n"), F.sum(F.octet_length("output") + 1).alias("b")).first()
    assert totals == {"total_lines": 30, "bytes_processed": sum(map(len, texts)), "dropped_lines": 0,
                      "filtered_lines": written.n, "bytes_written": written.b}
    assert listener.totals("other") == dict.fromkeys(TOTALS, 0)


def heard(problems, kind, seconds=30):
    deadline = time.time() + seconds
    while time.time() < deadline:
        found = [p for p in problems.problems() if p.kind == kind]
        if found:
            return found
        time.sleep(0.2)
    return []


def test_failing_sink_is_told_and_kept_in_a_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("x\n")

    def broken(batch, batch_id):
        raise RuntimeError("disk full")

    problems = monitor.ProblemLog()
    listener = monitor.ErrorListener(problems, ended=True)
    spark.streams.addListener(listener)
    try:
        query = streams.run(streams.landing(spark, str(tmp_path / "in")), str(tmp_path / "cp"), [broken], name="broken")
        with pytest.raises(Exception):
            query.awaitTermination()
        failed = heard(problems, "failed")
        fine = streams.run(streams.landing(spark, str(tmp_path / "in")), str(tmp_path / "cp2"),
                           [streams.parquet_sink(str(tmp_path / "out"))], name="fine")
        fine.awaitTermination()
        ended = heard(problems, "ended")
    finally:
        spark.streams.removeListener(listener)
    assert [p.query for p in failed] == ["broken"] and "disk full" in failed[0].message
    assert [p.query for p in ended] == ["fine"]
    problems.write(spark, str(tmp_path / "problems"))
    assert problems.problems() == []
    assert {r.kind for r in monitor.newest(spark, str(tmp_path / "problems")).collect()} == {"failed", "ended"}


def test_vanished_path_is_told_once_each_time(spark, tmp_path):
    log = tmp_path / "a.log"
    log.write_text("one\n")
    problems = monitor.ProblemLog()
    listener = monitor.ErrorListener(problems, [str(log)], every=0.0)
    spark.streams.addListener(listener)
    query = streams.run(streams.follow(spark, [str(log)], start="earliest"), str(tmp_path / "cp"),
                        [streams.parquet_sink(str(tmp_path / "out"))], once=False, every="200 milliseconds", name="following")
    try:
        deadline = time.time() + 60
        while not query.lastProgress and time.time() < deadline:
            time.sleep(0.2)
        assert problems.problems() == []
        log.rename(tmp_path / "away")
        listener._look(query.id)
        listener._look(query.id)
        gone = heard(problems, "missing")
        (tmp_path / "away").rename(log)
        listener._look(query.id)
        log.rename(tmp_path / "away")
        listener._look(query.id)
    finally:
        query.stop()
        spark.streams.removeListener(listener)
    assert [(p.source, p.query) for p in gone] == [(str(log), "following")]
    assert len([p for p in problems.problems() if p.kind == "missing"]) == 2


def test_hook_errors_are_told_and_disturb_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("x\n")
    told = []

    def failing(batch, batch_id):
        raise ValueError("no")

    def bad_hook(problem):
        raise RuntimeError("hook of hooks")

    streams.run(streams.landing(spark, str(tmp_path / "in")), str(tmp_path / "cp"),
                [streams.parquet_sink(str(tmp_path / "out")), failing], on_hook_error=told.append).awaitTermination()
    assert told == ["batch 0: ValueError('no')"]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    monitor.told(bad_hook, "hook")


@pytest.mark.parametrize("config", [CONFIG, LIMITED])
def test_interval_totals(spark, config):
    rows = some(300)
    got = collector.interval_stats(stamped(spark, rows).repartition(3), config, 1000).orderBy("interval_start").collect()
    whole = expected(spark, rows, config)
    assert {n: got[-1][n] for n in TOTALS} == whole
    upto = [r for r in rows if r[3] < 5000]
    fifth = next(r for r in got if r.interval_start.timestamp() == 4)
    assert {n: fifth[n] for n in TOTALS} == expected(spark, upto, config)
    assert sum(r.lines for r in got) == len(rows)


def test_interval_plan_has_no_single_partition(spark, conf):
    conf(spark__sql__adaptive__enabled="false")
    plan = collector.interval_stats(stamped(spark, some(30)), CONFIG, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_running_sums_against_a_plain_sum(spark):
    numbers = [-(1 << 39), -5000, -3, -1, 0, 1, 2, 1023, 1024, 1025, 99_999, 1 << 39]
    rows = spark.createDataFrame([(i, i % 7 + 1, 1) for i in numbers], "at bigint, a bigint, b int").repartition(4)
    for group in (1, 4, 1024):
        got = stats.running_sums(rows, F.col("at"), ("a", "b"), group).orderBy("at").collect()
        assert [r.before_b for r in got] == list(range(len(numbers)))
        assert [r.before_a for r in got] == [sum(x % 7 + 1 for x in numbers[:i]) for i in range(len(numbers))]


@pytest.mark.parametrize("config", [CONFIG, LIMITED])
def test_statistics_in_parts_make_one_object(spark, config):
    rows = stamped(spark, [*some(60), ('o"d}', 1, "keep WARN", 5), (None, 2, "keep", 5)]).repartition(3)
    whole = collector.stats_json(rows, config, start_time="a", last_update="b").first().json
    parts = collector.stats_json_parts(rows, config, start_time="a", last_update="b", per_part=2).orderBy("part").collect()
    assert json.loads("".join(r.json for r in parts)) == json.loads(whole) and len(parts) == 4
    empty = collector.stats_json_parts(rows.limit(0), config, start_time="a", last_update="b").orderBy("part").collect()
    assert json.loads("".join(r.json for r in empty))["source_counts"] == {}
