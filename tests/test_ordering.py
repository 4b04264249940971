import random
from pathlib import Path

import pytest
from pyspark.sql import Window, functions as F

from loglens.operators import ordering, search
from loglens.sources import lines as source, shared

NOW = "2030-01-01 00:00:00"


def numbered(df):
    return sorted((r.source.rsplit("/", 1)[-1], r.line_number, r.value) for r in df.collect())


def write(folder: Path, **texts):
    expected = []
    for name, values in texts.items():
        (folder / f"{name}.log").write_text("".join(v + "\n" for v in values))
        expected += [(f"{name}.log", i, v) for i, v in enumerate(values, 1)]
    return sorted(expected)


@pytest.mark.parametrize("split", ["200b", "3000b", "128MB"])
@pytest.mark.parametrize("broadcast", [True, False])
def test_line_numbers_over_splits(spark, conf, tmp_path, monkeypatch, split, broadcast):
    rnd = random.Random(5)
    texts = {n: ["w" * rnd.randint(0, 60) + str(i) for i in range(k)]
             for n, k in (("big", 900), ("small", 7), ("one", 1))}
    texts["blank"] = ["", "", "x", ""]
    expected = write(tmp_path, **texts)
    conf(spark__sql__files__maxPartitionBytes=split, spark__sql__files__openCostInBytes="100b")
    if not broadcast:
        monkeypatch.setattr(source, "MAX_BROADCAST_SPLITS", 0)
        conf(spark__sql__autoBroadcastJoinThreshold="-1")
    lines = source.read_lines(spark, [str(tmp_path), str(tmp_path)])
    assert numbered(lines) == expected
    # Filters above the numbering do not disturb it.
    assert numbered(lines.filter(F.col("value").endswith("7"))) == [
        row for row in expected if row[2].endswith("7")]


def test_special_names_and_endings(spark, tmp_path):
    path = tmp_path / "a b+c%41.log"
    path.write_bytes(b"one\r\ntwo\nlast without newline")
    rows = source.read_lines(spark, [str(path)]).orderBy("line_number").collect()
    assert [r.value for r in rows] == ["one\r", "two", "last without newline"]
    assert {r.source for r in rows} == {str(path)}


def test_missing_inputs_are_reported(spark, tmp_path):
    write(tmp_path, a=["x"])
    lines, missing = source.read_existing(spark, [f"{tmp_path}/a.log", f"{tmp_path}/no.log"])
    assert lines.count() == 1 and missing == [f"{tmp_path}/no.log"]
    lines, missing = source.read_existing(spark, [f"{tmp_path}/no.log"])
    assert lines.count() == 0 and missing == [f"{tmp_path}/no.log"]


def test_no_file_is_read_twice(spark, tmp_path):
    expected = write(tmp_path, a=["x", "y"], b=["z"])
    overlapping = [f"{tmp_path}/a.log", f"{tmp_path}/*.log", str(tmp_path), f"{tmp_path}/b.log"]
    for paths in (overlapping, overlapping[:2]):
        assert numbered(source.read_lines(spark, paths)) == expected
    whole = source.read_in_order(spark, [str(tmp_path)])
    assert sorted((r.source_pos, r.value) for r in whole.collect()) == [(0, "x"), (0, "y"), (1, "z")]


def test_intermediate_tables_can_be_dropped(spark):
    kept = shared.materialize(spark.range(3), "numbers")
    folder = Path(kept.inputFiles()[0].removeprefix("file://")).parent
    assert kept.count() == 3 and folder.exists()
    shared.drop_tables(spark)
    assert not folder.exists()


def test_merge_follows_argument_order(spark, tmp_path):
    write(tmp_path, b=["2025-01-02 00:00:00 INFO b1", "plain b2"],
          a=["2025-01-01 00:00:00 INFO a1", "2025-01-02 00:00:00 INFO a2"])
    lines = source.read_in_order(spark, [f"{tmp_path}/b.log", f"{tmp_path}/a.log"])
    sorted_ = ordering.merge(lines, now=NOW, numbered=True).orderBy("seq").collect()
    assert [r.value[-2:] for r in sorted_] == ["a1", "b1", "a2", "b2"]
    assert [r.seq for r in sorted_] == [1, 2, 3, 4]
    as_given = ordering.merge(lines, now=NOW, sort=False, numbered=True).orderBy("seq").collect()
    assert [r.value[-2:] for r in as_given] == ["b1", "b2", "a1", "a2"]
    assert [r.value[-2:] for r in ordering.merge(lines, now=NOW).collect()] == ["a1", "b1", "a2", "b2"]


def test_merge_sorts_stamps_as_text(lines):
    rows = lines("Feb  1 00:00:00 h p: f", "Jan  1 00:00:00 h p: j", "Apr  1 00:00:00 h p: a").withColumn(
        "source_pos", F.lit(0))
    text = ordering.merge(rows, now=NOW).collect()
    assert [r.value[-1] for r in text] == ["a", "f", "j"]
    time = ordering.merge(rows, now=NOW, by="event_time", year=2025).collect()
    assert [r.value[-1] for r in time] == ["j", "f", "a"]


@pytest.mark.parametrize("n,expected", [(0, []), (2, ["e2", "e3"]), (9, ["e1", "e2", "e3"])])
def test_tail(lines, n, expected):
    rows = ordering.tail_n(lines("e1", "x", "e2", "x", "e3", "x"), n, pattern="E").orderBy("tail_pos")
    assert [(r.tail_pos, r.value) for r in rows.collect()] == list(enumerate(expected, 1))


def test_tail_beyond_group_limit(spark, conf, lines):
    conf(spark__sql__optimizer__windowGroupLimitThreshold="3")
    rows = ordering.tail_n(lines(*[f"e{i}" for i in range(50)]), 7).orderBy("tail_pos").collect()
    assert [r.value for r in rows] == [f"e{i}" for i in range(43, 50)]


def test_first(lines):
    rows = lines(*[str(i) for i in range(20)])
    assert [r.value for r in ordering.first_n(rows, 3).collect()] == ["0", "1", "2"]
    assert ordering.first_n(rows, 0).count() == 20


@pytest.mark.parametrize("block", [1, 3, 65_536])
def test_running_total(lines, monkeypatch, block):
    monkeypatch.setattr(ordering, "BLOCK_LINES", block)
    rows = lines(a=[str(i) for i in range(10)], b=["5", "6"])
    got = ordering.running_total(rows, F.col("value").cast("bigint"), "before").collect()
    assert sorted((r.source, r.line_number, r.before) for r in got) == sorted(
        [("a.log", i + 1, sum(range(i))) for i in range(10)] + [("b.log", 1, 0), ("b.log", 2, 5)])


@pytest.mark.parametrize("context", [0, 1, 3])
def test_context_against_window(lines, context):
    rnd = random.Random(context)
    rows = lines(a=[rnd.choice(["hit", "no", "no", "no"]) for _ in range(60)], b=["no", "hit"])
    got = search.search_context(rows, "hit", context=context)
    around = Window.partitionBy("source").orderBy("line_number").rowsBetween(-context, context)
    wanted = rows.withColumn("is_match", F.col("value") == "hit").withColumn(
        "near", F.max("is_match").over(around)).filter("near").drop("near")
    assert sorted(got.collect()) == sorted(wanted.collect())


def test_context_counts_only_first_matches(lines):
    got = search.search_context(lines("hit1", "a", "hit2", "hit3", "b"), "hit", context=1, max_count=2)
    assert sorted((r.line_number, r.is_match) for r in got.collect()) == [
        (1, True), (2, False), (3, True), (4, False)]
    csv = search.search_csv(search.search_context(lines('say "x"'), "x")).first().csv
    assert csv == '1,"say ""x""",1'


@pytest.mark.parametrize("context", [2, 200])
def test_dense_context_makes_no_row_per_shown_line(spark, lines, context):
    rows = lines(**{"s": [f"hit {i}" if i % 3 else f"no {i}" for i in range(3000)], "t": ["no"] * 500 + ["hit"] + ["no"] * 500})
    hits = rows.filter(F.col("value").startswith("hit")).select("source", "line_number")
    ranges = search.context_ranges(hits, context)
    assert ranges.count() <= 3000 / search._block_lines(context) + 8
    assert ranges.agg(F.max(F.size("_ranges"))).first()[0] <= 2 * search._block_lines(context) // (2 * context + 1) + 4
    got = search.search_context(rows, "^hit", context=context)
    assert got.filter("source = 't.log'").count() == 2 * context + 1
    assert got.filter("source = 's.log'").count() == 3000
    assert got.filter("is_match").count() == 2001


def test_context_without_matches_and_with_null_lines(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, "hit"), ("a", 3, None)], "source string, line_number bigint, value string")
    assert search.search_context(rows, "none", context=3).count() == 0
    assert search.search_context(rows, "none", context=3, max_count=2).count() == 0
    assert [(r.line_number, r.is_match) for r in search.search_context(rows, "hit", context=1).orderBy("line_number").collect()] == [
        (1, False), (2, True), (3, False)]


def test_first_n_beyond_one_task(spark, monkeypatch):
    monkeypatch.setattr(ordering, "MAX_FIRST", 10)
    rows = spark.range(0, 2000, 1, 7).select(
        (F.col("id") % 3).cast("string").alias("source"), (F.col("id") * 7 % 2003).alias("line_number"), F.col("id").alias("value"))
    every = sorted((r.source, r.line_number) for r in rows.collect())
    for n in (11, 700, 1999, 2000, 5000):
        got = ordering.first_n(rows, n)
        assert sorted((r.source, r.line_number) for r in got.collect()) == every[:n]
        assert got.columns == rows.columns
        assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert ordering.first_n(rows.limit(0), 100).count() == 0


def test_listing_asks_the_jvm_as_often_for_many_files_as_for_few(spark, tmp_path, monkeypatch):
    client = spark.sparkContext._gateway._gateway_client
    calls, send = [0], client.send_command

    def counted(*args, **kwargs):
        calls[0] += 1
        return send(*args, **kwargs)

    monkeypatch.setattr(client, "send_command", counted)
    asked = []
    for n in (2, 25):
        folders = [tmp_path / f"{part}{n}" for part in "ab"]
        for folder in folders:
            folder.mkdir()
            for i in range(n):
                (folder / f"{i:02d}.log").write_text("x\n")
        calls[0] = 0
        source.read_lines(spark, [str(f) for f in folders])
        assert source.expand(spark, str(folders[0])) == [str(folders[0] / f"{i:02d}.log") for i in range(n)]
        asked.append(calls[0])
    assert asked[1] <= asked[0] + 20


def test_a_file_listed_twice_is_read_once(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.log").write_text("x\ny\n")
    paths = [str(tmp_path), str(tmp_path / "a.log"), str(tmp_path / "*.log")]
    assert sorted(r.source for r in source.read_lines(spark, paths).collect()) == sorted(2 * [str(tmp_path / "a.log"), str(tmp_path / "b.log")])
