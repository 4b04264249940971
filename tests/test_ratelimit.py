import random

import pytest
from pyspark.sql import functions as F

from loglens.operators import ratelimit as rl
from loglens.operators.ratelimit import ByteLimit, RateLimit


def walk(arrivals, limit):
    """Lines kept by one plain bucket per key; arrivals are (key, ms, name) in arrival order."""
    cap, tokens, clock, kept = limit.burst * limit.window_ms, {}, {}, []
    for key, ms, name in arrivals:
        held, last = tokens.get(key, cap), clock.get(key, ms)
        held = min(cap, held + max(ms - last, 0) * limit.max_lines)
        clock[key] = max(ms, last)
        if held >= limit.window_ms:
            held -= limit.window_ms
            kept.append(name)
        tokens[key] = held
    return kept


def random_limit(rnd):
    return RateLimit(rnd.randint(1, 12), rnd.choice([1, 2, 3, 5, 7, 10, 12, 20, 60]),
                     rnd.choice([1, 1, 2, 3, 5, 10]))


def random_arrivals(rnd, keys, count):
    arrivals = []
    for key in keys:
        ms = rnd.randint(0, 50)
        for i in range(count):
            arrivals.append((key, ms, f"{key}{i}"))
            if rnd.random() < 0.7:
                ms += rnd.randint(1, 4) if rnd.random() < 0.95 else rnd.randint(1, 300)
    return arrivals


def shapes(counted, limit):
    """Per chunk: first and last time, what an empty and a full bucket come to, and the unclamped sum."""
    chunks = {}
    for key, chunk, ms, n in counted:
        chunks.setdefault((key, chunk), []).append((ms, n))
    for (key, chunk), moments in sorted(chunks.items()):
        low, high, shift, last = 0, limit.cap, 0, moments[0][0]
        for ms, n in moments:
            waited, added = (ms - last) * limit.gain, n * limit.cost
            low, high = (min(max(x - waited, 0) + added, limit.cap) for x in (low, high))
            shift, last = shift + added - waited, ms
        yield key, chunk, moments[0][0], last, low, high, shift


def in_chunks(pairs, limit, chunk):
    """The chunk steps put together in plain Python."""
    counted = sorted((k, ms // chunk, ms, n) for k, ms, n in pairs)
    starts = {(k, c): (ms, u) for k, c, ms, u in rl._chunk_starts(limit)(shapes(counted, limit))}
    begun = [(*row, *starts[row[:2]]) for row in counted]
    phases = {}
    if limit.cost > 1:
        changes = sorted(rl._phase_changes(limit)(iter(begun)))
        phases = {(k, c): p for k, c, p in rl._chunk_phases()(iter(changes))}
    rows = [(*row, phases.get(row[:2], 0)) for row in begun]
    return {(k, ms): taken for k, ms, taken, _ in rl._accepted(limit)(iter(rows)) if taken}


def test_chunks_equal_one_walk():
    rnd = random.Random(11)
    total = kept_total = 0
    for _ in range(1500):
        limit = random_limit(rnd)
        arrivals = random_arrivals(rnd, "ab", rnd.randint(1, 120))
        counts = {}
        for key, ms, _name in arrivals:
            counts[key, ms] = counts.get((key, ms), 0) + 1
        got = in_chunks([(k, ms, n) for (k, ms), n in counts.items()], limit, rnd.choice([3, 10, 40]))
        kept = set(walk(arrivals, limit))
        wanted = {}
        for key, ms, name in arrivals:
            if name in kept:
                wanted[key, ms] = wanted.get((key, ms), 0) + 1
        assert got == wanted, limit
        total, kept_total = total + len(arrivals), kept_total + len(kept)
    assert 0 < kept_total < total


def test_phase_pieces_equal_trying_every_phase():
    rnd = random.Random(2)
    for _ in range(3000):
        cost = rnd.randint(2, 40)
        moments = [(rnd.randrange(cost), rnd.randrange(cost)) for _ in range(rnd.randint(0, 30))]
        pieces = rl._phase_pieces(moments, cost)
        assert all(b < e for b, e, _ in pieces) and pieces == sorted(pieces)
        for entry in range(cost):
            phase = entry
            for clock, left in moments:
                if left - (left - phase + clock) % cost <= 0:
                    phase = clock
            hits = [after for b, e, after in pieces if b <= entry < e]
            assert hits == [phase] or (not hits and phase == entry)


def test_chunk_shapes_on_the_jvm(spark):
    rnd = random.Random(6)
    for _ in range(4):
        limit = random_limit(rnd)
        counts = {}
        for key, ms, _name in random_arrivals(rnd, "abc", 200):
            counts[key, ms // 20, ms] = counts.get((key, ms // 20, ms), 0) + 1
        counted = [(*k, n) for k, n in sorted(counts.items())]
        rows = spark.createDataFrame(counted, "_key string, _chunk bigint, _ms bigint, _n bigint").repartition(3)
        assert sorted(map(tuple, rl._chunk_shapes(rows, limit).collect())) == list(shapes(counted, limit))


def byte_walk(rows, limit):
    """Lines kept by one bucket of bytes per key, refused lines charging too; rows are (key, number, size, ms)."""
    cap, tokens, clock, kept = limit.burst * limit.window_ms, {}, {}, []
    for key, number, size, ms in rows:
        held = min(cap, tokens.get(key, cap) + (ms - clock.get(key, ms)) * limit.max_bytes)
        if held >= size * limit.window_ms:
            kept.append((key, number))
        tokens[key], clock[key] = max(held - size * limit.window_ms, 0), ms
    return kept


@pytest.mark.parametrize("limit", [ByteLimit(7, 10, 40), ByteLimit(100, 7, 300), ByteLimit(1, 3, 9), ByteLimit(5, 5, 0)])
def test_rate_limit_bytes(spark, monkeypatch, limit):
    monkeypatch.setattr(rl, "CHUNK_MS", 25)
    rnd = random.Random(8)
    arrivals = random_arrivals(rnd, "a", 500) + random_arrivals(rnd, "bc", 40)
    rows, numbers = [], {}
    for key, ms, _name in arrivals:
        numbers[key] = numbers.get(key, 0) + 1
        rows.append((key, numbers[key], "x" * rnd.choice([0, 1, 3, 9, 50]), ms))
    lines = spark.createDataFrame(rows, "source string, line_number bigint, value string, event_ms bigint").repartition(5)
    got = sorted((r.source, r.line_number) for r in rl.rate_limit_bytes(lines, limit).collect())
    sized = [(k, i, len(v), ms) for k, i, v, ms in rows]
    assert got == sorted(byte_walk(sized, limit))
    one = sorted(sized, key=lambda r: (r[3], r[0], r[1]))
    got = sorted((r.source, r.line_number) for r in rl.rate_limit_bytes(lines, limit, key=None).collect())
    kept = byte_walk([("all", n, r[2], r[3]) for n, r in enumerate(one)], limit)
    wanted = [(one[n][0], one[n][1]) for _, n in kept]
    assert got == sorted(wanted)


def test_byte_limit_edges(spark):
    lines = table(spark, [("a", 1, "xyz"), ("a", 1, "")]).unionByName(
        spark.createDataFrame([("a", 9, None, 1)], "source string, line_number bigint, value string, event_ms bigint"))
    assert rl.rate_limit_bytes(lines, ByteLimit(0)).count() == 3
    assert sorted(r.line_number for r in rl.rate_limit_bytes(lines, ByteLimit(1, 1, 2)).collect()) == [2, 9]
    assert rl.rate_limit_bytes(lines.limit(0), ByteLimit(1, 1, 2)).count() == 0
    with pytest.raises(ValueError):
        ByteLimit(1, 0)


def test_one_hot_key_of_bytes_is_replayed_in_parallel(spark, conf, monkeypatch):
    monkeypatch.setattr(rl, "CHUNK_MS", 50)
    conf(spark__sql__adaptive__enabled="false")
    lines = table(spark, random_arrivals(random.Random(9), "a", 5_000))
    tasks = rl._over_sorted(
        rl.arrivals(lines).withColumn("_chunk", F.floor(F.col("_ms") / 50)), ["_key", "_chunk"], ["_ms"], ["_key", "_chunk", "_ms", "_n"],
        lambda rows: ((key, chunk) for key, chunk, _, _ in rows), "_key string, _chunk bigint")
    assert tasks.select(F.spark_partition_id()).distinct().count() > 1


def table(spark, arrivals):
    rows, numbers = [], {}
    for key, ms, name in arrivals:
        numbers[key] = numbers.get(key, 0) + 1
        rows.append((key, numbers[key], name, ms))
    return spark.createDataFrame(rows, "source string, line_number bigint, value string, event_ms bigint")


@pytest.mark.parametrize("limit", [RateLimit(3, 10, 4), RateLimit(5, 5, 2), RateLimit(1, 7, 1)])
def test_rate_limit(spark, monkeypatch, limit):
    monkeypatch.setattr(rl, "CHUNK_MS", 25)
    # One key has most of the lines.
    rnd = random.Random(3)
    arrivals = random_arrivals(rnd, "a", 600) + random_arrivals(rnd, "bc", 40)
    lines = table(spark, arrivals)
    granted = rl.grant(lines, limit)
    got = [r.value for r in rl.rate_limit(lines, limit, granted=granted).collect()]
    assert sorted(got) == sorted(walk(arrivals, limit))
    assert 0 < len(got) < len(arrivals)
    one = sorted(arrivals, key=lambda a: (a[1], a[0], int(a[2][1:])))
    wanted = walk([("all", ms, name) for _, ms, name in one], limit)
    granted = rl.grant(lines, limit, key=None)
    got = [r.value for r in rl.rate_limit(lines, limit, key=None, granted=granted).collect()]
    assert sorted(got) == sorted(wanted)


@pytest.mark.parametrize("joins", ["shuffled", "broadcast at run time"])
def test_adaptive_plans_keep_groups_whole(spark, conf, monkeypatch, joins):
    # Spark may split skewed partitions of a join, or read shuffles locally once it turns a join
    # into a broadcast; neither may tear a key or chunk apart.
    monkeypatch.setattr(rl, "CHUNK_MS", 500)
    conf(spark__sql__autoBroadcastJoinThreshold="-1",
         spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="1",
         spark__sql__adaptive__skewJoin__skewedPartitionFactor="0.1",
         spark__sql__adaptive__advisoryPartitionSizeInBytes="2k",
         spark__sql__adaptive__coalescePartitions__parallelismFirst="false")
    if joins != "shuffled":
        # The chunk starts are broadcast from the outset, their phases only at run time.
        conf(spark__sql__autoBroadcastJoinThreshold="30k",
             spark__sql__adaptive__autoBroadcastJoinThreshold="100m")
    limit = RateLimit(1, 10, 3)
    arrivals = random_arrivals(random.Random(4), "a", 20_000) + random_arrivals(random.Random(5), "bc", 50)
    lines = table(spark, arrivals).repartition(8)
    granted = rl.grant(lines, limit)
    got = [r.value for r in rl.rate_limit(lines, limit, granted=granted).collect()]
    assert sorted(got) == sorted(walk(arrivals, limit))


@pytest.mark.parametrize("threshold", ["-1", "100m"])
def test_every_walk_has_a_shuffle_of_its_own(spark, conf, threshold):
    conf(spark__sql__autoBroadcastJoinThreshold=threshold, spark__sql__adaptive__enabled="false")
    lines = table(spark, random_arrivals(random.Random(4), "ab", 50))
    plan = rl.grant(lines, RateLimit(1, 10, 3))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == text.count("Exchange hashpartitioning(_slot") > 0


def test_all_lines_in_one_millisecond(spark, conf):
    arrivals = [("a", 5, f"a{i}") for i in range(200)]
    for threshold in ("1000", "3"):
        conf(spark__sql__optimizer__windowGroupLimitThreshold=threshold)
        got = rl.rate_limit(table(spark, arrivals), RateLimit(1, 10, 8)).collect()
        assert sorted(r.line_number for r in got) == list(range(1, 9))


def test_no_limit_and_no_burst(spark):
    lines = table(spark, [("a", i, f"a{i}") for i in range(5)])
    assert rl.rate_limit(lines, RateLimit()).count() == 5
    assert rl.rate_limit(lines, RateLimit(1, 1, 0)).count() == 0
    with pytest.raises(ValueError):
        RateLimit(-1)


def test_null_and_several_key_columns(spark):
    rows = [(None, "x", 1, 1), (None, "x", 2, 1), ("null", "x", 3, 1), ("s", "y", 4, 1), ("s", "z", 5, 1)]
    lines = spark.createDataFrame(rows, "source string, kind string, line_number bigint, event_ms bigint")
    limit = RateLimit(1, 1000, 1)
    assert rl.rate_limit(lines, limit).count() == 3
    assert rl.rate_limit(lines, limit, key=("source", "kind")).count() == 4


@pytest.mark.parametrize("limit", [RateLimit(3, 10, 4), RateLimit(5, 5, 2), RateLimit(1, 7, 1)])
def test_batches_carry_buckets(spark, monkeypatch, tmp_path, limit):
    monkeypatch.setattr(rl, "CHUNK_MS", 25)
    rnd = random.Random(8)
    arrivals = sorted(random_arrivals(rnd, "ab", 150), key=lambda a: a[1])
    # The last batch brings a line older than its bucket.
    arrivals.append(("a", 1, "late"))
    cuts = [0, 70, 71, 200, len(arrivals)]
    got, rows = [], table(spark, arrivals).collect()
    for i, (begin, end) in enumerate(zip(cuts, cuts[1:])):
        batch = spark.createDataFrame(rows[begin:end], table(spark, arrivals[:1]).schema)
        for _ in range(2 if i == 2 else 1):  # a batch that is run twice gives the same lines
            kept = rl.rate_limit_batch(
                batch, limit, str(tmp_path), i, time="event_ms").collect()
        got += [r.value for r in kept]
    ordered = []
    for begin, end in zip(cuts, cuts[1:]):
        clock = {k: max(ms for kk, ms, _ in arrivals[:begin] if kk == k)
                 for k in {a[0] for a in arrivals[:begin]}}
        ordered += sorted(arrivals[begin:end], key=lambda a: (max(a[1], clock.get(a[0], 0)), a[1]))
    assert sorted(got) == sorted(walk(ordered, limit))
    assert 0 < len(got) < len(arrivals)
    assert {p.name for p in tmp_path.iterdir()} == {"batch=2", "batch=3", "work"}
    assert len(list((tmp_path / "work").iterdir())) <= 3  # those of the last batch


def test_saturated_bucket_leaves_few_pieces():
    limit = RateLimit(1, 3_600_000, 1)
    rows = [("a", 0, ms, 1, None, 0) for ms in range(20_000)]
    assert len(list(rl._phase_changes(limit)(rows))) < 10


def passed(spark, folder, i, stamps, limit, **options):
    rows = [("a", n, f"b{i} {n}", ms) for n, ms in enumerate(stamps)]
    batch = spark.createDataFrame(rows, "source string, position bigint, value string, event_ms bigint")
    return [r.position for r in rl.rate_limit_batch(batch, limit, str(folder), i, **options).collect()]


def test_stamp_far_ahead_holds_a_bucket_up_only_for_the_tolerance(spark, tmp_path):
    limit, t = RateLimit(10, 1000, 5), 1_700_000_000_000
    first = [t, t + 1, t + 10 ** 12]
    assert len(passed(spark, tmp_path, 0, first, limit, time="event_ms", now_ms=t)) == 3
    later = [t + 120_000 + 1000 * i for i in range(50)]
    assert len(passed(spark, tmp_path, 1, later, limit, time="event_ms", now_ms=later[-1])) == 50


def test_lines_arrive_with_their_batch_and_full_buckets_go(spark, tmp_path):
    limit, t = RateLimit(10, 1000, 5), 1_700_000_000_000
    assert sorted(passed(spark, tmp_path, 0, [7] * 20, limit, now_ms=t)) == list(range(5))
    assert len(passed(spark, tmp_path, 1, [7] * 20, limit, now_ms=t + 200)) == 2
    other = spark.createDataFrame([("b", 1, "x")], "source string, position bigint, value string")
    assert rl.rate_limit_batch(other, limit, str(tmp_path), 2, now_ms=t + 100_000).count() == 1
    assert [r._key for r in spark.read.parquet(str(tmp_path / "batch=2")).collect()] == ["=b"]
