"""Line deduplication by a segment-partition edit join, in DataFrame operations only.

Two lines are near if ``threshold`` edits (a character inserted, deleted or replaced) or fewer make them equal. The shorter line is the base.
Cut in k + 1 segments for k edits, one of its segments, the one numbered j, stands unchanged in the other line with at most j edits before it and at
most k - j behind it: with S(i) edits before segment i, take the last i with S(i) >= i. So the segment is shifted by
j places at most, and a line probes the segments of lines of its length and of those shorter by up to k.

Segments need not cover the line, so lines of about one length are cut at the same places, behind which a rest is left. One key of a line then
stands for bases of several lengths, and the few keys that are shared are told apart by the length.

What is before and behind the segment are gaps with budgets j and k - j, to which the same applies. Groups of up to a few thousand lines
are told apart by sketches: parities of counts of characters and of their pairs, of which an edit changes a few, so that two lines with too many
different ones are no pair. Larger groups have their widest gap cut again, until the groups are small. The
first line of every group is compared with all of it before, and what is near it needs no other pair. Only groups whose
gaps have no more characters than edits are verified pair by pair whatever their size.

In a group of more than a few dozen lines that comparison also tells which lines can meet. Let f(x) be the fewest edits between the
first x characters of the group's first line and any prefix of another line: it never falls, and for two near lines it differs by k at most
everywhere. So where one line first leaves the group's first, the other has not needed k + 1 edits: their spans between these two places
overlap, and so do those taken from the right. Copies of one line that were each changed elsewhere don't meet then, however many they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.sources.shared import materialize

#: Edits between near lines: what the functions take by default, and what the registered queries and the pipeline use.
THRESHOLD, QUERIED = 1, 3
MIN_CHARS = 20
#: Lines of a group that are paired, and of one that is paired without sketches. A line meets no more than PAIRED others of a group.
PAIRED, FEW = 4096, 4
#: Bases of a group that one task pairs.
SLICE = 256
#: Lines of a group that meet whatever their spans, and steps of a line by which the spans of a larger one are dealt.
MEETING, STEPS = 64, 16
#: A line's spans beside another one: places in the other one, those on the right counted from its end.
_SPAN = ["left", "left_end", "right", "right_end"]
_MEMBER = ["key", "h", "g", "first", "d", "base", "size"]
#: Rows of a broadcast at most; and copies of a line that no one minds.
BROADCAST_ROWS, SELDOM = 200_000, 16
#: Pairs that a task verifies.
PAIRS_A_TASK = 20_000


def banded_distance(a: Column, b: Column, k: int) -> Column:
    """Edit distance of two texts of about equal length if it is at most k, else a number above k.

    Bit-parallel over a band of 2k+1 diagonals: the bits of a number are the vertical steps of one column of the table, and each
    character of ``b`` turns them into those of the next column.
    """
    def distance(text: Column) -> Column:
        done = F.aggregate(text["b"], _start(F.size(text["a"]), k), lambda s, c: _step(s, c, text["a"], k))
        return F.when(F.size(text["b"]) == 0, F.size(text["a"])).otherwise(done["score"])

    # an array of one holds what is used many times, so that it is made once
    chars = F.array(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b")))
    return F.when(F.abs(F.length(a) - F.length(b)) > k, k + 1).when(F.length(a) == 0, F.length(b)).when(
        F.length(b) == 0, F.length(a)).otherwise(F.transform(chars, distance)[0])


def _start(m: Column, k: int) -> Column:
    full = (1 << 2 * k + 1) - 1
    return F.struct(
        F.lit(full & ~((1 << k) - 1)).alias("up"), F.lit(0).alias("down"),
        F.least(F.lit(k), m).alias("score"), F.lit(0).alias("column"))


def _step(s: Column, c: Column, a: Column, k: int) -> Column:
    """From one column of the table to the next; bit d stands for row column - k + d."""
    full = (1 << 2 * k + 1) - 1
    inverse = lambda x: x.bitwiseXOR(full)
    j, m = s["column"] + 1, F.size(a)
    agree = F.lit(0)
    for d in range(2 * k + 1):
        row = j - (k - d)  # rows outside of the text agree with nothing
        agree = agree.bitwiseOR(F.when((row >= 1) & (F.get(a, row - 1) == c), 1 << d).otherwise(0))

    def advance(zero: Column) -> Column:
        rise = s["down"].bitwiseOR(inverse(zero.bitwiseOR(s["up"])))
        fall = zero.bitwiseAND(s["up"])
        low = F.shiftright(zero, 1)
        # along the lowest diagonal until it meets the last row, then along that row
        row = m - j + k
        score = s["score"] + F.when(row >= 2 * k, 1 - F.shiftright(zero, 2 * k)).otherwise(
            _bit(rise, row, k) - _bit(fall, row, k))
        return F.struct(fall.bitwiseOR(inverse(low.bitwiseOR(rise))).alias("up"), low.bitwiseAND(rise).alias("down"),
                        score.alias("score"), j.alias("column"))

    def diagonal(equal: Column) -> Column:
        sums = (equal.bitwiseAND(s["up"]) + s["up"]).bitwiseXOR(s["up"])
        return sums.bitwiseOR(equal).bitwiseOR(s["down"]).bitwiseAND(full)

    return F.transform(F.transform(F.array(agree), diagonal), advance)[0]


def _bit(x: Column, at: Column, k: int) -> Column:
    out = F.lit(0)
    for d in range(2 * k + 1):
        out = F.when(at == d, F.shiftright(x, d).bitwiseAND(1)).otherwise(out)
    return out


def _places(k: int) -> list[tuple[int, int, int]]:
    """(d, j, s) of the segments that a line offers and probes, the ones it offers first.

    It probes segment j, shifted by s, of lines cut like those that are shorter by d, its own segments are those at d = s = 0.
    """
    out = [(d, j, s) for d in range(k + 1) for j in range(k + 1) for s in range(-j, j + 1) if s + k - j >= d and s - k + j <= k]
    return sorted(out, key=lambda x: (x[0] != 0 or x[2] != 0, x))


def _cut_length(length: str) -> str:
    """The length that lines of this length are cut by: one of 16 to 32 for each doubling."""
    return f"if({length} < 0, -1, {length} - {length} % shiftleft(1, greatest(length(bin({length})) - 5, 0)))"


def _cut_lengths(k: int) -> str:
    """The lengths that lines shorter by 0 to k than ``length`` are cut by."""
    return f"array({', '.join(_cut_length(f'(length - {d})') for d in range(k + 1))}) AS cuts"


def _ends(k: int) -> list[str]:
    """Ends of segment j of lines that are cut by the length ``by``."""
    return [f"CAST(CAST(by AS BIGINT) * (j + {i}) div {k + 1} AS INT) AS {name}" for i, name in enumerate(("lo", "hi"))]


def _widest(k: int) -> str:
    """The largest d for which lines are cut by that length."""
    return f"greatest({', '.join(f'if(cuts[{d}] = by, {d}, -1)' for d in range(k + 1))}, -1) AS last"


def _keys(lines: DataFrame, k: int) -> DataFrame:
    """h, n, key: hashes of all segments that the lines (h, line) offer and probe; n counts ``_places``.

    Places become rows before segments are cut, and four bytes a character make a cut a copy, wherever in the line it is.
    """
    def rows(of):
        return F.array(*[F.struct(F.lit(n).alias("n"), F.lit(d).alias("d"), F.lit(j).alias("j"), F.lit(s).alias("s"))
                         for n, (d, j, s) in enumerate(_places(k)) if of(d)])

    wide = lines.select("h", F.length("line").alias("length"), F.encode("line", "UTF-32").alias("wide")).selectExpr(
        "h", "length", "wide", _cut_lengths(k))
    # most lines are cut as all those that they probe
    places = F.when(F.col("cuts")[0] == F.col("cuts")[k], rows(lambda d: d == 0)).otherwise(rows(lambda d: True))
    each = wide.select("h", "length", "wide", "cuts", F.explode(places).alias("at")).selectExpr(
        "h", "length", "wide", "cuts", "at.n AS n", "at.d AS d", "at.j AS j", "at.s AS s", "cuts[at.d] AS by")
    each = each.where("by >= 0 AND (d = 0 OR by <> cuts[d - 1])").selectExpr("*", _widest(k), *_ends(k))
    return each.where(f"s - {k} + j <= last AND lo + s >= 0 AND hi + s <= length").selectExpr(
        "h", "n", f"xxhash64(by, j, {_wide_part('lo + s', 'hi - lo')}) AS key")


def _wide_part(start: str, size: str) -> str:
    """Characters of a line that has four bytes for each; ``start`` counts from 0, what is ahead of the line is nothing."""
    return f"substring(wide, 4 * greatest({start}, 0) + 1, 4 * ({size} + least({start}, 0)))"


def _each_line(docs: DataFrame, min_chars: int) -> DataFrame:
    """id, mark, pos, line of the lines that are judged."""
    return docs.select("id", "mark", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(
        F.length("line") >= min_chars)


def _place() -> Column:
    """What places are ordered by; the null id is the last."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "mark", "pos")


def _named(lines: DataFrame) -> DataFrame:
    return lines.select("id", "mark", "pos", "line", F.xxhash64("line").alias("h"), F.hash("line").alias("g"))


def near_earlier(distinct: DataFrame, lines: DataFrame, k: int) -> DataFrame:
    """(h, g) of the distinct lines that are near one with an earlier place.

    ``distinct``: h, g, first (place).
    ``lines``: h, g, line of every occurrence.
    """
    # one shuffle of numbers alone, as these rows are the most of the join
    here = Window.partitionBy("key")
    keys = _keys(_seldom_or_first(distinct, lines), k)
    shared = keys.select("h", "key", "n", F.min("h").over(here).alias("low"), F.max("h").over(here).alias("high"),
                         F.min("n").over(here).alias("own"))
    shared = materialize(shared.where(f"low < high AND own <= {k}").select("h", "n", "key").distinct(), "shared-segments")
    live = materialize(shared.select("h").distinct().join(distinct.select("h", "g", "first"), "h").select("h", "g", "first"), "live-lines")
    if live.count() <= BROADCAST_ROWS:
        live = F.broadcast(live)
    # the place is part of the key, so that a common line's occurrences are spread out
    here = lines.select("h", "g", _place().alias("first"), "line")
    texts = materialize(here.join(live, ["h", "g", "first"]).dropDuplicates(["h", "g", "first"]), "live-texts")
    members = _first_members(shared, texts, k)
    near, pairs, judged = None, None, None
    while True:
        members = _grouped(members)
        now = _pairs(members.where(f"size <= {FEW}"))
        pairs = now if pairs is None else pairs.unionByName(now)
        members = members.where(f"size > {FEW}")
        if members.isEmpty():
            break
        paired = f"(size <= {PAIRED} OR NOT exists(gaps, x -> x.hi - x.lo > x.b))"
        many = f"({paired} AND size > {MEETING})"
        spans = materialize(_spans(_with_first(members.where(many)), texts, k), "line-spans")
        asked = _with_first(members.where(f"NOT {many}")).join(spans, ["h", "g", "e_h", "e_g"], "left_anti")
        if judged is not None:
            asked = asked.join(judged, asked.columns, "left_anti")
        asked = materialize(asked, "first-pairs")
        judged = asked if judged is None else judged.unionByName(asked)
        found = materialize(_verified(asked, texts, k).unionByName(spans.where("close").select("h", "g")).distinct(), "near-first")
        near = found if near is None else near.unionByName(found)
        members = members.join(near.distinct().withColumn("late", F.lit(True)), ["h", "g"], "left")
        meeting = members.where(f"{paired} AND NOT {many}").selectExpr(
            *_MEMBER, "late", "false AS close", *[f"0 AS {c}" for c in _SPAN], "array(0) AS cells")
        meeting = meeting.unionByName(_cells(members.where(many), spans))
        pairs = pairs.unionByName(_pairs(materialize(_sketched(meeting, texts), "line-sketches"), k))
        members = members.where(f"NOT {paired}")
        still = members.where("late IS NULL AND first > least").select("key").distinct()
        members = _cut(members.join(still, "key", "left_semi").drop("size", "least", "late", "e_h", "e_g"), texts)
    pairs = pairs.distinct()
    if near is not None:
        pairs = pairs.join(near.distinct(), ["h", "g"], "left_anti")
    late = _verified(materialize(pairs, "line-pairs"), texts, k)
    return (late if near is None else late.unionByName(near)).distinct()


def _seldom_or_first(distinct: DataFrame, lines: DataFrame) -> DataFrame:
    """h, line of all occurrences but those after the first of common lines.

    Common is what has more than one in BROADCAST_ROWS of all occurrences, so there are no more than BROADCAST_ROWS common lines, however
    many lines there are; the others' few copies are kept, as the join sorts them out cheaper than a shuffle of all texts.
    """
    total = distinct.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    common = distinct.where(F.col("copies") > max(SELDOM, total // BROADCAST_ROWS)).select(
        "h", "g", F.col("first").alias("common"))
    return lines.join(F.broadcast(common), ["h", "g"], "left").where(
        F.col("common").isNull() | (F.col("common") == _place())).select("h", "line")


def _verified(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(h, g) of the pairs (h, g, e_h, e_g) of lines that are near.

    A built-in distance, which stops at the threshold, lets few others through to the bit-parallel one. Pairs are dealt by their number,
    as their texts say little of the work.
    """
    tasks = pairs.count() // PAIRS_A_TASK + 1
    sides = pairs.join(texts.select("h", "g", "line"), ["h", "g"]).join(
        texts.selectExpr("h AS e_h", "g AS e_g", "line AS e_line"), ["e_h", "e_g"]).repartition(tasks, "h", "g", "e_h", "e_g")
    close = sides.where(F.abs(F.length("line") - F.length("e_line")) <= k).where(
        F.levenshtein("line", "e_line", k).between(0, k))
    return close.where(banded_distance(F.col("line"), F.col("e_line"), k) <= k).select("h", "g").distinct()


def _first_members(shared: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Members of the first groups: a line, the segment it has in common, and the gaps before and behind it."""
    places = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(j).alias("j"), F.lit(s).alias("s")) for d, j, s in _places(k)])
    rows = shared.join(texts.select("h", "g", "first", F.length("line").alias("length")), "h").withColumn("at", F.get(places, "n"))
    rows = rows.selectExpr("h", "g", "first", "key", "length", "at.d AS least", "at.j AS j", "at.s AS s", _cut_lengths(k))
    rows = rows.selectExpr("*", "cuts[least] AS by").selectExpr("*", _widest(k), *_ends(k))
    # from here on by the base's own length
    rows = rows.selectExpr("*", "explode(sequence(least, last)) AS d").where(f"abs(d - s) <= {k} - j").selectExpr(
        "h", "g", "first", "xxhash64(key, length - d) AS key", "d", "j", "s", "length - d AS base", "lo", "hi")
    return rows.where("lo + s >= 0 AND hi + s <= base + d").selectExpr(
        "h", "g", "first", "d", "d = 0 AND s = 0 AS base", "key",
        f"""filter(array(struct(0 AS lo, lo AS hi, 0 AS sl, s AS sr, j AS b),
            struct(hi AS lo, base AS hi, s AS sl, d AS sr, {k} - j AS b)), x -> x.b > 0) AS gaps""")


def _cut(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Members with their widest gap cut: one row and key for each segment, at each shift, that can be unchanged.

    A gap's lo, hi are places in the base, sl and sr the shifts of the line's own at its ends, and b its budget of edits.
    Texts come in for the cut alone.
    """
    gap = F.expr("array_max(transform(filter(gaps, x -> x.hi - x.lo > x.b), x -> struct(x.hi - x.lo AS w, x.lo, x.hi, x.sl, x.sr, x.b)))")
    cut = members.withColumn("gap", F.coalesce(gap, F.expr(
        "transform(slice(gaps, 1, 1), x -> struct(x.hi - x.lo AS w, x.lo, x.hi, x.sl, x.sr, x.b))[0]")))
    cut = cut.join(texts.select("h", "g", F.encode("line", "UTF-32").alias("wide")), ["h", "g"])
    cut = cut.selectExpr("*", "explode(sequence(0, gap.b)) AS j")
    cut = cut.selectExpr(
        "*", "gap.lo + CAST(floor(gap.w * j / (gap.b + 1)) AS INT) AS lo", "gap.lo + CAST(floor(gap.w * (j + 1) / (gap.b + 1)) AS INT) AS hi",
        "explode(sequence(greatest(gap.sl - j, gap.sr - gap.b + j), least(gap.sl + j, gap.sr + gap.b - j))) AS s")
    return cut.where("lo + s >= gap.lo + gap.sl AND hi + s <= gap.hi + gap.sr").selectExpr(
        "h", "g", "first", "d", "base AND s = 0 AS base", f"xxhash64(key, j, {_wide_part('lo + s', 'hi - lo')}) AS key",
        """filter(concat(filter(gaps, x -> x.lo <> gap.lo OR x.hi <> gap.hi), array(
            struct(gap.lo AS lo, lo AS hi, gap.sl AS sl, s AS sr, j AS b),
            struct(hi AS lo, gap.hi AS hi, s AS sl, gap.sr AS sr, gap.b - j AS b))), x -> x.b > 0) AS gaps""")


def _grouped(members: DataFrame) -> DataFrame:
    """Members of the keys that a base and another line share, with the group's size, first place, and the line there as e_h, e_g."""
    groups = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.max("base").alias("based"), F.min(F.struct("first", "h", "g")).alias("low"),
        F.max("first").alias("last")).where("based AND low.first < last").selectExpr(
        "key", "size", "low.first AS least", "low.h AS e_h", "low.g AS e_g")
    return materialize(members.join(groups, "key"), "line-groups")


def _sketched(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Members with all keys of their line, those of their own segments, and x, y, z: parities of the counts of pairs of neighbouring characters, in 128 classes, and of characters, in 64."""
    keys = members.groupBy("h", "g").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("base"), F.col("key"))).alias("own"))
    # arrays of one hold what is used for each character, so that it is made once
    grams = """transform(array(encode(line, 'UTF-32')), w -> if(length(line) < 2, array(),
        transform(sequence(0, length(line) - 2), i -> hash(substring(w, 4 * i + 1, 8)))))"""
    bits = texts.join(keys, ["h", "g"]).selectExpr("h", "g", "keys", "own", f"""transform({grams}, q -> struct(
        aggregate(q, 0L, (a, c) -> a ^ if(c & 64 = 0, shiftleft(1L, c & 63), 0L)) AS x,
        aggregate(q, 0L, (a, c) -> a ^ if(c & 64 = 0, 0L, shiftleft(1L, c & 63))) AS y))[0] AS bits""",
                                                   "aggregate(split(line, ''), 0L, (a, c) -> a ^ shiftleft(1L, hash(c) & 63)) AS z")
    return members.join(bits.select("h", "g", "keys", "own", "bits.x", "bits.y", "z"), ["h", "g"])


def _pairs(members: DataFrame, k: int | None = None) -> DataFrame:
    """h, g of the later and e_h, e_g of the earlier line of the pairs to be verified; for ``k`` edits at most if members have sketches.
    Then only lines not found late so far are later ones. An edit changes up to four pairs of neighbouring characters, and two characters.
    """
    marks = [] if k is None else ["late", "x", "y", "z", "keys", "own", *_SPAN, "close", "cells"]
    # the bases of a group are dealt to slices, so no task pairs a whole group; cells of a group are smaller
    slices = f"CAST(ceil(size / if(size <= {MEETING}, {SLICE}, {4 * SLICE})) AS INT)"
    side = members.select(*_MEMBER, *marks)
    if k is not None:
        side = side.select("*", F.explode("cells").alias("cell")).drop("cells")
    a = side.where("base").selectExpr(*[f"{c} AS a_{c}" for c in side.columns], f"CAST(pmod(h, {slices}) AS INT) AS a_slice")
    b = side.selectExpr(*[f"{c} AS b_{c}" for c in side.columns], f"explode(sequence(0, {slices} - 1)) AS b_slice")
    alike = "" if k is None else f"bit_count(a_x ^ b_x) + bit_count(a_y ^ b_y) <= {4 * k} AND bit_count(a_z ^ b_z) <= {2 * k} AND if(a_first < b_first, b_late, a_late) IS NULL AND "
    # once, however many keys two lines share
    close = "" if k is None else f" AND a_key = array_min(array_intersect(a_own, b_keys))"
    on = (F.col("a_key") == F.col("b_key")) & (F.col("a_slice") == F.col("b_slice"))
    if k is not None:
        on &= F.col("a_cell") == F.col("b_cell")
        alike = "a_left <= b_left_end AND b_left <= a_left_end AND a_right <= b_right_end AND b_right <= a_right_end AND (a_cell >= 0 OR a_close <> b_close) AND " + alike
    pairs = a.join(b, on).where(alike + "a_first <> b_first AND (b_d > 0 OR a_first < b_first)" + close)
    return pairs.selectExpr(
        "if(a_first < b_first, b_h, a_h) AS h", "if(a_first < b_first, b_g, a_g) AS g",
        "if(a_first < b_first, a_h, b_h) AS e_h", "if(a_first < b_first, a_g, b_g) AS e_g").distinct()


def _with_first(members: DataFrame) -> DataFrame:
    """Pairs of every line of a large group and the group's first one."""
    return members.where("first > least").select("h", "g", "e_h", "e_g").distinct()


def _span(a: str, b: str, k: int) -> str:
    """(at, till): how many characters text ``a`` has in common with the start of ``b``, and a number of ``b``'s that k + 1 edits lie in, or all.

    ``till`` may be larger than need be: it is looked for in doubled steps.
    """
    alike = """aggregate(reverse(sequence(0, length(bin(length(t.b))))), 0, (n, i) -> if(n + shiftleft(1, i) <= least(length(t.a), length(t.b))
        AND left(t.a, n + shiftleft(1, i)) = left(t.b, n + shiftleft(1, i)), n + shiftleft(1, i), n))"""
    size = f"least(shiftleft({k + 1}, i), length(r.b))"
    shifts = ", ".join(str(d) for d in sorted(range(-k, k + 1), key=abs))
    found = f"""aggregate(sequence(0, length(bin(length(r.b)))), -1, (n, i) -> if(n >= 0 OR exists(array({shifts}),
        d -> levenshtein(left(r.a, {size} + d), left(r.b, {size}), {k}) >= 0), n, {size}))"""
    # arrays of one hold what is used many times, so that it is made once
    return f"""transform(transform(transform(array(struct({a} AS a, {b} AS b)), t -> struct(t.a AS a, t.b AS b, {alike} AS at)),
        t -> struct(t.at AS at, substring(t.a, t.at + 1) AS a, substring(t.b, t.at + 1) AS b)),
        r -> struct(r.at AS at, r.at + coalesce(nullif({found}, -1), length(r.b)) AS till))[0]"""


def _spans(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The pairs (h, g, e_h, e_g) with the spans of the first line beside the second, the second's length, and if they are close, that is near."""
    tasks = 8 * pairs.count() // PAIRS_A_TASK + 1
    sides = pairs.join(texts.select("h", "g", "line"), ["h", "g"]).join(
        texts.selectExpr("h AS e_h", "g AS e_g", "line AS e_line"), ["e_h", "e_g"]).repartition(tasks, "h", "g", "e_h", "e_g")
    close = F.levenshtein("line", "e_line", k).between(0, k) & (banded_distance(F.col("line"), F.col("e_line"), k) <= k)
    spans = sides.select("h", "g", "e_h", "e_g", F.length("e_line").alias("whole"), F.when(close, True).otherwise(False).alias("close"),
                         F.expr(_span("line", "e_line", k)).alias("l"), F.expr(_span("reverse(line)", "reverse(e_line)", k)).alias("r"))
    return spans.selectExpr("h", "g", "e_h", "e_g", "whole", "close", "l.at AS left", "l.till AS left_end", "r.at AS right", "r.till AS right_end")


def _cells(members: DataFrame, spans: DataFrame) -> DataFrame:
    """Members, but for the first lines of their groups, with their spans and the cells in which they meet others.

    Two lines that aren't close to the first one meet in the cells of their spans from the left and from the right. One that is close is late itself, but
    another one may be near to it: then what lies between its first and last edit reaches the ends of both of the other's spans.
    """
    step = f"(whole div {STEPS} + 1)"

    def steps(a: str, b: str) -> str:
        return f"sequence(CAST({a} div {step} AS INT), CAST({b} div {step} AS INT))"

    both = f"""flatten(transform({steps("left", "left_end")}, x -> transform({steps("right", "right_end")}, y -> x * {2 * STEPS} + y)))"""
    edits = steps("least(left, whole - right)", "greatest(left, whole - right)")
    ends = f"""if(any_close, {steps("least(left_end, whole - right_end)", "left_end")}, array())"""
    each = members.where("first > least").join(spans, ["h", "g", "e_h", "e_g"]).withColumn("any_close", F.max("close").over(Window.partitionBy("key")))
    cells = f"if(close, transform({edits}, x -> -1 - x), concat({both}, transform({ends}, x -> -1 - x))) AS cells"
    return each.selectExpr(*_MEMBER, "late", "close", *_SPAN, cells)


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
    threshold: int = THRESHOLD, out_col: str = "lines_",
) -> DataFrame:
    """``docs`` with struct column ``out_col`` (in the place of one of that name): n_lines, n_removed, n_left (lines with a word) and the text left.

    Places are ordered by (id, hash of the text, line number). A line goes if an equal line or a line within ``threshold`` edits stands at an earlier
    place; lines of fewer than ``min_chars`` characters stay and remove nothing. Null texts stay null and have no lines; the null id is the last; rows
    with the same id and text count as one, so both keep their lines. All other columns stay as they are.
    """
    mark = F.xxhash64(F.col(text_col))
    low = docs.select(F.col(id_col).cast("bigint").alias("id"), mark.alias("mark"), F.col(text_col).alias("text"))
    lines = _named(_each_line(low, min_chars))
    distinct = materialize(lines.select("h", "g", _place().alias("place")).groupBy("h", "g").agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("copies")), "lines")
    near = near_earlier(distinct, lines, threshold)
    # a table of its own, so that a common line's occurrences are dealt by the join alone and can be split
    judged = materialize(distinct.join(near.withColumn("near", F.lit(True)), ["h", "g"], "left").where(
        "copies > 1 OR near").select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near")), "judged-lines")
    gone = lines.select("h", "g", "id", "mark", "pos").join(judged, ["h", "g"]).where(
        "near OR NOT (first.id <=> id AND first.mark = mark AND first.pos = pos)").groupBy("id", "mark").agg(F.collect_set("pos").alias("gone"))
    gone = materialize(gone.select(F.col("id").alias("gone_id"), F.col("mark").alias("gone_mark"), "gone"), "gone-lines")
    # the columns travel as one, so none of them can clash with those made here
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    text = F.col("document")[text_col]
    joined = whole.join(gone, F.col("document")[id_col].cast("bigint").eqNullSafe(F.col("gone_id")) & (
        F.xxhash64(text) == F.col("gone_mark")), "left")
    all_lines = F.split(text, "\n")
    left = F.filter(F.transform(all_lines, lambda x, i: F.when(
        F.col("gone").isNull() | ~F.array_contains("gone", i), x)), lambda x: x.isNotNull())
    return joined.select(*[F.col("document")[c].alias(c) for c in docs.columns if c != out_col], F.struct(
        F.coalesce(F.size(all_lines), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
        F.when(F.col("gone").isNull(), text).otherwise(F.array_join(left, "\n")).alias("text")).alias(out_col))
