import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loglens.llm import lines

SCHEMA = "doc_id bigint, text string, id string, pos int, line string, lines string"


def near(a: str, b: str) -> bool:
    """Within one edit, by definition."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(docs, min_chars):
    seen, out = [], {}
    for doc, text in sorted((d for d in docs if d[1] is not None), key=lambda d: (d[0] is None, d[0])):
        kept = []
        for line in text.split("\n"):
            if len(line) >= min_chars:
                if any(near(line, s) for s in seen):
                    seen.append(line)
                    continue
                seen.append(line)
            kept.append(line)
        out[doc] = "\n".join(kept)
    return out | {d: None for d, t in docs if t is None}


def run(spark, docs, min_chars):
    frame = spark.createDataFrame([(d, t, "x", 1, "y", "z") for d, t in docs], SCHEMA)
    return {r[0]: r[1] for r in lines.deduplicated(frame, min_chars=min_chars).select("doc_id", "lines_.text").collect()}


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.randint(3, 14))) for _ in range(6)]
    docs = []
    for n in range(60):
        made = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(line) + 1)
                how = rng.random()
                if how < 0.4 and at < len(line):
                    line[at] = rng.choice("abcéd")
                elif how < 0.7:
                    line.insert(at, rng.choice("abcéd"))
                elif at < len(line):
                    del line[at]
            made.append("".join(line))
        docs.append((n, "\n".join(made)))
    assert run(spark, docs, 3) == expected(docs, 3)


def test_large_family_is_split_not_paired(spark, monkeypatch):
    rng = random.Random(5)
    base = "the quick brown fox jumps over the lazy dog again"
    docs = []
    for n in range(150):
        line = list(base)
        at = rng.randrange(len(line))
        line[at:at + rng.randint(0, 3)] = rng.choices("xyzq", k=rng.randint(0, 3))
        docs.append((n, "".join(line)))
    assert run(spark, docs, 10) == expected(docs, 10)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "\n\n"), (4, "short"), (5, "short"), (6, "a long line of text here\n"),
            (7, "a long line of text here"), (None, "a long line of text hera"), (8, "w" * 50_000), (9, "w" * 50_001)]
    got = run(spark, docs, 20)
    assert got == expected(docs, 20)
    assert got[5] == "short" and got[6] == "a long line of text here\n" and got[None] == "" and got[9] == ""
    assert run(spark, [], 20) == {}


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("threshold", (2, 3))
def test_more_edits_against_brute_force(spark, threshold):
    rng = random.Random(threshold)
    made = ["".join(rng.choice("abcdefghé ") for _ in range(rng.choice([12, 20, 40]))) for _ in range(4)]
    for _ in range(110):
        line = list(rng.choice(made[:4]))
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(line))
            line[at:at + rng.randint(0, 1)] = rng.choices("abcdefgh", k=rng.randint(0, 1))
        made.append("".join(line))
    docs = list(enumerate(rng.sample(made, len(made))))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r[0] for r in lines.deduplicated(frame, min_chars=3, threshold=threshold).where("lines_.n_removed > 0").select("doc_id").collect()}
    assert got == {n for n, t in docs if len(t) >= 3 and any(len(o) >= 3 and distance(t, o) <= threshold for _, o in docs[:n])}


def test_rows_that_share_an_id_keep_their_lines(spark):
    frame = spark.createDataFrame([(1, "the same long line here")] * 2, "doc_id bigint, text string")
    assert [r.lines_.text for r in lines.deduplicated(frame).collect()] == ["the same long line here"] * 2


def test_rows_that_share_an_id_lose_only_their_own_lines(spark):
    rows = [(1, "the first line of all\na second line, the same"), (None, "a line of the null id\na second line, the same"),
            (None, "another line of its own\nclean text that stands once"), (2, "short"), (2, "some line of this row\na second line, the same"),
            (2, "that line of this row\nunique text of the third")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.text): (r.lines_.n_removed, r.lines_.text) for r in lines.deduplicated(frame).collect()}
    assert got == {(d, t): (1, t.split("\n")[0]) if d != 1 and "the same" in t else (0, t) for d, t in rows}


def test_near_dedup_keeps_one_row_of_an_id_and_text(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other, third = long.replace("w", "x"), long.replace("w", "y")
    rows = [(1, long), (1, long), (5, long + " more"), (5, other), (None, long), (None, third), (None, third + " more")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = corpus_pipeline.near_dedup(spark, frame, "").collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in got) == [(0, "y"), (1, "w"), (5, "x")]


def test_banded_distance(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        a = [rng.choice("ab") for _ in range(rng.randint(0, 9))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randint(0, 1)] = rng.choices("ab", k=rng.randint(0, 1))
        rows.append(("".join(a), "".join(b)))
    frame = spark.createDataFrame(rows, "a string, b string")
    for k in (1, 2, 3):
        got = frame.select("a", "b", F.levenshtein("a", "b").alias("true"),
                           lines.banded_distance(F.col("a"), F.col("b"), k).alias("got")).collect()
        wrong = [r for r in got if (r.true <= k) != (r.got <= k) or (r.true <= k and r.true != r.got)]
        assert wrong == []


@pytest.mark.parametrize("paired", (lines.PAIRED, 8))
def test_family_of_changed_words_takes_one_round(spark, monkeypatch, paired):
    # long enough to be cut like shorter lines, and most of them too far from each other
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(16)]
    made = []
    for _ in range(90):
        own = list(words)
        own[rng.randrange(len(own))] = "".join(rng.choices("klmnop", k=rng.choice([2, 5, 8])))
        made.append(" ".join(own))
    monkeypatch.setattr(lines, "PAIRED", paired)
    names, old = [], lines.materialize
    monkeypatch.setattr(lines, "materialize", lambda df, name: (names.append(name), old(df, name))[1])
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")
    got = {r[0] for r in lines.deduplicated(frame, threshold=3).where("lines_.n_removed > 0").select("doc_id").collect()}
    assert got == {n for n, t in enumerate(made) if any(abs(len(t) - len(o)) <= 3 and distance(t, o) <= 3 for o in made[:n])}
    assert got and (paired < 90 or names.count("line-groups") <= 2)


def star(rng, n, changes=1, alphabet="klmnop"):
    """Copies of one line, each with some of its words replaced."""
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 6))) for _ in range(40)]
    made = []
    for _ in range(n):
        own = list(words)
        for at in rng.sample(range(len(own)), changes):
            own[at] = "".join(rng.choices(alphabet, k=rng.choice([1, 4, 5, 6])))
        made.append(" ".join(own))
    return made


def test_copies_changed_in_different_places_are_not_paired(spark, monkeypatch):
    made = star(random.Random(4), 400)
    rows, old = {}, lines.materialize

    def counted(df, name):
        table = old(df, name)
        rows[name] = rows.get(name, 0) + table.count()
        return table

    monkeypatch.setattr(lines, "materialize", counted)
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")
    got = {r[0] for r in lines.deduplicated(frame, threshold=3).where("lines_.n_removed > 0").select("doc_id").collect()}
    near = frame.alias("a").join(frame.alias("b"), F.expr("b.doc_id < a.doc_id AND levenshtein(a.text, b.text) <= 3"))
    assert got == {r[0] for r in near.select("a.doc_id").distinct().collect()} and 0 < len(got) < 400
    assert rows["line-pairs"] < 400 * 10  # of 79,800


@pytest.mark.parametrize("threshold,alphabet,changes", [(1, "klmnop", 1), (2, "ab", 2), (3, "ab", 2), (3, "abcdefgh", 1), (3, "klmnop", 3)])
def test_spans_lose_no_pair(spark, monkeypatch, threshold, alphabet, changes):
    rng = random.Random(threshold + changes)
    made = star(rng, 120, changes, alphabet)
    # places where an edit can be shifted, and lines that are near others
    made += ["ab" * 60, "ab" * 59 + "b" + "ab" * 2, "ba" * 60]
    made += [t[:p] + rng.choice("abx") * rng.randint(0, 2) + t[p + rng.randint(0, 2):] for t in made for p in [rng.randrange(len(t))]]
    made = list(dict.fromkeys(rng.sample(made, len(made))))
    monkeypatch.setattr(lines, "MEETING", 6)
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")
    got = {r[0] for r in lines.deduplicated(frame, threshold=threshold).where("lines_.n_removed > 0").select("doc_id").collect()}
    near = frame.alias("a").join(frame.alias("b"), F.expr(f"b.doc_id < a.doc_id AND levenshtein(a.text, b.text) <= {threshold}"))
    assert got == {r[0] for r in near.select("a.doc_id").distinct().collect()} and got


def test_spans_against_definition(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(400):
        a = [rng.choice("ab") for _ in range(rng.randint(0, 24))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randint(0, 1)] = rng.choices("abé", k=rng.randint(0, 1))
        rows.append(("".join(a), "".join(b)))
    frame = spark.createDataFrame(rows, "a string, b string")
    for r in frame.select("a", "b", F.expr(lines._span("a", "b", 2)).alias("s")).collect():
        same = next((i for i, (x, y) in enumerate(zip(r.a, r.b)) if x != y), min(len(r.a), len(r.b)))
        apart = [x for x in range(len(r.b) + 1) if min(distance(r.b[:x], r.a[:y]) for y in range(len(r.a) + 1)) > 2]
        assert r.s.at == same and (r.s.till >= apart[0] if apart else r.s.till == len(r.b))
