import random

import numpy as np
import pytest

from loglens.llm import common, minhash


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def expected(docs, k, percent=80):
    sets = {i: shingles(t, k) for i, t in docs}
    at = {i: i for i in sets}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                at[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def texts(rng, n):
    vocabulary = ["w%d" % i for i in range(60)] + ["É", "ß,", "A"]
    base = [rng.choices(vocabulary, k=rng.randint(0, 60)) for _ in range(n // 6)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append((i, rng.choice((" ", "\n", "\t ")).join(words)))
    return out


@pytest.mark.parametrize("k", (4, 5))
def test_against_all_pairs(spark, k):
    docs = texts(random.Random(k), 240)
    frame = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id bigint, text string, n int, rep string")
    got = {r[0]: tuple(r[1:]) for r in minhash.near_duplicates(frame, k).collect()}
    assert got == expected(docs, k)


def test_chain_of_near_copies_in_one_bucket(spark):
    """Neighbours are similar, the ends are not: components follow the chain."""
    words = ["w%d" % i for i in range(400)]
    docs = [(i, " ".join(words[4 * i:4 * i + 100])) for i in range(60)] + [(100, " ".join(reversed(words)))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r[0]: tuple(r[1:]) for r in minhash.near_duplicates(frame, 4).collect()}
    assert got == expected(docs, 4)


def test_large_bucket_of_many_families(spark):
    """One crowded bucket of sets that are mostly apart: every link across components is found."""
    rng = random.Random(3)
    sets = {i: np.unique(np.array(rng.choices(range(30), k=14), np.uint64)) for i in range(90)}
    members = spark.createDataFrame([(7, i, len(s)) for i, s in sets.items()], "band bigint, rep bigint, n bigint")
    stored = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in sets.items()], "id bigint, shingles array<bigint>")
    got = {r[0]: r[1] for r in minhash.links(members, stored, 50).collect()}
    at = {i: i for i in sets}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x
    for a in sets:
        for b in sets:
            both = len(np.intersect1d(sets[a], sets[b]))
            if a < b and 100 * both >= 50 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                at[y] = x
    assert got == {i: root(i) for i in sets}


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (None, "one"), (6, "a b c d " * 9000),
            (7, "a b c d " * 9000), (8, "two words"), (8, "two words")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = sorted(tuple(r) for r in minhash.near_duplicates(frame, 4).collect() if r[0])
    assert [r[2:] for r in rows] == [
        (1, True), (2, True), (3, True), (4, True), (4, False), (6, True), (6, False), (8, True), (8, True)]
    assert [r[1] for r in rows] == [0, 0, 0, 1, 1, 4, 4, 1, 1]
    lost = [tuple(r) for r in minhash.near_duplicates(frame, 4).where("doc_id IS NULL").collect()]
    assert lost == [(None, 1, None, True)]
    assert minhash.near_duplicates(frame.limit(0), 4).count() == 0


def test_signature_agrees_as_often_as_the_sets_overlap():
    rng = np.random.default_rng(1)
    same = []
    for _ in range(60):
        x = rng.integers(0, 1 << 62, 300).astype(np.uint64)
        same.append((minhash.signature(x[:240]) == minhash.signature(x[60:])).mean())
    assert abs(np.mean(same) - 0.6) < 0.03


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 300)] + [(1, i) for i in range(2, 50)] + [
        (rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    rng.shuffle(edges)
    at = {x: x for e in edges for x in e}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        at[y] = x
    got = {r[0]: r[1] for r in common.connected_components(
        spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in linked}
