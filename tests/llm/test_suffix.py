import random
from collections import Counter

import numpy as np
import pytest

from loglens.llm import suffix


def expected(docs, length):
    texts = [(t or "").encode() for _, t in docs]
    counts = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(docs, texts):
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if counts[t[p:p + length]] > 1:
                gone[p:p + length] = [True] * length
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def made(rng, n):
    shared = ["".join(rng.choice("abé d") for _ in range(rng.randint(10, 60))) for _ in range(5)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            part = rng.choice(shared)
            if rng.random() < 0.5:
                a = rng.randrange(len(part))
                part = part[a:a + rng.randint(5, 40)]
            if rng.random() < 0.3:
                part = part.replace("a", "x", 1)
            parts += [part, "".join(rng.choice("abé d") for _ in range(rng.randint(0, 12)))]
        docs.append((i, "".join(parts)))
    return docs + [(900, "ab" * 60), (901, "a" * 70), (902, None), (903, ""), (None, "ab" * 20), (1, docs[1][1])]


def run(spark, docs, length, gram):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, id int, mark string")
    rows = suffix.deduplicated(frame, length, gram).drop("spans").collect()
    return sorted((tuple(r[:4]) + (bytes(r[4]),) for r in rows), key=str)


@pytest.mark.parametrize("seed, limit", [(1, None), (2, 0), (3, 300)])
def test_against_brute_force(spark, monkeypatch, seed, limit):
    """limit: bytes of an anchor's suffix array; 0 sends all through windows."""
    if limit is not None:
        monkeypatch.setattr(suffix, "ARRAY_BYTES", limit)
    docs = made(random.Random(seed), 60)
    assert run(spark, docs, 20, 6) == expected(docs, 20)


def test_full_length(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefg hij") for _ in range(n))
    passage, near = text(700), text(399)
    docs = [(1, text(500) + passage + text(300)), (2, passage), (3, text(10) + passage[:399]), (4, text(9) + passage[250:650] + "q"),
            (5, near + text(5)), (6, text(3) + near), (7, text(900))]
    assert run(spark, docs, 400, 32) == expected(docs, 400)


def test_empty_table(spark):
    assert run(spark, [], 400, 32) == []


@pytest.mark.parametrize("seed", range(4))
def test_interval_search(seed):
    rng = random.Random(seed)
    texts = [np.frombuffer(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 80))), np.uint8) for _ in range(20)]
    for length in (4, 7, 12):
        counts = Counter(t[i:i + length].tobytes() for t in texts for i in range(len(t) - length + 1))
        want = [[counts[t[i:i + length].tobytes()] > 1 for i in range(len(t) - length + 1)] for t in texts]
        assert [h.tolist() for h in suffix.repeated_windows(texts, length)] == want
