import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglens.llm import collocations as co
from loglens.llm.bits import bitmap


def expected(docs, least, top):
    """Plain counts; every cut of every candidate, every longer candidate around it."""
    counts, sizes = Counter(), Counter()
    for _, text, lang in docs:
        lang = lang or "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for n in range(1, 6):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i:i + n])] += 1
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    inside = set()
    for (lang, words), a in found.items():
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                if 100 * a >= 100 * counts[lang, words[i:i + n]]:
                    inside.add((lang, words[i:i + n]))
    rows = []
    for (lang, words), a in found.items():
        if (lang, words) not in inside:
            cuts = [(1000 * a * sizes[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            rows.append((lang, " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], sizes[lang], score))
    out = []
    for lang in sizes:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(lang, i, *r[1:]) for i, r in enumerate(own[:top], 1)]
    return sorted(out)


def made(seed, n=150):
    rng = random.Random(seed)
    words = ["a", "b", "A", "é", "É", " x", "the", "of"]
    docs = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 40)))
        docs.append((i % 90, text, rng.choice(["en", "en", "en", "de", None])))
    # words that are each other's languages, a repeated row, empty and null texts, long runs of one word
    return docs + [(1, "en de en de " * 9, "en"), (2, "en de en de " * 9, "de"), docs[3], docs[3], (5, "", "en"), (6, None, "en"),
                   (None, "the " * 400, "en"), (8, "of the of the! " * 60, "fr")]


def run(spark, docs, **options):
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, lang string, n int, word string").repartition(5)
    return sorted(tuple(r) for r in co.collocations(frame, **options).collect())


@pytest.mark.parametrize("seed, budget", [(1, 1 << 20), (2, 5), (3, 60)])
def test_against_plain_counts(spark, seed, budget):
    """budget: suffixes of a group; a small one sends most prefixes over it to full depth."""
    docs = made(seed)
    got = run(spark, docs, min_count=4, top=40, budget=budget)
    assert got == expected(docs, 4, 40) and len(got) > 60


def test_more_ranks_than_a_window_keeps_ahead_of_its_shuffle(spark, conf):
    conf(spark__sql__optimizer__windowGroupLimitThreshold="3")
    assert run(spark, made(4), min_count=3, top=25) == expected(made(4), 3, 25)


def test_scores_beyond_64_bits(spark):
    """a n exceeds what a long holds only in large corpora, so the arithmetic is looked at alone."""
    big = 4_000_000_000_000
    row = spark.range(1).select(F.call_function("div", F.lit(1000) * F.lit(big).cast("decimal(18,0)") * F.lit(big).cast("decimal(18,0)"),
                                                F.lit(big - 1).cast("decimal(18,0)") * F.lit(7).cast("decimal(18,0)")).alias("x"))
    assert row.first().x == 1000 * big * big // ((big - 1) * 7)


def test_empty_table_and_one_long_text(spark):
    assert run(spark, [], min_count=2) == []
    assert run(spark, [(1, None, None), (2, "", "en")], min_count=2) == []
    docs = [(1, "x y z " * 60_000, "en")]
    assert run(spark, docs, min_count=100) == expected(docs, 100, 2000)


def test_bitmap_holds_all_its_members(spark):
    rng = np.random.default_rng(1)
    numbers = rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    bits = bitmap(spark.createDataFrame([(int(x),) for x in numbers], "x bigint").repartition(3))
    assert bits.has(numbers.view(np.uint64)).all()
    others = rng.integers(-(1 << 63), (1 << 63) - 1, 100_000).view(np.uint64)
    assert bits.has(others).mean() < 0.1
    assert not bitmap(spark.createDataFrame([], "x bigint")).has(others).any()
