import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loglens.llm import spelling as sp


def runs(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(docs):
    words, out = runs(docs), []
    forms = {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        forms[w] = form
        out.append([w, n, len(near), form, words[form] if form else None])
    for row in out:
        root = row[0]
        while forms[root]:
            root = forms[root]
        row.append(root)
    return sorted(map(tuple, out))


def made(seed, n=120):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abéÉ") for _ in range(rng.randint(4, 7))) for _ in range(12)]
    docs = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 30)):
            w = rng.choice(base[:rng.randint(1, 12)])
            for _ in range(rng.choice([0, 0, 1, 2])):
                p = rng.randrange(len(w) + 1)
                w = rng.choice([w[:p] + rng.choice("abcÉ") + w[p:], w[:p] + w[p + 1:], w[:p] + rng.choice("bé") + w[p + 1:]]) or "a"
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i % 80, rng.choice([" ", "1", "-", "Ā", "č"]).join(words)))
    return docs + [(None, "aaaaa aaaab aaaab"), (None, "aaaaa aaaab aaaab"), (7, None), (8, ""), docs[2], docs[2],
                   (3, ("x" * 300 + " ") * 3 + ("x" * 301 + " ") * 7)]


def run(spark, docs, **options):
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, n int, word string").repartition(4)
    return sorted(tuple(r) for r in sp.variants(frame, **options).collect())


@pytest.mark.parametrize("seed, symbols", [(1, None), (2, 2), (3, 13)])
def test_against_all_pairs(spark, seed, symbols):
    docs = made(seed)
    got = run(spark, docs, symbols=symbols)
    assert got == expected(docs)
    assert sum(r[2] > 0 for r in got) > 20 and any(r[5] not in (r[0], r[3]) for r in got)


def test_no_table_of_words_is_broadcast(spark, conf, monkeypatch):
    """Whatever Spark takes their sizes for; a neighbourhood has many more rows than the words it is planned from."""
    conf(spark__sql__autoBroadcastJoinThreshold="1g", spark__sql__adaptive__enabled="false")
    plans, stored = [], sp.materialize

    def plan(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())

    def materialize(frame, name):
        plan(frame)
        return stored(frame, name)

    monkeypatch.setattr(sp, "materialize", materialize)
    docs = spark.createDataFrame(made(4), "doc_id bigint, text string")
    near = sp.near_pairs(sp.words(docs, "doc_id", "text").select("word"))
    plan(near)
    result = sp.variants(docs)
    plan(result)
    joins = [line for p in plans for line in p.splitlines() if "Join" in line]
    assert len(joins) >= 6 and all("SortMergeJoin" in line for line in joins)
    assert not any("BroadcastExchange" in p for p in plans)
    assert sorted(tuple(r) for r in result.collect()) == expected(made(4))


def test_empty_tables(spark):
    assert run(spark, []) == [] == run(spark, [(1, None), (2, "ab cd")])


def test_checksums_are_those_of_the_whole_run():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé") for _ in range(rng.choice([1, 5, 63, 64, 65, 200]))).encode() for _ in range(200)]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    seeds = np.array([zlib.crc32(f"{i}:".encode()) for i in range(200)], np.uint32)
    got = sp._checksums(seeds, data, ends - [len(w) for w in words], ends)
    assert got.tolist() == [zlib.crc32(f"{i}:".encode() + w) for i, w in enumerate(words)]


def test_a_reduced_word_meets_every_word_one_edit_away():
    """The generated names are those of the reduced words that an edit of the reduced word gives, and all of them."""
    import pyarrow as pa
    symbols = 3
    batch = pa.RecordBatch.from_arrays([pa.array(["abca", "éé", "zabcdz"])], ["word"])
    for part, own, lengths, sums in sp._blocks(batch, symbols):
        found = {}
        for at, names in sp._neighbourhood(own, lengths, sums, symbols):
            for i, name in zip(at.tolist(), names.tolist()):
                found.setdefault(i, set()).add(name)
        for i, length in enumerate(lengths.tolist()):
            w = tuple(own[i, :length].tolist())
            edits = {w} | {w[:p] + w[p + 1:] for p in range(length)} | {
                w[:p] + (s,) + w[p + k:] for k in (0, 1) for p in range(length + 1 - k) for s in range(1, symbols + 1)}
            wanted = set()
            for e in edits:
                total = sum(s * pow(0x9E3779B97F4A7C15, p, 1 << 64) for p, s in enumerate(e)) % (1 << 64)
                wanted.add(int(sp._named(np.array([total], np.uint64), np.array([len(e)]))[0]))
            assert found[i] == wanted
