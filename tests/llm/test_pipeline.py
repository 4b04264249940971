"""Each stage of the pipeline against a plain version of itself."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from loglens.llm import langid, packing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, mark_ int, row_ string, gone_id_ int, lines_ string, mark int"
rng = random.Random(12)
SYLLABLES = {"en": ["the", "ing", "and", "wh", "er"], "fr": ["eau", "ou", "é", "que", "tre"]}


def prose(lang, words=60, lines=3):
    made = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words)]
    size = max(words // lines, 1)
    return "\n".join(" ".join(made[i:i + size]) for i in range(0, words, size))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), 1, "r", 2, "l", 3) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    rows = [(i, prose("en" if i % 3 else "fr"), "en" if i % 3 else "fr") for i in range(60)]
    copy = rows[4][1].split(" ")
    copy[7] = "changed"
    return rows + [(100, rows[3][1], "fr"), (101, " ".join(copy), "en"), (102, None, "en"), (103, "", None), (104, "12 ?! 3", "en"),
                   (None, prose("en"), "en"), (None, prose("fr"), None), (105, rows[7][1].replace("\n", "\nA line of its own that stands here only\n", 1), "en"),
                   (106, "Общий язык которого никто здесь не учил и не знает " * 5, None), (107, "zqxj vkpq jxzq wvzk qqjx " * 9, None)]


def test_language(spark, docs):
    frame = table(spark, docs)
    got = cp.language(spark, frame, "")
    assert got.columns == frame.columns
    gone = {i for i, t, _ in docs} - {r.doc_id for r in got.collect()}
    assert gone == {102, 103, 104, 106, 107}
    # by the definition: each n-gram's probability under the mixture, against chance
    model = langid.fit(frame.where(~langid.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    import numpy as np
    for i, text, _ in docs:
        if text and re.search(r"[^\W\d_]", text):
            data = np.frombuffer(text.lower().encode(), np.uint8)
            slots = next(langid._grams(data, np.array([0, len(data)])))
            shares = dict(model.mixture(slots))
            mean = sum(np.log(sum(model.probs[s, lang] * p for lang, p in shares.items()) * langid.SLOTS) for s in slots) / len(slots)
            assert (mean > 0) == (i not in gone)


def test_language_with_nothing_to_learn_from(spark, docs):
    frame = table(spark, [(i, t, None) for i, t, _ in docs])
    assert {r.doc_id for r in cp.language(spark, frame, "").collect()} == {i for i, t, _ in docs} - {102, 103, 104}
    assert cp.language(spark, frame.limit(0), "").count() == 0


def near(a, b, k=3):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1] <= k


def test_line_dedup(spark, docs):
    rows = [d for d in docs if d[1] and d[0] is not None and (d[0] < 12 or d[0] >= 100)]
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.line_dedup(spark, table(spark, rows), "").collect()}
    seen, wanted = [], {}
    for i, text, _ in sorted(rows):
        kept, taken = [], False
        for line in text.split("\n"):
            if len(line) >= 20:
                gone = any(abs(len(line) - len(s)) <= 3 and near(line, s) for s in seen)
                seen.append(line)
                if gone:
                    taken = True
                    continue
            kept.append(line)
        left = "\n".join(kept)
        if not taken or left.strip():
            wanted[i] = (left, len(left))
    assert got == wanted and 100 not in got and 105 in got


def test_near_dedup(spark, docs):
    rows = docs + [(5, docs[5][1], "en")]
    frame = table(spark, rows)
    got = cp.near_dedup(spark, frame, "")
    assert got.columns == frame.columns
    distinct = sorted({(i, t) for i, t, _ in rows}, key=lambda r: (r[0] is None, r[0] or 0))

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

    sets = [shingles(t) for _, t in distinct]
    group = list(range(len(distinct)))
    for a, b in combinations(range(len(distinct)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
    wanted = [distinct[i] for i in range(len(distinct)) if group[i] == i or distinct[i][0] is None and group[i] == i]
    assert sorted(((r.doc_id or -1), r.text or "") for r in got.collect()) == sorted(((i or -1), t or "") for i, t in wanted)
    assert len(wanted) < len(distinct) < len(rows)


def test_decontamination(spark, docs, tmp_path):
    item = " ".join(f"w{i} item" for i in range(15))
    swapped = item.split(" ")
    swapped[6] = swapped[11] = "x"
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [d for d in docs if d[1]][:20] + [(200, "before " + " ".join(swapped) + " after", "en"), (201, " ".join(item.split(" ")[:9]) + " other end", "en")]
    got = cp.decontamination(spark, table(spark, rows), str(tmp_path))
    words = re.findall(r"\w+", item)

    def hit(text):
        own = re.findall(r"\w+", text.lower())
        return any(sum(x == y for x, y in zip(own[i:i + 13], words[j:j + 13])) >= 11
                   for i in range(len(own) - 12) for j in range(len(words) - 12))

    assert sorted(r.doc_id or -1 for r in got.collect()) == sorted(i or -1 for i, t, _ in rows if not hit(t))
    assert hit(rows[-2][1]) and not hit(rows[-1][1])


def test_packing(spark, docs):
    rows = [d for d in docs if d[0] is not None] + [(300, "long text " * 900, "en")]
    got = cp.packing_stage(spark, table(spark, rows), "").collect()
    tokens = Tokenizer.from_file(packing.vocabulary())
    lengths = {i: len(tokens.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, _ in rows}
    for i, n in lengths.items():
        parts = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == i)
        assert sum(p[2] for p in parts) == n and [p[1] for p in parts] == [sum(q[2] for q in parts[:j]) for j in range(len(parts))]
        assert len(parts) == 1 or n > 1024
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(x[1] for x in places[:j]) for j in range(len(places))] and sum(x[1] for x in places) <= 1024


def test_stages_on_an_empty_table(spark, docs, tmp_path):
    spark.createDataFrame([(1, "a b c")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in cp.STAGES:
        assert stage(spark, table(spark, docs[:3]).limit(0), str(tmp_path)).count() == 0
