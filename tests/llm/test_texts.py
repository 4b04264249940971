"""Packing, decontamination, sentences, languages, outliers, surrogates, URLs and the pipeline on small tables."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loglens.llm import decontaminate, langid, outliers, packing, sentences, surrogates, urls

SMALL = "/root/testdata/sf0.001"
EXTRA = "doc_id bigint, text string, lang string, source string, id string, length int"


def table(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", "x", 1) for i, t in docs], EXTRA)


def test_packing(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(["über", "the", "x1", "<|endoftext|>", "don't", "\n\n", "日本"], k=rng.randint(0, 90))))
            for i in range(120)] + [(None, "a"), (5, None), (6, ""), (7, "word " * 3000), (7, "word " * 3000)]
    rows = packing.pack_documents(table(spark, docs), capacity=64).collect()
    exact = Tokenizer.from_file(packing.vocabulary())
    want = Counter((i, tuple(exact.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in docs)
    whole, places = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length and r.length <= 64 and (r.piece == 0 or r.length == 64)
        places[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id].append((r.piece, r.start, tuple(ids)))
    assert {i: sum(len(p[2]) for p in ps) for i, ps in whole.items()} == {
        i: sum(n * len(t) for (j, t), n in want.items() if j == i) for i in whole}
    single = {i: sum((p[2] for p in sorted(whole[i])), ()) for i in range(120) if i not in (5, 6, 7)}
    assert all(want[i, ids] == 1 for i, ids in single.items())
    for parts in places.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    assert len(places) <= -(-sum(r.length for r in rows) // 64) + 2
    assert packing.pack_documents(table(spark, []), 64).count() == 0


def test_local_search_empties_a_bin():
    sizes = np.array([6, 5, 5, 4])
    bins = packing.local_search([[0], [1], [2, 3]], sizes, 10)
    assert len(bins) == 2 and sorted(i for b in bins for i in b) == [0, 1, 2, 3]


def test_masks_find_two_substitutions():
    for wrong in itertools.combinations(range(13), 2):
        assert any(all(p + m not in wrong for m in mask)
                   for mask in decontaminate.MASKS for p in range(13 - mask[-1])), wrong


def test_decontamination(spark):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(500)]
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(5)] + [(9, "too short"), (None, "w1 " * 20), (8, None)]
    changed = items[1][1].split()
    changed[3] = changed[12] = "other"
    docs = [(1, "x " + items[0][1].upper() + " y"), (2, " ".join(changed)), (3, " ".join(rng.choices(words, k=300))),
            (4, " ".join(items[2][1].split()[:12])), (5, None), (6, ""), (7, items[0][1] + " . " + items[3][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r[0], r[1]) for r in decontaminate.contaminated(table(spark, docs), bench).collect()}
    assert got == {(1, 0), (2, 1), (7, 0), (7, 3)}
    kept = decontaminate.decontaminated(table(spark, docs), bench)
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, 6} and kept.columns == table(spark, docs).columns
    assert decontaminate.contaminated(table(spark, docs), bench.limit(0)).count() == 0


def test_decontamination_against_all_windows(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(7)]
    items = [(i % 9, " ".join(rng.choices(words, k=rng.randint(10, 25)))) for i in range(12)] + [(50, "w0 " * 20), (51, "w0 " * 20)]
    docs = []
    for i in range(80):
        text = rng.choices(words, k=rng.randint(0, 30))
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items)[1].split()
            part = [rng.choice(words) if rng.random() < 0.1 else w for w in part[rng.randint(0, 4):]]
            at = rng.randint(0, len(text))
            text[at:at] = part
        docs.append((i, " ".join(text)))
    docs += [docs[3], (200, "W0 " * 40), (None, docs[5][1])]
    wanted = Counter()
    for doc, text in docs:
        own = text.lower().split()
        for item, body in set(items):
            b = body.split()
            for shift in range(-len(b), len(own)):
                good = [j for j in range(len(b) - 12) if j + shift >= 0 and j + shift + 13 <= len(own)
                        and sum(x == y for x, y in zip(b[j:j + 13], own[j + shift:j + shift + 13])) >= 11]
                if good:
                    first, last = good[0], good[-1] + 13
                    same = sum(b[j] == own[j + shift] for j in range(first, last))
                    wanted[doc, item, first + shift, last - first, same] += 1
    got = Counter(tuple(r) for r in decontaminate.contaminated(
        table(spark, docs).repartition(3), spark.createDataFrame(items, "item_id bigint, text string")).collect())
    assert got == wanted and len(wanted) > 60


def test_sentences(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 9))).capitalize() + "." for _ in range(25)]
    docs = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(60)] + [(100, None), (None, pool[0])]
    runs, first = {}, {}
    for i, t in sorted(((i, t) for i, t in docs if t), key=lambda d: (d[0] is None, d[0])):
        own = [s.lower().rstrip(".").split() for s in t.split(". ")] if t else []
        for a in range(len(own)):
            end = next((e for e in range(a + 2, len(own) + 1) if sum(map(len, own[a:e])) >= 16), None)
            if end:
                name = str(own[a:end])
                if first.setdefault(name, (i, a)) != (i, a):
                    runs.setdefault(i, set()).update(range(a, end))
    got = {r.doc_id: r.n_removed for r in sentences.deduplicated(table(spark, docs)).collect()}
    assert got == {i: len(runs.get(i, ())) for i, _ in docs}


def test_languages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(
        [(None, "the of and", "en"), (10**6, None, "en"), (10**6 + 1, "12 !!", None)], "doc_id bigint, text string, lang string"))
    rows = langid.predictions(more).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    unknown = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert unknown >= {10**6, 10**6 + 1} and None not in unknown
    held = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in rows) and langid.predictions(more.limit(0)).count() == 0


def test_outliers(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    docs = [(i, "\n".join(" ".join(word() for _ in range(20)) for _ in range(rng.randint(4, 9)))) for i in range(300)]
    docs += [(1000 + i, " ".join(word() + "$$$" for _ in range(90))) for i in range(20)]
    docs += [(2000, None), (2001, ""), (2002, "a b c " * 40), (2003, "x\nx\n \nx")]
    rows = {r.doc_id: r for r in outliers.judged(table(spark, docs)).collect()}
    for i, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {j + k for j in range(len(words) - 2) if windows[tuple(words[j:j + 3])] > 1 for k in range(3)}
        filled = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(filled) - len(set(filled)), len(covered))
    assert all(rows[i].kept for i in range(300)) and not any(rows[1000 + i].kept for i in range(20))
    assert not any(rows[i].kept for i in range(2000, 2004))


def test_outliers_of_a_rare_language(spark):
    """A language of 30 rows is judged by all rows, and a rare source by its language."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    prose = lambda: "\n".join(" ".join(word() for _ in range(20)) for _ in range(rng.randint(4, 9)))
    odd = lambda: " ".join(word() + "$$$" for _ in range(90))
    docs = [(i, prose(), "en", "web") for i in range(300)] + [(1000 + i, prose(), "is", "web") for i in range(30)]
    docs += [(2000 + i, prose(), "en", "rare") for i in range(10)] + [(3000 + i, prose(), None, None) for i in range(3)]
    docs += [(5000, odd(), "is", "web"), (5001, odd(), "en", "rare"), (5002, odd(), None, None), (5003, odd(), "en", "web")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], EXTRA)
    rows = {r.doc_id: r for r in outliers.judged(frame).collect()}
    assert all(r.kept and r.distance is not None for i, r in rows.items() if i < 5000)
    assert not any(rows[i].kept for i in range(5000, 5004))
    tiny = {r.doc_id: r.kept for r in outliers.judged(frame.where("doc_id BETWEEN 1000 AND 1020 OR doc_id = 5000")).collect()}
    assert not tiny.pop(5000) and all(tiny.values())
    assert outliers.judged(frame.limit(0)).count() == 0


def test_estimate_against_a_direct_one(spark):
    """The subset of smallest determinant, found directly by many random starts, gives about the same centre and distances."""
    rng = np.random.default_rng(3)
    width = outliers.Fits.width
    mix = rng.normal(size=(width, width)) * 0.3 + np.eye(width)
    good, bad = rng.normal(size=(400, width)) @ mix, rng.normal(size=(60, width)) * 0.2 + 12
    data = np.concatenate([good, bad])
    frame = spark.createDataFrame([("g", x.tolist()) for x in data], "grp string, vector array<double>")
    fit = outliers.estimates(frame).first()
    centre, inverse = np.array(fit.centres), np.array(fit.inverses).reshape(width, width)
    best = None
    for _ in range(60):
        own = data[rng.choice(len(data), width + 2, replace=False)]
        for _ in range(20):
            mean, cov = own.mean(axis=0), np.cov(own.T) + np.diag(outliers.FLOOR ** 2)
            away = np.einsum("ni,ij,nj->n", data - mean, np.linalg.inv(cov), data - mean)
            own = data[np.argsort(away)[:int(0.75 * len(data))]]
        det = np.linalg.slogdet(np.cov(own.T))[1]
        if best is None or det < best[0]:
            best = (det, own.mean(axis=0), np.cov(own.T))
    assert np.abs(centre - best[1]).max() < 0.3
    mine = np.einsum("ni,ij,nj->n", data - centre, inverse, data - centre)
    direct = np.einsum("ni,ij,nj->n", data - best[1], np.linalg.inv(best[2]), data - best[1])
    assert np.corrcoef(mine[:400], direct[:400])[0, 1] > 0.97
    assert mine[400:].min() > fit.limits[0] > mine[:400].max() * 0.7


def test_surrogates(spark):
    text = "Mail Ann.Lee@mail.example.com or ann.lee@mail.example.com, +1 (645) 555-3345, 1 645 555 3345, card 4216797744748693, 10.2.33.144."
    docs = [(1, text), (2, "Mrs. Sophia met Mr. Petrov. Sophia left."), (3, None), (4, "nothing here"), (5, text)] + [
        (10 + i, f"a{i}@b.example.org") for i in range(300)]
    rows = {r.doc_id: r for r in surrogates.replaced(table(spark, docs)).collect()}
    assert rows[3].text is None and rows[4].text == "nothing here" and rows[1].text == rows[5].text
    for secret in ("Lee", "lee@", "555-3345", "4216797744748693", "10.2.33.144"):
        assert secret not in rows[1].text
    first, second = re.findall(r"[\w.]+@[\w.]+\w", rows[1].text)
    assert first.lower() == second and second.endswith(".com") and first != second
    card = re.search(r"\d{16}", rows[1].text)[0]
    assert sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(card)) % 10 == 0
    assert "Sophia" not in rows[2].text and "Petrov" not in rows[2].text
    name = re.search(r"Mrs\. (\w+)", rows[2].text)[1]
    assert name.endswith("a") and rows[2].text.count(name) == 2
    made = [rows[10 + i].text for i in range(300)]
    assert len(set(made)) == 300 and not set(made) & {f"a{i}@b.example.org" for i in range(300)}


def test_names_of_people(spark):
    docs = [(1, "Dr John Smith came. Mr Smith left. Later John Smith and Smith, O'Smith, Smithson."),
            (2, "Mr Petrov and Mrs Petrov met Frau Anna Klein; Anna spoke."), (3, "Mrs Smith, Monsieur Jean-Luc Roux. Jean-Luc!"),
            (4, "Госпожа Анна Иванова и Господин Иван Орлов. Орлов, Анна."), (5, "John Smith without a title"),
            (6, "Mr An. An An Ant."), (7, "SSN 123-45-6789 and 123-45-6789, IBAN DE89 3704 0044 0532 0130 00.")]
    docs += [(100 + i, f"Mr X{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(200)]
    rows = {r.doc_id: r for r in surrogates.replaced(table(spark, docs)).collect()}
    john, smith = re.match(r"Dr (\w+) (\w+) came", rows[1].text).groups()
    assert rows[1].text == f"Dr {john} {smith} came. Mr {smith} left. Later {john} {smith} and {smith}, O'Smith, Smithson."
    assert john != smith and {john, smith}.isdisjoint({"John", "Smith"})
    petrov, anna, klein = re.match(r"Mr (\w+) and Mrs \1 met Frau (\w+) (\w+);", rows[2].text).groups()
    assert rows[2].text.endswith(f"; {anna} spoke.") and anna.endswith("a") and "Anna" not in rows[2].text
    # a surname of a man and a woman has no gender of its own
    assert rows[3].text.startswith(f"Mrs {smith}, Monsieur ")
    first = re.search(r"Monsieur (\S+) ", rows[3].text)[1]
    assert rows[3].text.endswith(f" {first}!") and first[4] == "-" and first[-1] not in "aeiou"
    female, of_woman, male, of_man = re.match(r"Госпожа (\w+) (\w+) и Господин (\w+) (\w+)\. \4, \1\.$", rows[4].text).groups()
    assert female[-1] == of_woman[-1] == "а" and male[-1] not in "аеиоуя" and of_man[-1] not in "аеиоуя"
    assert rows[5].text == docs[4][1]
    an = re.match(r"Mr (\w+)\. \1 \1 Ant\.$", rows[6].text)[1]
    assert an != "An"
    ssn, iban = re.match(r"SSN ([\d-]+) and \1, IBAN (DE.*)\.$", rows[7].text).groups()
    assert ssn != "123-45-6789" and re.fullmatch(r"\d{3}-\d{2}-\d{4}", ssn) and re.fullmatch(r"DE\d{2}( \d{4}){4} \d{2}", iban)
    plain = iban.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 and plain != "DE89370400440532013000"
    made = [rows[100 + i].text for i in range(200)]
    assert len(set(made)) == 200 and not set(made) & {t for _, t in docs}
    assert surrogates.replaced(table(spark, docs).limit(0)).count() == 0


def test_urls(spark):
    rules = {"org/": "allow", "example.org/es/": "block", "com/de/": "block"}
    pages = [(1, "HTTP://WWW.Example.ORG/es/1?x=1"), (2, "http://a.com/de/x"), (3, "http://a.com#/de/"), (4, None), (5, "no host"),
             (6, "http://notexample.org"), (None, "x://org/é://b"), (7, "http://b.example.org/en/"), (7, "http://b.example.org/en/")]
    frame = spark.createDataFrame([(i, u, "h", "r") for i, u in pages], "page_id bigint, url string, host string, rule string")
    rows = urls.judged(frame, rules).collect()
    got = sorted(((r[0] or 0), r[1], r[2], r[3]) for r in rows if r[3])
    assert got == [(0, "org", "/é://b", "org/"), (1, "www.example.org", "/es/1", "example.org/es/"),
                   (2, "a.com", "/de/x", "com/de/"), (7, "b.example.org", "/en/", "org/"), (7, "b.example.org", "/en/", "org/")]
    assert sorted((r[0], r[1], r[2]) for r in rows if not r[3]) == [
        (3, "a.com", ""), (4, "", ""), (5, "", ""), (6, "notexample.org", "")]
    assert {r.verdict for r in rows} <= {"allow", "block"} and urls.judged(frame.limit(0), rules).count() == 0


def urls_with_labels(spark, n, seed):
    """Blocked URLs are long, deep, full of digits, and mostly of one suffix."""
    rng = random.Random(seed)
    letters = lambda k: "".join(rng.choices("abcdefghijklmnop", k=k))
    rows = []
    for i in range(n):
        bad = i % 2
        host = f"{letters(5)}{rng.randrange(100, 999) if bad else ''}.{'biz' if bad == (rng.random() < 0.9) else 'edu'}"
        path = "/".join(letters(6) + (str(rng.randrange(10**6)) if bad else "") for _ in range(rng.randint(3, 6) if bad else rng.randint(1, 2)))
        query = "?" + "&".join(f"{letters(2)}={rng.randrange(10**5)}" for _ in range(rng.randint(2, 5))) if bad else ""
        rows.append((f"http://{host}/{path}{query}", host, "/" + path, i, bad))
    return spark.createDataFrame(rows, "url string, host string, path string, row_ long, label int")


def test_trees_on_held_out_urls(spark):
    model = urls.fit(urls_with_labels(spark, 400, 1))
    held = model.scored(urls_with_labels(spark, 200, 2)).collect()
    assert sum((r.score >= 0.5) == bool(r.label) for r in held) >= 190


def test_domains_are_counted_over_all_labels(spark, monkeypatch):
    monkeypatch.setattr(urls, "SAMPLE_URLS", 60)
    labelled = urls_with_labels(spark, 400, 3)
    counts = {r.suffix: r.n for r in labelled.groupBy(F.substring_index("host", ".", -1).alias("suffix")).agg(F.count("*").alias("n")).collect()}
    rates = urls.fit(labelled).rates["suffix"].where("fold = 2").collect()
    assert {r.suffix: round(np.expm1(r.suffix_count)) for r in rates} == counts


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = corpus_pipeline.run(spark, SMALL)
    assert 0 < rows.select("doc_id").distinct().count() < docs.count()
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_every_run_of_sentences(spark):
    rng = random.Random(8)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.choice([1, 3, 7, 9]))).capitalize() + "." for _ in range(25)]
    pool += [" ".join(rng.choices("abcdefgh", k=n)).capitalize() + "." for n in (49, 50, 51)]
    docs = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(80)] + [(100, None), (None, pool[0])]
    tail = ["One two three four five six seven eight nine ten.", "One two three four five six seven.", "A b.", "C d."]
    docs += [(200, " ".join([*tail, "Here it goes on in a way of its own."])), (201, " ".join([*tail, "There it ends in some other way."]))]
    docs += [(300 + i, f"Own {i}. " + "word " * 59 + f"end. Mine {i}.") for i in range(2)]
    runs, first = defaultdict(set), {}
    for i, t in sorted(((i, t) for i, t in docs if t), key=lambda d: (d[0] is None, d[0])):
        own = [s.lower().rstrip(".").split() for s in t.split(". ")]
        for a in range(len(own)):
            for e in range(a + 1, len(own) + 1):
                if sum(map(len, own[a:e])) >= (16 if e - a >= 2 else 50):
                    if first.setdefault(str(own[a:e]), (i, a)) != (i, a):
                        runs[i].update(range(a, e))
    got = {r.doc_id: r.n_removed for r in sentences.deduplicated(table(spark, docs)).collect()}
    assert got == {i: len(runs.get(i, ())) for i, _ in docs}
    assert got[201] == 4 and got[301] == 1
