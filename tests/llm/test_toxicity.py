import random
import zlib

import numpy as np
import pytest

from loglens.llm import toxicity as tx


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize("symbols, wanted", [
    ("I", [1.0]), ("AoI", [1.5]), ("IooA", [1.5]), ("IoooA", [1.0]), ("NoI", [0.25]), ("NoooI", [1.0]), ("RoooI", [0.4]),
    ("RNI", [0.1]), ("NIA", [0.375]), ("T", [1.5]), ("AT", [2.25]), ("II", [1.0, 1.0]), ("IIA", [1.5, 1.5]), ("ANIoT", [0.375, 0.375]),
    ("IoAoI", [1.5, 1.5]), ("IR", [1.0])])
def test_grammar(symbols, wanted):
    got = tx.factors(symbols)
    assert len(got) == len(wanted) and np.allclose(got, wanted)


def test_composition_equals_one_after_the_other():
    """The composed machine gives the heaviest of all ways through the single ones."""
    steps = [tx.lexical(), tx.reported(), tx.negated(), tx.aimed()]

    def ways(machine, symbols):
        todo = [(machine.start, 0.0, ())]
        for s in symbols:
            todo = [(to, w + v, (*out, o)) for at, w, out in todo for o, v, to in machine.arcs.get((at, s), [])]
        return [(w, out) for at, w, out in todo if machine.final(at)]

    rng = random.Random(3)
    for _ in range(60):
        symbols = [rng.choice("ooITANR") for _ in range(rng.randint(1, 9))]
        found = [(0.0, tuple(symbols))]
        for machine in steps:
            found = [(w + v, out) for w, s in found for v, out in ways(machine, s)]
        assert np.isclose(max(w for w, _ in found), sum(w for _, w in tx.grammar().best(symbols)))


def table(spark, seed=1, n=400, noise=()):
    """Documents of invented words; toxic ones have an inflected stem in some clauses."""
    rng = random.Random(seed)
    syllables = ["ba", "no", "ti", "re", "ou", "sé", "la", "mi"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        parts = [[word() for _ in range(rng.randint(2, 8))] for _ in range(rng.randint(2, 9))]
        for part in parts:
            if toxic and (part is parts[0] or rng.random() < 0.5):
                part[rng.randrange(len(part))] = rng.choice(["Grümpf", "zorkel"]) + rng.choice(["", "s", "en", "ige", "ös"])
        docs.append((i, rng.choice([". ", ", ", "\n"]).join(" ".join(p) for p in parts), "en", "web"))
        labels.append((i, 1, int(toxic)))
    docs += [(n, None, None, None), (n + 1, "", "en", "web"), (None, "grümpfen", None, None), docs[0], (n + 2, "12 !?.", "en", "web")]
    docs += [(n + 3 + i, t, "en", "web") for i, t in enumerate(noise)]
    return (spark.createDataFrame(docs, "doc_id bigint, text string, lang string, score string"),
            spark.createDataFrame([*labels, (n, 0, None), (None, 1, 1), (n + 1, 0, 0)], "doc_id bigint, quality int, toxic int"))


def test_held_out_documents(spark):
    docs, labels = table(spark)
    rows = tx.scores(docs, tx.fit(docs, labels)).collect()
    assert [r for r in rows if r.doc_id is not None and r.held_out != held(r.doc_id)] == []
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows) and len(rows) == 405
    judged = {r.doc_id: r for r in rows}
    wrong = [i for i in range(400) if held(i) and judged[i].predicted != int(i % 6 == 0)]
    assert len(wrong) <= 1
    assert judged[400].predicted == judged[401].predicted == judged[402].predicted == 0 and judged[None].predicted == 1
    assert not judged[None].held_out


def test_labels_of_held_out_documents_are_not_seen(spark):
    docs, labels = table(spark)
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    first, second = (sorted(map(tuple, tx.scores(docs, tx.fit(docs, x)).collect()), key=str) for x in (labels, turned))
    assert first == second


def test_learned_stems_and_clauses(spark):
    docs, labels = table(spark)
    model = tx.fit(docs, labels)
    learned = [s for s, (_, w) in model.lexicon.stems.items() if s not in (*tx.INSULTS, *tx.THREATS)]
    assert sorted(learned) == ["grümpf", "zorkel"]
    texts = ["you zorkel", "bano zorkel", "not a zorkel", "she said he is a zorkel", "you, reou zorkel", "bano reou"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    aimed, plain, negated, reported, apart, clean = [r.score for r in sorted(tx.scores(frame, model).collect())]
    assert aimed > plain == apart > reported > negated > clean


def test_rare_words_of_a_copied_document_are_no_insults(spark):
    docs, labels = table(spark)
    copies = spark.createDataFrame([(1000 + i, f"grümpf blorx quandril x{i}. zorkel. grümpf. zorkels", "en", "w") for i in range(40)],
                                   docs.schema)
    more = spark.createDataFrame([(1000 + i, 0, 1) for i in range(40)], labels.schema)
    model = tx.fit(docs.unionByName(copies), labels.unionByName(more))
    assert not any(s.startswith(("blorx", "quand")) for s in model.lexicon.stems)


def test_nothing_to_learn_from(spark):
    docs, labels = table(spark, n=20)
    model = tx.fit(docs, labels.limit(0))
    frame = spark.createDataFrame([(1, "You idiot!"), (2, "fine day")], "doc_id int, text string")
    assert [r.predicted for r in sorted(tx.scores(frame, model).collect())] == [1, 0]
    assert tx.scores(docs.limit(0), model).count() == 0
    assert tx.scores(docs.limit(0), tx.fit(docs.limit(0), labels.limit(0))).count() == 0
    assert tx.scores(docs, tx.fit(docs, labels.where("toxic = 0"))).where("predicted = 1").count() == 0


def test_long_text(spark):
    docs, labels = table(spark)
    model = tx.fit(docs, labels)
    frame = spark.createDataFrame([(1, "bano reou. " * 300_000 + "zorkel grümpf"), (2, "zorkel " * 100_000)], "doc_id int, text string")
    assert [r.predicted for r in sorted(tx.scores(frame, model).collect())] == [1, 1]
