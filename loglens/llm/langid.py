"""Language identification as mixture inference over byte n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import text_chunks

ORDER = 3
SLOTS = 1 << 16
UNKNOWN = "und"
#: Fitting reads about so many documents of each language at most, chosen by a hash of the id.
SAMPLE_DOCS = 5_000
SMOOTHING = 0.1
EM_STEPS, REFIT_STEPS = 12, 8
_MIX = "array<struct<lang: string, share: double>>"

#: Lower-case ASCII letters and the bytes of longer characters; every other byte is a gap.
_LETTER = np.full(256, 0x20, np.uint32)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def _grams(data: np.ndarray, offsets: np.ndarray):
    """Slots of the n-grams of each row in turn; runs of gaps count once."""
    x = _LETTER[data]
    for a, b in zip(offsets[:-1], offsets[1:]):
        row = np.concatenate([[0x20], x[a:b], [0x20]]).astype(np.uint32)
        row = row[np.concatenate([[True], (row[1:] != 0x20) | (row[:-1] != 0x20)])]
        n = max(len(row) - ORDER + 1, 0)
        slots = np.zeros(n, np.uint32)
        for i in range(ORDER):
            slots = slots * np.uint32(0x9E3779B1) + row[i:i + n]
        yield ((slots * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int64)


def held_out(doc_id: "F.Column") -> "F.Column":
    """The fifth of the ids that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """Likelihoods of n-gram slots by language; probs has a row per slot."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs = langs
        probs = (counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * SLOTS)
        self.probs = np.ascontiguousarray(probs, np.float64)

    def mixture(self, slots: np.ndarray) -> list[tuple[int, float]]:
        """(language, share) of the chosen set, largest share first."""
        counts = np.bincount(slots, minlength=SLOTS)
        seen = np.flatnonzero(counts)
        weights, probs = counts[seen].astype(np.float64), self.probs[seen]
        n = weights.sum()
        shares = _em(probs, weights, np.full(len(self.langs), 1 / len(self.langs)), EM_STEPS)
        order = np.argsort(-shares, kind="stable")
        best, chosen = -np.inf, None
        for size in range(1, len(order) + 1):
            own = probs[:, order[:size]]
            start = shares[order[:size]]
            part = np.ones(1) if size == 1 else _em(own, weights, start / start.sum(), REFIT_STEPS)
            # overlapping n-grams repeat each letter ORDER times
            fit = float(weights @ np.log(own @ part)) / ORDER - 0.5 * size * np.log(n)
            if fit <= best:
                break
            best, chosen = fit, sorted(zip(order[:size].tolist(), part.tolist()), key=lambda x: (-x[1], x[0]))
        return chosen


    def surplus(self, slots: np.ndarray, mixture: list[tuple[int, float]]) -> float:
        """By how much an n-gram is likelier under the mixture than by chance: the mean of the logarithms."""
        langs, shares = (np.array(x) for x in zip(*mixture))
        return float(np.log(self.probs[slots][:, langs] @ shares).mean() + np.log(SLOTS))


def _em(probs: np.ndarray, weights: np.ndarray, shares: np.ndarray, steps: int) -> np.ndarray:
    total = weights.sum()
    shares = np.maximum(shares, 1e-12)
    for _ in range(steps):
        shares = shares * ((weights / (probs @ shares)) @ probs) / total
        shares = np.maximum(shares, 1e-12)
    return shares / shares.sum()


def _plain(text: "F.Column") -> "F.Column":
    return F.encode(F.lower(F.coalesce(text, F.lit(""))), "UTF-8")


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learn from whole texts of about SAMPLE_DOCS rows of each language; null if none has a text and a language."""
    rows = labelled.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    rate = F.create_map(*[F.lit(v) for lang in langs for v in (lang, min(1.0, SAMPLE_DOCS / sizes[lang]))])
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < rate[F.col("lang")] * 1_000_003)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for row, data, offsets in text_chunks(batch.column(0)):
                for n, slots in enumerate(_grams(data, offsets)):
                    own = sums.setdefault(names[row + n], np.zeros(SLOTS, np.int64))
                    own += np.bincount(slots, minlength=SLOTS)
        for lang, own in sums.items():
            seen = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen)), pa.array(seen, pa.int64()), pa.array(own[seen], pa.int64())],
                ["lang", "slot", "n"])

    found = (sample.select(_plain(F.col("text")), "lang").mapInArrow(count, "lang string, slot bigint, n bigint")
             .groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros((SLOTS, len(langs)))
    place = {lang: n for n, lang in enumerate(langs)}
    at = np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)
    counts[found.column("slot").to_numpy(), at] = found.column("n").to_numpy()
    return Model(langs, counts)


def mixtures(spark, text: "F.Column", model: Model | None) -> "F.Column":
    """A column: the languages of ``text`` and their shares, largest first; empty if it is null or has no letter.

    Shares come from expectation-maximisation over the likelihoods of its n-grams; languages are added in
    the order of their shares while the likelihood, penalised by half the logarithm of the number of n-grams for each, rises.
    """
    if model is None:
        return F.array().cast(_MIX)
    find = _finder(spark.sparkContext.broadcast(model))
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return F.arrow_udf(find, _MIX)(_plain(F.when(letters, text)))


def _finder(shared):
    def find(column: pa.Array) -> pa.Array:
        model = shared.value
        langs, shares, places = [], [], [0]
        for _, data, offsets in text_chunks(column):
            for n, slots in enumerate(_grams(data, offsets)):
                if len(slots) and offsets[n + 1] > offsets[n]:
                    for lang, share in model.mixture(slots):
                        langs.append(model.langs[lang])
                        shares.append(share)
                places.append(len(langs))
        kinds = [pa.field("lang", pa.string()), pa.field("share", pa.float64())]
        structs = pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(shares, pa.float64())], fields=kinds)
        return pa.ListArray.from_arrays(pa.array(places, pa.int32()), structs)

    return find


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", out_col: str = "languages") -> DataFrame:
    """``docs`` with the array of languages and shares of each row in ``out_col``; every row stays."""
    return docs.withColumn(out_col, mixtures(docs.sparkSession, F.col(text_col), model))


def recognised(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is in languages that the model knows.

    Of those with a letter, texts go whose n-grams are no likelier under their own mixture than by chance. If there was
    nothing to learn from, all with a letter stay. Texts that are null or have no letter go.
    """
    lettered = docs.where(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    if model is None:
        return lettered
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def known(column: pa.Array) -> pa.Array:
        out = []
        for _, data, offsets in text_chunks(column):
            for slots in _grams(data, offsets):
                out.append(len(slots) == 0 or shared.value.surplus(slots, shared.value.mixture(slots)) > 0)
        return pa.array(out, pa.bool_())

    return lettered.where(F.arrow_udf(known, "boolean")(_plain(F.col(text_col))))


def predictions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages of every row.

    The model learns from the rows with a text and a language whose id isn't held out. lang_pred is the language with
    the largest share and score that share; texts that are null or have no letter, and all texts if there is nothing
    to learn from, are UNKNOWN with score 0. A null id is not held out and not learnt from.
    """
    out = held_out(F.col(id_col))
    model = fit(docs.where(~out & F.col(id_col).isNotNull()), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"),
                       mixtures(docs.sparkSession, F.col(text_col), model).alias("languages"))
    first = F.try_element_at("languages", F.lit(1))
    return rows.select("doc_id", "held_out", F.coalesce(first["lang"], F.lit(UNKNOWN)).alias("lang_pred"),
                       F.coalesce(first["share"], F.lit(0.0)).alias("score"), "languages")
