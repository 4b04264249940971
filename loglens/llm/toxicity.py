"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon of stems gives every word a class: insult, threat, target, negation, reported speech or none. Three weighted transducers, composed into
one, read the classes of a clause: the first marks insults and threats that someone else is reported to say, the second those that
are negated, the third those aimed at somebody named before or after. The best path gives each insult or threat of the clause a factor; with
the weight of its stem that makes the clause's score. A document's score comes from the scores of its matched clauses.

Stems, their weights and the last step are learned from labelled documents; the grammar is fixed.
"""

from __future__ import annotations

from functools import lru_cache
from math import exp, inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import NOT_WORD, prefix_sums, span_hashes, text_chunks, words_of
from loglens.llm.langid import held_out
from loglens.sources.shared import materialize

#: Learning reads about so many documents of each label at most, chosen by a hash of the id.
SAMPLE_DOCS = 6_000
#: The lexicon is chosen among so many stems at most, the most telling ones of the sample.
CANDIDATES = 20_000
SHORTEST, LONGEST = 3, 12
#: A stem counts if that many toxic documents have it; documents with so many words of chosen stems need no more.
MIN_DOCS, ENOUGH = 3, 3
WINDOW = 3
CHUNK = 2 << 20
SEED_WEIGHT, MOST_WEIGHT = 3.0, 8.0

# Words of the grammar that labels can't teach, and stems to begin with.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "imbecile", "dumbass", "bastard",
           "dumm", "trottel", "abschaum", "arschloch", "connard", "abruti", "imbécile", "salaud", "estúpid", "imbécil", "gilipollas")
THREATS = ("kill", "murder", "stab", "strangle", "umbring", "töten", "tuer", "matar")
TARGETS = ("you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "euch", "tu", "toi", "vous", "votre", "tú", "usted", "vosotros")
NEGATIONS = ("not", "no", "never", "isn", "aren", "wasn", "don", "didn", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "jamás")
REPORTS = ("said", "says", "told", "wrote", "claimed", "quoted", "sagte", "sagt", "schrieb", "behauptet", "disait", "affirme", "dijo", "dice", "escribió")

_CLAUSE = np.zeros(256, bool)
_CLAUSE[[*b".,;:!?\n"]] = True

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "oITANR"
#: What being reported, negated or aimed does to the weight of an insult or threat.
REPORTED_BY, NEGATED_BY, AIMED_BY, THREAT_BY = 0.4, 0.25, 1.5, 1.5


class Transducer:
    """Arcs (state, input) -> [(output, weight, next state)]; weights add up along a path, the largest sum wins.

    Every arc reads one symbol and writes one, so the composition of two is the product of their states.
    """

    def __init__(self, arcs: dict, start, final) -> None:
        self.arcs, self.start, self.final = arcs, start, final

    def __matmul__(self, other: Transducer) -> Transducer:
        start, arcs = (self.start, other.start), {}
        todo, seen = [start], {start}
        by_state: dict = {}
        for (state, symbol), out in self.arcs.items():
            by_state.setdefault(state, []).append((symbol, out))
        while todo:
            a, b = todo.pop()
            for symbol, out in by_state.get(a, []):
                for middle, w, a2 in out:
                    for written, v, b2 in other.arcs.get((b, middle), []):
                        arcs.setdefault(((a, b), symbol), []).append((written, w + v, (a2, b2)))
                        if (a2, b2) not in seen:
                            seen.add((a2, b2))
                            todo.append((a2, b2))
        return Transducer(arcs, start, lambda s: self.final(s[0]) and other.final(s[1]))

    def best(self, symbols: str) -> list[tuple[str, float]]:
        """(output, weight) of each arc of the heaviest path; of equal ones the first."""
        reached = {self.start: (0.0, None)}
        for symbol in symbols:
            after: dict = {}
            for state, (total, way) in reached.items():
                for written, w, to in self.arcs.get((state, symbol), []):
                    if total + w > after.get(to, (-inf, None))[0]:
                        after[to] = (total + w, (way, written, w))
            reached = after
        _, way = max((x for s, x in reached.items() if self.final(s)), key=lambda x: x[0], default=(0, None))
        out = []
        while way:
            way, written, w = way
            out.append((written, w))
        return out[::-1]


_MARKED = [k + r + n for k in (INSULT, THREAT) for r in ("", "r") for n in ("", "-")]


def lexical() -> Transducer:
    """Weighs threats; all else stays."""
    return Transducer({(0, s): [(s, log(THREAT_BY) if s == THREAT else 0.0, 0)] for s in (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT)},
                      0, lambda s: True)


def reported() -> Transducer:
    """Behind a word of reporting, insults and threats of the clause are somebody else's."""
    arcs = {}
    for state in (0, 1):
        arcs |= {(state, s): [(s, 0.0, state)] for s in (OTHER, TARGET, NEGATION)}
        arcs[state, REPORT] = [(OTHER, 0.0, 1)]
    for s in (INSULT, THREAT):
        arcs[0, s] = [(s, 0.0, 0)]
        arcs[1, s] = [(s + "r", log(REPORTED_BY), 1)]
    return Transducer(arcs, 0, lambda s: True)


def negated() -> Transducer:
    """A negation reaches as far as WINDOW words."""
    arcs = {}
    for left in range(WINDOW + 1):
        on = max(left - 1, 0)
        arcs |= {(left, s): [(s, 0.0, on)] for s in (OTHER, TARGET)}
        arcs[left, NEGATION] = [(OTHER, 0.0, WINDOW)]
        for s in (k + r for k in (INSULT, THREAT) for r in ("", "r")):
            arcs[left, s] = [(s + "-", log(NEGATED_BY), on) if left else (s, 0.0, on)]
    return Transducer(arcs, 0, lambda s: True)


def aimed() -> Transducer:
    """Insults and threats within WINDOW words of a target, whichever comes first; that one will come is a guess that must come true."""
    arcs: dict = {}
    plain = [*_MARKED, OTHER]
    for left in range(WINDOW + 1):  # words that a target before still reaches
        on = max(left - 1, 0)
        arcs[left, TARGET] = [(OTHER, 0.0, WINDOW)]
        arcs[left, OTHER] = [(OTHER, 0.0, on)]
        for s in _MARKED:
            arcs[left, s] = [(s + "@", log(AIMED_BY), on)] if left else [(s, 0.0, 0), (s + "@", log(AIMED_BY), -WINDOW)]
    for wait in range(1, WINDOW + 1):  # words within which a target has to come
        arcs[-wait, TARGET] = [(OTHER, 0.0, WINDOW)]
        for s in plain if wait > 1 else []:
            arcs[-wait, s] = [(OTHER, 0.0, 1 - wait) if s == OTHER else (s + "@", log(AIMED_BY), 1 - wait)]
    return Transducer(arcs, 0, lambda s: s >= 0)


@lru_cache(maxsize=1)
def grammar() -> Transducer:
    return lexical() @ reported() @ negated() @ aimed()


@lru_cache(maxsize=100_000)
def factors(symbols: str) -> tuple[float, ...]:
    """Factors of the insults and threats of a clause, given the classes of its words."""
    return tuple(exp(w) for (_, w), s in zip(grammar().best(symbols), symbols) if s in (INSULT, THREAT))


def _hash(word: bytes) -> np.uint64:
    data = np.frombuffer(word, np.uint8)
    return span_hashes(prefix_sums(data), np.array([0]), np.array([len(data)]))[0]


class Lexicon:
    """Stems (insults and threats, with weights) and whole words of the other classes."""

    def __init__(self, stems: dict[str, tuple[str, float]]) -> None:
        self.stems = stems
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({len(s.encode()) for s in stems}):
            own = sorted((_hash(s.encode()), k, w) for s, (k, w) in stems.items() if len(s.encode()) == length)
            self.by_length[length] = tuple(map(np.array, zip(*own)))
        words = sorted((_hash(w.encode()), k) for k, all_ in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in all_)
        self.words = np.array([h for h, _ in words]), np.array([k for _, k in words])

    def read(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and weight of every word; the longest stem that it begins with counts, then the whole word."""
        sums = prefix_sums(data)
        kinds, weights = np.full(len(starts), OTHER), np.zeros(len(starts))
        names, own = self.words
        hashes = span_hashes(sums, starts, ends)
        at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
        hit = names[at] == hashes
        kinds[hit] = own[at[hit]]
        left, lengths = np.arange(len(starts)), ends - starts
        for length, (names, own, weight) in self.by_length.items():
            left = left[lengths[left] >= length]
            hashes = span_hashes(sums, starts[left], starts[left] + length)
            at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
            hit = names[at] == hashes
            kinds[left[hit]], weights[left[hit]] = own[at[hit]], weight[at[hit]]
        return kinds, weights


FEATURES = 3


def _features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Per row: score of the best clause, log of the sum of all and of the number of matched ones."""
    starts, ends, rows = words_of(data, offsets, NOT_WORD)
    kinds, weights = lexicon.read(data, starts, ends)
    out = np.zeros((len(offsets) - 1, FEATURES))
    marked = (kinds == INSULT) | (kinds == THREAT)
    if not marked.any():
        return out
    clause = np.cumsum(_CLAUSE[data])[starts] + rows
    at = np.flatnonzero((kinds != OTHER) & np.isin(clause, clause[marked]))
    kinds, weights, rows, clause = kinds[at].tolist(), weights[at].tolist(), rows[at].tolist(), clause[at].tolist()
    places, begin = at.tolist(), 0
    for i in range(1, len(at) + 1):
        if i < len(at) and clause[i] == clause[begin]:
            continue
        symbols = kinds[begin]
        for j in range(begin + 1, i):  # more words in between than the window make no difference
            symbols += OTHER * min(places[j] - places[j - 1] - 1, WINDOW + 1) + kinds[j]
        own = [w for k, w in zip(kinds[begin:i], weights[begin:i]) if k in (INSULT, THREAT)]
        score = sum(w * f for w, f in zip(own, factors(symbols)))
        row = out[rows[begin]]
        row[0] = max(row[0], score)
        row[1] += score
        row[2] += 1
        begin = i
    out[:, 1:] = np.log1p(out[:, 1:])
    return out


def features(texts: DataFrame, lexicon) -> DataFrame:
    """The columns of ``texts`` (binary last, lower-cased) but the last, and its features."""
    kept = texts.schema[:-1]
    names = [f"f{i}" for i in range(FEATURES)]

    def run(batches):
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(len(kept)), CHUNK):
                found = _features(data, offsets, lexicon.value)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(row, len(found)) for i in range(len(kept))], *[pa.array(f) for f in found.T]],
                    [*[f.name for f in kept], *names])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], *[f"{n} double" for n in names]])
    return texts.mapInArrow(run, schema)


def _stems(data: np.ndarray, offsets: np.ndarray):
    """(row, start, end) of every prefix of every word, cut between characters."""
    starts, ends, rows = words_of(data, offsets, NOT_WORD)
    inner = np.append((data & 0xC0) == 0x80, False)
    for length in range(SHORTEST, LONGEST + 1):
        at = np.flatnonzero((ends - starts >= length))
        at = at[~inner[starts[at] + length]]
        yield rows[at], starts[at], starts[at] + length


def stem_counts(sample: DataFrame) -> DataFrame:
    """stem, toxic, clean: documents of either label that have the stem, from ``sample`` (toxic, text)."""
    def run(batches):
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            for row, data, offsets in text_chunks(batch.column(1), CHUNK):
                own, sums = labels[row:row + len(offsets) - 1] > 0, prefix_sums(data)
                view = data.tobytes()
                for rows, starts, ends in _stems(data, offsets):
                    hashes = span_hashes(sums, starts, ends)
                    order = np.lexsort((hashes, rows))
                    hashes, rows, starts, ends = hashes[order], rows[order], starts[order], ends[order]
                    new = np.ones(len(order), bool)
                    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
                    hashes, rows, starts, ends = hashes[new], rows[new], starts[new], ends[new]
                    _, first, where = np.unique(hashes, return_index=True, return_inverse=True)
                    toxic = np.bincount(where, own[rows], len(first)).astype(np.int64)
                    total = np.bincount(where, minlength=len(first))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([view[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], pa.binary()).cast(pa.string()),
                        pa.array(toxic), pa.array(total - toxic)], ["stem", "toxic", "clean"])

    return sample.select("toxic", F.col("text").cast("binary")).mapInArrow(run, "stem string, toxic bigint, clean bigint").groupBy(
        "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _longest(counts: dict[str, tuple[int, int]]) -> list[str]:
    """Of stems that begin with each other and stand in (nearly) the same toxic documents, the longest."""
    out = []
    for stem in sorted(counts, key=lambda s: (-len(s), s)):
        toxic = counts[stem][0]
        if not any(s.startswith(stem) and counts[s][0] >= 0.9 * toxic for s in out):
            out.append(stem)
    return out


def _holdings(sample: DataFrame, stems: list[str]) -> dict[str, dict[int, int]]:
    """Toxic documents of the sample that have a stem, with the number of times."""
    hashes = np.array([_hash(s.encode()) for s in stems], np.uint64)
    order = np.argsort(hashes)
    hashes = hashes[order]

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, data, offsets in text_chunks(batch.column(1), CHUNK):
                sums = prefix_sums(data)
                for rows, starts, ends in _stems(data, offsets):
                    found = span_hashes(sums, starts, ends)
                    at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                    hit = hashes[at] == found
                    pairs, n = np.unique(np.column_stack([ids[row + rows[hit]], order[at[hit]]]), axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n)], ["doc", "stem", "n"])

    rows = sample.where("toxic > 0").select("doc", F.col("text").cast("binary")).mapInArrow(run, "doc bigint, stem bigint, n bigint").toArrow()
    out: dict[str, dict[int, int]] = {}
    for doc, stem, n in zip(*[rows[c].to_pylist() for c in ("doc", "stem", "n")]):
        out.setdefault(stems[stem], {})[doc] = n
    return out


def chosen(holdings: dict[str, dict[int, int]], weights: dict[str, float]) -> list[str]:
    """Stems taken one by one, the one that explains most by documents times weight first, until too few are left to explain.

    A document is explained by ENOUGH words of chosen stems; so rare words of a copied document add nothing to its insults.
    """
    words: dict[int, int] = {}
    out, left = [], dict(holdings)
    while left:
        open_ = {s: sum(words.get(d, 0) < ENOUGH for d in docs) for s, docs in left.items()}
        stem = min(left, key=lambda s: (-open_[s] * weights[s], -len(left[s]), -len(s), s))
        if open_[stem] < MIN_DOCS:
            return out
        out.append(stem)
        for doc, n in left.pop(stem).items():
            words[doc] = words.get(doc, 0) + n
        left = {s: d for s, d in left.items() if open_[s] >= MIN_DOCS and not (s.startswith(stem) or stem.startswith(s))}
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """doc, toxic, text (lower-cased) of about ``size`` labelled documents of each label; equal texts once."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").cast("bigint").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / float(1 << 31)
    taken = known.where(F.when(F.col("toxic") > 0, part < size / max(sizes.get(True, 1), 1)).otherwise(
        part < size / max(sizes.get(False, 1), 1)))
    # about 2 * size rows, whatever the number of labels
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(taken), "doc_id")
    once = texts.groupBy(F.sha2("text", 256).alias("mark")).agg(
        F.lower(F.first("text")).alias("text"), F.max("toxic").alias("toxic"))
    return materialize(once.select(F.xxhash64("mark").alias("doc"), "toxic", "text"), "toxic-sample")


def learned_lexicon(sample: DataFrame) -> Lexicon:
    """Stems that tell toxic from clean documents of the sample, and the fixed ones that it doesn't speak against."""
    counts = materialize(stem_counts(sample).where((F.col("toxic") >= MIN_DOCS) | F.col("stem").isin([*INSULTS, *THREATS])), "stems")
    size = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = size.get(True, 0), size.get(False, 0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    all_ = F.col("toxic") + F.col("clean")
    part = lambda n, share: F.when(n > 0, n * F.log(n / (all_ * share))).otherwise(0.0)
    prior = toxic / max(toxic + clean, 1)
    gain = 2 * (part(F.col("toxic"), max(prior, 1e-9)) + part(F.col("clean"), max(1 - prior, 1e-9)))
    tried = counts.where(F.col("toxic") >= MIN_DOCS).count()
    scored = counts.select("stem", "toxic", "clean", odds.alias("odds"), gain.alias("gain"))
    rows = scored.where((F.col("toxic") >= MIN_DOCS) & (F.col("odds") >= 2) & (F.col("gain") >= 2 * (log(max(tried, 1)) + 1))).orderBy(
        F.desc("gain"), "stem").limit(CANDIDATES).toArrow().to_pylist()
    weights = {r["stem"]: min(r["odds"], MOST_WEIGHT) for r in rows}
    known = {r["stem"]: r["odds"] for r in scored.where(F.col("stem").isin([*INSULTS, *THREATS])).toArrow().to_pylist()}
    stems = {s: (k, SEED_WEIGHT) for k, all_ in ((INSULT, INSULTS), (THREAT, THREATS)) for s in all_ if known.get(s, 1) > 0}
    names = _longest({r["stem"]: (r["toxic"], r["clean"]) for r in rows})
    if names:
        for s in chosen(_holdings(sample, names), weights):
            stems[s] = (THREAT if s.startswith(THREATS) else INSULT, weights[s])
    return Lexicon(stems)


def fitted(rows: np.ndarray, toxic: np.ndarray, ridge: float = 0.1, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression, the constant first; no feature may speak for a clean document."""
    x = np.column_stack([np.ones(len(rows)), rows])
    used = np.ones(x.shape[1], bool)
    for _ in range(x.shape[1]):
        beta = np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            penalty = ridge * (np.arange(x.shape[1]) > 0)
            slope = x.T @ (toxic - p) - penalty * beta
            curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty + 1e-6)
            step = np.zeros_like(beta)
            step[used] = np.linalg.solve(curve[np.ix_(used, used)], slope[used])
            beta += np.clip(step, -2, 2)
        if (beta[1:] >= 0).all():
            break
        used[1:] &= beta[1:] >= 0
    return beta


class Model:
    def __init__(self, lexicon: Lexicon, beta: np.ndarray) -> None:
        self.lexicon, self.beta = lexicon, beta


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS) -> Model:
    """Learn from labels (doc_id, toxic) of documents that aren't held out; without any, the fixed stems score alone."""
    sample = labelled_sample(docs, labels, size)
    lexicon = learned_lexicon(sample)
    spark = docs.sparkSession
    rows = features(sample.select("toxic", F.col("text").cast("binary")), spark.sparkContext.broadcast(lexicon)).toArrow()
    toxic = (rows["toxic"].to_numpy() > 0).astype(float)
    if 0 < toxic.sum() < len(toxic):
        return Model(lexicon, fitted(np.column_stack([rows[f"f{i}"].to_numpy() for i in range(FEATURES)]), toxic))
    return Model(lexicon, np.array([-2.0, 1.0, *[0.0] * (FEATURES - 1)]))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts, and those without an insult or threat, get the score of a document without a match. Repeated rows are
    scored each, a null id is not held out, other columns are not looked at.
    """
    texts = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).cast("binary").alias("text"))
    found = features(texts, docs.sparkSession.sparkContext.broadcast(model.lexicon))
    margin = F.lit(float(model.beta[0])) + sum(float(b) * F.col(f"f{i}") for i, b in enumerate(model.beta[1:]))
    scored = found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), (1 / (1 + F.exp(-margin))).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
