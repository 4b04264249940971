"""Quality rules: robust multivariate outliers per language and source.

Text statistics are transformed to a vector; of each group the minimum-covariance-determinant estimate of centre and covariance is
found by concentration steps over all of its rows, and rows too far from the centre by Mahalanobis distance are rejected.
Each step is two passes over the vectors: one counts distances by bins, from which every group's limit follows, and
one sums the moments of the rows within it. Groups stay in tables; a pass pre-aggregates
in its task, so a group of any size sends a few rows per task.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import WHITE, mix64, prefix_sums, span_hashes, text_chunks, words_of
from loglens.sources.shared import materialize

VECTOR = ("word_length", "log_words", "symbols", "repeated_lines", "repeated_words", "capitals", "punctuation")
#: Standard deviations below which differences mean nothing.
FLOOR = np.array([0.05, 0.2, 0.05, 0.2, 0.1, 0.05, 0.05])
SHARE = 0.75
STEPS = 3
MIN_ROWS = 100
#: The group of all rows; names of the others are JSON objects.
ALL_ROWS = "all"
REJECT = 1 - 1e-6
_BINS, _PER_DOUBLING = 256, 8

_WS = bytes(np.flatnonzero(WHITE).astype(np.uint8))
_INNER = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_PUNCT = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())


def _repeat_words(data: np.ndarray, offsets: np.ndarray):
    """Number of words of each row, and of those in 3-word windows that its text has twice or more."""
    starts, ends, rows = words_of(data, offsets, WHITE)
    words = span_hashes(prefix_sums(data), starts, ends)
    n = max(len(words) - 2, 0)
    names = mix64(rows[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for i in range(3):
        names = mix64(names * np.uint64(0x2545F4914F6CDD1D) + words[i:i + n])
    at = np.flatnonzero(rows[:n] == rows[2:2 + n])
    order = at[np.argsort(names[at], kind="stable")]
    same = names[order[1:]] == names[order[:-1]]
    twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[twice + i] = True
    size = len(offsets) - 1
    return np.bincount(rows, minlength=size), np.bincount(rows[covered], minlength=size)


def _of_text(text: bytes) -> tuple[int, int, int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, lines with a word, capitals, punctuation."""
    count = lambda b: len(text) - len(text.translate(None, b))
    seen, repeated, filled = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip(_WS):
            filled += 1
            repeated += line in seen
            seen.add(line)
    return len(text.translate(None, _WS + _INNER)), count(_SYMBOLS), repeated, filled, count(_UPPER), count(_PUNCT)


def statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """id, lang, source, the counts of each whole text and its vector."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = ("id bigint, lang string, source string, " + ", ".join(f"{n} bigint" for n in names) + ", vector array<double>")

    def run(batches):
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(3)):
                size = len(offsets) - 1
                words, repeats = _repeat_words(data, offsets)
                view = data.tobytes()
                rest = np.array([_of_text(view[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], np.int64).reshape(size, 6)
                chars, symbols, lines, filled, capitals, punctuation = rest.T
                part = lambda x, of: np.arcsin(np.sqrt(np.clip(x / np.maximum(of, 1), 0, 1)))
                vector = np.column_stack([
                    np.log(np.maximum(chars, 1) / np.maximum(words, 1)), np.log(np.maximum(words, 1)),
                    part(symbols, chars), part(lines, filled), part(repeats, words), part(capitals, chars),
                    part(punctuation, chars)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(row, size) for i in range(3)]
                    + [pa.array(x.astype(np.int64)) for x in (words, chars, symbols, lines, repeats)]
                    + [pa.ListArray.from_arrays(np.arange(0, vector.size + 1, len(VECTOR), dtype=np.int32), vector.ravel())],
                    ["id", "lang", "source", *names, "vector"])

    return docs.select(
        F.col(id_col).cast("bigint"), F.col(lang_col).cast("string"), F.col(source_col).cast("string"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary")).mapInArrow(run, schema)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Fits:
    """The estimates of one group: per start a centre, the inverse covariance, its log determinant and a limit."""

    width = len(VECTOR)
    schema = "grp string, centres array<double>, inverses array<double>, logdets array<double>, limits array<double>"

    @classmethod
    def row(cls, grp: str, fits: list[tuple[np.ndarray, np.ndarray]], limits=None) -> pd.DataFrame:
        covs = [c + np.diag(FLOOR ** 2) for _, c in fits]
        return pd.DataFrame({
            "grp": [grp], "centres": [np.concatenate([m for m, _ in fits])],
            "inverses": [np.concatenate([np.linalg.inv(c).ravel() for c in covs])],
            "logdets": [np.array([np.linalg.slogdet(c)[1] for c in covs])],
            "limits": [np.full(len(fits), np.inf) if limits is None else limits]})


def _by_group(batch: pa.RecordBatch):
    """Per group of a batch of (grp, vector, centres, inverses, limits): name, vectors, squared distances by start, limits."""
    width = Fits.width
    codes = batch.column(0).dictionary_encode()
    names, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy()
    vectors = _vectors(batch.column(1), width)
    for n, name in enumerate(names):
        at = np.flatnonzero(codes == n)
        first = int(at[0])
        centres = np.array(batch.column(2)[first].as_py()).reshape(-1, width)
        inverses = np.array(batch.column(3)[first].as_py()).reshape(-1, width, width)
        own = vectors[at]
        away = own[None] - centres[:, None]
        yield name, at, own, np.einsum("sni,sij,snj->sn", away, inverses, away), batch.column(4)[first].as_py()


def _bin(distance: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(distance, 1e-9)) * _PER_DOUBLING + _BINS / 2, 0, _BINS - 1).astype(np.int64)


def _edge(bin_: int) -> float:
    return float(2.0 ** ((bin_ + 1 - _BINS / 2) / _PER_DOUBLING))


def _limited(rows: DataFrame, fits: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """grp, start, edges: per group and start the squared distances within which these shares of the rows lie."""
    def count(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, _, _, distance, _ in _by_group(batch):
                for start, d in enumerate(distance):
                    own = sums.setdefault((name, start), np.zeros(_BINS, np.int64))
                    own += np.bincount(_bin(d), minlength=_BINS)
        for (name, start), own in sums.items():
            seen = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(seen)), pa.array([start] * len(seen), pa.int32()), pa.array(seen), pa.array(own[seen])],
                ["grp", "start", "bin", "n"])

    counts = _joined(rows, fits).mapInArrow(count, "grp string, start int, bin bigint, n bigint").groupBy(
        "grp", "start", "bin").agg(F.sum("n").alias("n"))

    def edges(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bin")
        upto = frame["n"].cumsum().to_numpy()
        found = [_edge(int(frame["bin"].iloc[int(np.searchsorted(upto, np.ceil(s * upto[-1])))])) for s in shares]
        return pd.DataFrame({"grp": [frame["grp"].iloc[0]], "start": [frame["start"].iloc[0]], "edges": [found]})

    return counts.groupBy("grp", "start").applyInPandas(edges, "grp string, start int, edges array<double>")


def _joined(rows: DataFrame, fits: DataFrame) -> DataFrame:
    return rows.select("grp", "vector").join(fits, "grp").select("grp", "vector", "centres", "inverses", "limits")


def _moments(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """New estimates from the rows within the limits."""
    width = Fits.width

    def add(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, _, own, distance, limits in _by_group(batch):
                for start, (d, limit) in enumerate(zip(distance, limits)):
                    inner = np.column_stack([np.ones(len(own)), own])[d <= limit]
                    sums[name, start] = sums.get((name, start), 0) + inner.T @ inner
        for (name, start), total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([start], pa.int32()), pa.array([total.ravel().tolist()])], ["grp", "start", "sums"])

    parts = _joined(rows, fits).mapInArrow(add, "grp string, start int, sums array<double>")
    total = parts.groupBy("grp", "start").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range((width + 1) ** 2)])

    def update(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("start")
        fits = []
        for sums in frame[[f"s{i}" for i in range((width + 1) ** 2)]].to_numpy().reshape(-1, width + 1, width + 1):
            mean = sums[0, 1:] / sums[0, 0]
            fits.append((mean, sums[1:, 1:] / sums[0, 0] - np.outer(mean, mean)))
        return Fits.row(frame["grp"].iloc[0], fits)

    return total.groupBy("grp").applyInPandas(update, Fits.schema)


def _with_limits(fits: DataFrame, limits: DataFrame) -> DataFrame:
    lists = limits.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "edges"))), lambda x: x["edges"][0]).alias("limits"))
    return fits.drop("limits").join(lists, "grp").select("grp", "centres", "inverses", "logdets", "limits")


def _quantile(p: float) -> float:
    """Of the chi-square distribution with a degree of freedom per entry of the vector (Wilson and Hilferty)."""
    k = len(VECTOR)
    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * (2 / (9 * k)) ** 0.5) ** 3


def estimates(rows: DataFrame, steps: int = STEPS, share: float = SHARE) -> DataFrame:
    """Per group of rows (grp, vector): the reweighted estimate, with the scale that its median distance should have.

    Starts are the medians with quartile spreads, and two subsets of rows chosen by a hash. After the concentration
    steps the start with the smallest determinant stays; rows within the 97.5 % distance of it give the final estimate.
    """
    width = Fits.width
    middle = [F.percentile_approx(F.col("vector")[i], [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(width)]

    def begin(frame: pd.DataFrame) -> pd.DataFrame:
        q = np.array([list(frame[f"q{i}"].iloc[0]) for i in range(width)])
        return Fits.row(frame["grp"].iloc[0], [(q[:, 1], np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2))])

    first = materialize(rows.groupBy("grp").agg(*middle).groupBy("grp").applyInPandas(begin, Fits.schema), "mcd-start")
    # two more starts: the moments of two small subsets
    picks = [_moments(rows.where(F.pmod(F.xxhash64("vector"), F.lit(8)) == n), first) for n in range(2)]
    fits = first
    for pick in picks:
        more = pick.select("grp", *[F.col(c).alias(f"x_{c}") for c in ("centres", "inverses", "logdets", "limits")])
        fits = fits.join(more, "grp", "left").select("grp", *[F.concat(
            c, F.coalesce(f"x_{c}", F.array().cast("array<double>"))).alias(c) for c in ("centres", "inverses", "logdets", "limits")])
    fits = materialize(fits, "mcd")
    for _ in range(steps):
        near = materialize(_with_limits(fits, _limited(rows, fits, (share,))), "mcd-limits")
        fits = materialize(_moments(rows, near), "mcd")
    fits = materialize(_best(fits), "mcd")
    edges = _limited(rows, fits, (0.5,)).select("grp", F.array(F.greatest(
        F.col("edges")[0] / _quantile(0.5), F.lit(1.0)) * _quantile(0.975)).alias("limits"))
    near = materialize(fits.drop("limits").join(edges, "grp").select("grp", "centres", "inverses", "logdets", "limits"), "mcd-limits")
    final = materialize(_moments(rows, near), "mcd")
    scale = _limited(rows, final, (0.5,)).select(
        "grp", F.array(F.greatest(F.col("edges")[0] / _quantile(0.5), F.lit(1.0)) * _quantile(REJECT)).alias("limits"))
    return materialize(final.drop("limits").join(scale, "grp").select("grp", "centres", "inverses", "logdets", "limits"), "mcd")


def _best(fits: DataFrame) -> DataFrame:
    w = Fits.width
    at = F.array_position("logdets", F.array_min("logdets")).cast("int") - 1
    return fits.select("grp", F.slice("centres", at * w + 1, w).alias("centres"),
                       F.slice("inverses", at * w * w + 1, w * w).alias("inverses"),
                       F.slice("logdets", at + 1, 1).alias("logdets"), F.slice("limits", at + 1, 1).alias("limits"))


def judged(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance of every row.

    A row is kept unless it fails the base rules or lies beyond its group's limit. Groups are languages and sources; rows of those
    of fewer than MIN_ROWS rows past the base rules are judged by the estimate over all rows of their language, and where that has as few,
    by the one over all rows. So every row past the base rules is judged, however rare its language. Null
    languages and sources are values of their own, null texts have no words, repeated rows count as often as they occur.
    """
    counted = statistics(docs, id_col, text_col, lang_col, source_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stored = materialize(counted.withColumn("base_failed", failed), "statistics")
    sizes = stored.where("NOT base_failed").groupBy("lang", "source").count()
    pools = sizes.groupBy("lang").agg(F.sum("count").alias("pool")).withColumnRenamed("lang", "l")
    own, of_lang = F.to_json(F.struct("lang", "source")), F.to_json(F.struct("lang"))
    named = materialize(sizes.join(pools, F.col("lang").eqNullSafe(F.col("l"))).select(
        F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.when(F.col("count") >= MIN_ROWS, own).when(
            F.col("pool") >= MIN_ROWS, of_lang).otherwise(F.lit(ALL_ROWS)).alias("grp")), "groups")
    placed = materialize(stored.join(named, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(
        F.col("g_source")), "left").drop("g_lang", "g_source"), "grouped")
    # a row stands for its own group, and for the wider ones that rare groups are judged by
    wide = named.where(F.col("grp") == F.to_json(F.struct(F.col("g_lang").alias("lang")))).select(
        F.col("grp").alias("w_grp"), F.col("g_lang").alias("w_lang")).distinct()
    usable = placed.where("NOT base_failed")
    narrow = usable.where(F.col("grp") == own).select("grp", "vector")
    by_lang = usable.join(wide, F.col("lang").eqNullSafe(F.col("w_lang"))).select(F.col("w_grp").alias("grp"), "vector")
    rows = narrow.unionByName(by_lang)
    if not named.where(F.col("grp") == ALL_ROWS).isEmpty():
        rows = rows.unionByName(usable.select(F.lit(ALL_ROWS).alias("grp"), "vector"))
    fits = estimates(materialize(rows, "mcd-rows"))
    d = [F.col("vector")[i] - F.col("centres")[i] for i in range(Fits.width)]
    squared = sum(d[i] * d[j] * F.col("inverses")[i * Fits.width + j] for i in range(Fits.width) for j in range(Fits.width))
    scored = placed.join(fits.select("grp", "centres", "inverses", F.col("limits")[0].alias("limit")), "grp", "left")
    return scored.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(squared <= F.col("limit"), F.lit(True))).alias("kept"),
        (squared / F.col("limit")).alias("distance"))
