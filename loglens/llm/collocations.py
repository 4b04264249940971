"""Phrase collocation mining by vertically partitioned, depth-truncated suffix subtrees.

Words are 64-bit hashes that contain their language, so every count is per language. The work goes down the tree of word
prefixes: words are counted, then the two-word prefixes of words frequent enough. Below infrequent prefixes no candidate
lies, so they end a suffix. Two-word prefixes are grouped such that a group's suffixes fit a memory budget; a prefix that is over the
budget alone is extended to the full depth and spread. Each group builds its own subtree of sorted suffixes and reads the
counts of inner nodes from the totals of its leaves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.bits import bitmap
from loglens.llm.common import LOWER, mix64, prefix_sums, span_hashes, text_chunks, words_of
from loglens.operators.ordering import top_per_group
from loglens.sources.shared import materialize

UNKNOWN = "und"
DEPTH = 5
MIN_COUNT, TOP = 100, 2000
#: Suffixes of a group; grows with the input so that never more than MOST_HOT prefixes are over it.
BUDGET, MOST_HOT = 1 << 20, 1 << 16
CHUNK = 2 << 20

#: A piece ends at . , ; : ! ? and \x0A-\x0D; words end there and at blanks and tabs.
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _BREAK.copy()
_APART[[0x20, 0x09]] = True

_WORDS = [f"w{i + 1}" for i in range(DEPTH)]


def pair_name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _tokens(batch: pa.RecordBatch):
    """Per chunk of (lang, text): bytes, starts and ends of words, their hashes, rows, and if the next word is of the same piece."""
    langs = batch.column(0).dictionary_encode()
    names = langs.dictionary.to_pylist()
    salts = np.array([span_hashes(prefix_sums(x), np.array([0]), np.array([len(x)]))[0] for x in (
        np.frombuffer(n.encode(), np.uint8) for n in names)], np.uint64)[langs.indices.to_numpy()]
    for row, data, offsets in text_chunks(batch.column(1), CHUNK):
        data = LOWER[data]
        starts, ends, rows = words_of(data, offsets, _APART)
        words = pair_name(salts[row + rows], span_hashes(prefix_sums(data), starts, ends))
        words[words == 0] = 1
        piece = np.cumsum(_BREAK[data])[starts] if len(starts) else starts
        on = np.zeros(len(words), bool)
        on[:-1] = (rows[1:] == rows[:-1]) & (piece[1:] == piece[:-1])
        yield data, starts, ends, words, row + rows, on


def _lang_texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.where(F.col(text_col).isNotNull()).select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)), F.col(text_col).cast("binary"))


def word_counts(texts: DataFrame) -> DataFrame:
    """word, lang, text, n of every word."""
    def run(batches):
        for batch in batches:
            langs = batch.column(0)
            for data, starts, ends, words, rows, _ in _tokens(batch):
                found, first, n = np.unique(words, return_index=True, return_counts=True)
                view = data.tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array(found.view(np.int64)), langs.take(pa.array(rows[first])),
                    pa.array([view[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], pa.binary()).cast(pa.string()),
                    pa.array(n)], ["word", "lang", "text", "n"])

    return texts.mapInArrow(run, "word bigint, lang string, text string, n bigint").groupBy(
        "word", "lang", "text").agg(F.sum("n").alias("n"))


def _counted(hashes: np.ndarray, columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows once, with their number; rows are put side by side by hash and compared in full."""
    order = np.argsort(hashes, kind="stable")
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.diff(np.append(first, len(order)))


def _batch(columns: list[np.ndarray], n: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array(c.view(np.int64)) for c in columns], pa.array(n)], [*names, "n"])


def pair_counts(texts: DataFrame, frequent) -> DataFrame:
    """w1, w2, n of the two-word prefixes of (probably) frequent words."""
    def run(batches):
        for batch in batches:
            for _, _, _, words, _, on in _tokens(batch):
                at = np.flatnonzero(on)
                often = frequent.value.has(words)
                at = at[often[at] & often[at + 1]]
                a, b = words[at], words[at + 1]
                yield _batch(*_counted(pair_name(a, b), [a, b]), _WORDS[:2])

    return texts.mapInArrow(run, "w1 bigint, w2 bigint, n bigint").groupBy("w1", "w2").agg(F.sum("n").alias("n"))


def suffix_counts(texts: DataFrame, pairs) -> DataFrame:
    """w1..w5, n: suffixes of three words or more, cut behind DEPTH words, at the piece's end and at (probably) infrequent pairs."""
    def run(batches):
        for batch in batches:
            for _, _, _, words, _, on in _tokens(batch):
                follows = np.zeros(len(words) + DEPTH, bool)
                at = np.flatnonzero(on)
                follows[at] = pairs.value.has(pair_name(words[at], words[at + 1]))
                at = np.flatnonzero(follows[:-1] & follows[1:])
                padded = np.concatenate([words, np.zeros(DEPTH, np.uint64)])
                columns, alive, name = [words[at]], np.ones(len(at), bool), words[at].copy()
                for i in range(1, DEPTH):
                    alive &= follows[at + i - 1]
                    columns.append(np.where(alive, padded[at + i], np.uint64(0)))
                    name = pair_name(name, columns[-1])
                yield _batch(*_counted(name, columns), _WORDS)

    schema = ", ".join(f"{w} bigint" for w in _WORDS) + ", n bigint"
    return texts.mapInArrow(run, schema).groupBy(*_WORDS).agg(F.sum("n").alias("n"))


def subtree(min_count: int):
    """Inner nodes of a group's subtree: every prefix of three words or more with the total of the leaves below it.

    A group whose prefixes were extended holds parts of subtrees, so it gives all of its nodes.
    """
    names = [*_WORDS, "n"]

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        words = frame[_WORDS].to_numpy()
        order = np.lexsort(words.T[::-1])
        words, n = words[order], frame["n"].to_numpy()[order]
        least = 1 if frame["hot"].iloc[0] else min_count
        new = np.concatenate([[True], words[1:, 0] != words[:-1, 0]]) | np.concatenate([[True], words[1:, 1] != words[:-1, 1]])
        parts = []
        for depth in range(3, DEPTH + 1):
            new = new | np.concatenate([[True], words[1:, depth - 1] != words[:-1, depth - 1]])
            first = np.flatnonzero(new)
            total = np.add.reduceat(n, first)
            kept = (total >= least) & (words[first, depth - 1] != 0)
            node = words[first[kept]].copy()
            node[:, depth:] = 0
            parts.append(np.column_stack([node, total[kept]]))
        return pd.DataFrame(np.concatenate(parts), columns=names)

    return build


def phrase_counts(texts: DataFrame, pairs: DataFrame, min_count: int, budget: int) -> DataFrame:
    """words (array of hashes), n of the phrases of three to DEPTH words with at least ``min_count`` occurrences."""
    context = texts.sparkSession.sparkContext
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    budget = max(budget, -(-total // MOST_HOT))
    groups = total // budget + 1
    suffixes = suffix_counts(texts, context.broadcast(bitmap(pairs.select("w1", "w2"), pair_name)))
    # at most total / budget <= MOST_HOT prefixes
    hot = pairs.where(F.col("n") > budget).select(F.col("w1").alias("h1"), F.col("w2").alias("h2"))
    placed = suffixes.join(F.broadcast(hot), (F.col("w1") == F.col("h1")) & (F.col("w2") == F.col("h2")), "left").select(
        *_WORDS, "n", F.col("h1").isNotNull().alias("hot"),
        F.pmod(F.when(F.col("h1").isNotNull(), F.xxhash64(*_WORDS)).otherwise(F.xxhash64("w1", "w2")), F.lit(groups)).alias("group"))
    schema = ", ".join(f"{w} bigint" for w in _WORDS) + ", n bigint"
    nodes = placed.groupBy("group", "hot").applyInPandas(subtree(min_count), schema)
    return nodes.groupBy(*_WORDS).agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).select(
        F.filter(F.array(*_WORDS), lambda w: w != 0).alias("words"), "n")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP, budget: int = BUDGET,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two to five words of every language.

    a: occurrences of the phrase within pieces, overlaps included; l, r: those of its parts at the lowest-scoring cut; n: words of the language;
    score = floor(1000 a n / (l r)). Phrases that a longer candidate contains as often are left out. Null languages
    count as ``und``, null and empty texts have no words, repeated rows count as often as they occur, ids and other
    columns are not looked at. Counts are exact: words are told apart by 64 bits, and two frequent ones that share them stop the job.
    """
    spark = docs.sparkSession
    texts = _lang_texts(docs, text_col, lang_col)
    vocabulary = materialize(word_counts(texts), "words")
    sizes = materialize(vocabulary.groupBy("lang").agg(F.sum("n").alias("size")), "sizes")
    frequent = materialize(vocabulary.where(F.col("n") >= min_count), "frequent-words")
    if not frequent.groupBy("word").count().where("count > 1").isEmpty():
        raise ValueError("two frequent words share a hash")
    often = spark.sparkContext.broadcast(bitmap(frequent.select("word")))
    pairs = materialize(pair_counts(texts, often).where(F.col("n") >= min_count), "pairs")
    phrases = materialize(phrase_counts(texts, pairs, min_count, budget).unionByName(
        pairs.select(F.array("w1", "w2").alias("words"), "n")), "phrases")

    # What a longer candidate contains as often, one containing it by one word more does too.
    inner = phrases.where(F.size("words") > 2).select(F.explode(F.array(
        F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("words"), "n").distinct()
    kept = phrases.join(inner, ["words", "n"], "left_anti")

    counts = phrases.unionByName(frequent.select(F.array("word").alias("words"), "n"))
    side = lambda name: counts.select(F.col("words").alias(f"{name}_words"), F.col("n").alias(name))
    cuts = kept.select("words", F.col("n").alias("a"), F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k")).withColumns({
        "l_words": F.expr("slice(words, 1, k)"), "r_words": F.expr("slice(words, k + 1, size(words) - k)")})
    langs = frequent.select(F.col("word").alias("first"), "lang")
    parted = cuts.join(side("l"), "l_words").join(side("r"), "r_words").withColumn("first", F.col("words")[0]).join(
        langs, "first").join(sizes, "lang")
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.call_function("div", F.lit(1000) * exact("a") * exact("size"), exact("l") * exact("r"))
    lowest = materialize(parted.groupBy("words", "lang", "a", "size").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")), "scored")

    text = frequent.select("word", F.col("text"))
    spelled = lowest.select("words", F.posexplode("words").alias("at", "word")).join(text, "word").groupBy("words").agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])).alias("phrase"))
    rows = lowest.join(spelled, "words").select(
        "lang", "phrase", "a", "cut.l", "cut.r", F.col("size").alias("n"), "cut.score")
    best = top_per_group(rows, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "rank", F.col("phrase"))
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
