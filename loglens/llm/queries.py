"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm import (
    collocations, decontaminate, langid, lines, minhash, oracles, outliers, packing, sentences, spelling, suffix, surrogates,
    toxicity, urls)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(_table(spark, sf_dir, "documents"))
    return packing.packed(parts.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(_table(spark, sf_dir, "documents"))


RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op3_url_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages"), RULES)


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judged(_table(spark, sf_dir, "documents"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replaced(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.deduplicated(docs, threshold=lines.QUERIED).select("doc_id", "lines_.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.deduplicated(_table(spark, sf_dir, "documents"))


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=4)


def op10_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicated(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_language_mixture, op3_url_boosting, op4_robust_outliers, op5_surrogates,
    op6_line_dedup, op7_decontamination, op8_sentence_spans, op9_circulant_minhash, op10_interval_expansion, op11_collocations, op12_spelling_variants,
    op13_toxicity)}

ORACLES: dict[str, str] = {"op11_collocations": oracles.OP11, "op12_spelling_variants": oracles.OP12}
