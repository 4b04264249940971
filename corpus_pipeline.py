"""The corpus pipeline: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm import decontaminate, langid, lines, minhash, packing
from loglens.sources.shared import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the languages that the others teach; those without text or letters go, and those in none of them.

    If no document has both a text and a language, all with a letter stay.
    """
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    return langid.recognised(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in an earlier place; those with none of their own left go."""
    made = "lines"
    while made in docs.columns:
        made += "_"
    left = lines.deduplicated(docs, threshold=lines.QUERIED, out_col=made)
    bare = F.col(made)["n_removed"] > 0
    text = F.col(made)["text"]
    columns = [text.alias("text") if c == "text" else
               F.when(bare, F.length(text)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c)
               if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return left.where(~(bare & F.coalesce(text, F.lit("")).rlike(r"^\s*$"))).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the first by (id, hash of the text), of each group of near-duplicates; the null id is the last."""
    # the columns travel as one, so none of them can clash with those made here
    name, row, mark = "document", "row", "mark"
    each = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name), F.col("doc_id").alias("id"),
                       F.xxhash64("text").alias(mark)).dropDuplicates(["id", mark]).drop("id")
    # the rows' own numbers, in this order, so that rows that share an id or have none are judged one by one
    order = each.orderBy(F.col(name).getField("doc_id").isNull(), F.col(name)["doc_id"], mark).drop(mark)
    rows = materialize(order.withColumn(row, F.monotonically_increasing_id()), "numbered")
    judged = minhash.near_duplicates(rows.select(row, F.col(name)["text"].alias("text")), id_col=row)
    gone = judged.where("NOT kept").select(F.col("doc_id").alias(name + "gone"))
    return rows.join(gone, F.col(row) == F.col(name + "gone"), "left_anti").select(f"{name}.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with the benchmark."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, their token ids and their places in sequences."""
    parts = packing.pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.packed(parts)


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]

#: Mixture inference, MinHash components and packing are not SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; each stage's documents are stored before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
