"""From raw documents to packed sequences: quality, toxicity, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of the documents; the last returns the pieces of the sequences. Texts that lose passages keep their row,
with ``n_chars`` counted again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import ngram_join, packing, quality_rules, suffix_dedup, toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def civility(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; learned from the labels of the documents that are here."""
    return toxicity.keep_civil(docs, toxicity.toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id; of rows with that id, one."""
    lost = ngram_join.near_duplicate_rows(docs).where(~F.col("stands")).select(F.col("doc_id").alias("lost_id"), F.col("body").alias("lost_body")).distinct()
    gone = (docs["doc_id"] == F.col("lost_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("lost_body"))
    return docs.join(lost, gone, "left_anti").select(*docs.columns).dropDuplicates(["doc_id", "text"])


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out."""
    cut = suffix_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.packed(docs)


STAGES = [("quality rules", quality), ("toxicity", civility), ("n-gram Jaccard join", near_duplicates),
          ("suffix-array dedup", passages), ("packing", packed)]

#: the learned toxicity model and the tokenizer have no SQL form; each stage is tested against a plain version instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
