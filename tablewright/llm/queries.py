"""Registered queries of the training-data operators; each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import (embedding_dedup, lexical_search, license_scan, lm_scoring, nearest_lists, ngram_join, packing, quality_classifier,
                             quality_rules, sentencepiece_bpe, suffix_dedup, toxicity, whitening)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark, sf_dir):
    return license_scan.license_matches(table(spark, sf_dir, "documents"), license_scan.templates(spark))


def op2_embedding_dedup(spark, sf_dir):
    return embedding_dedup.linked_vectors(table(spark, sf_dir, "embeddings"))


def op3_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.quality_scores(docs, quality_classifier.quality_model(docs, table(spark, sf_dir, "labels")))


def op5_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.toxicity_model(docs, table(spark, sf_dir, "labels")))


def op7_sentencepiece(spark, sf_dir):
    return sentencepiece_bpe.sentencepiece_digests(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark, sf_dir):
    return lm_scoring.stupid_backoff(table(spark, sf_dir, "documents"))


def op10_lm_scoring_trigrams(spark, sf_dir):
    return lm_scoring.stupid_backoff(table(spark, sf_dir, "documents"), lm_scoring.TRIGRAMS)


def op11_lexical_search(spark, sf_dir):
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_nearest_lists(spark, sf_dir):
    return nearest_lists.nearest(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = [op1_license_scan, op2_embedding_dedup, op3_quality_rules, op4_quality_classifier, op5_packing, op6_toxicity, op7_sentencepiece,
           op8_ngram_join, op9_suffix_dedup, op10_lm_scoring, op10_lm_scoring_trigrams, op11_lexical_search, op12_nearest_lists, op13_whitening]
SQL: dict[str, str] = {"op1_license_scan": license_scan.sql(), "op10_lm_scoring": lm_scoring.SQL,
                       "op10_lm_scoring_trigrams": lm_scoring.SQL_TRIGRAMS, "op11_lexical_search": lexical_search.SQL}


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    return dict(SQL)
