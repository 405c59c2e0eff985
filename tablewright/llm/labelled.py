"""Bounded samples of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import quoted
from tablewright.llm.shared import held_out

#: bounds of a training sample: rows of each class, and characters of a text that may be in it
PER_CLASS, MAX_CHARS = 1500, 20_000


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int,
                    per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> tuple[list[str], list[int]]:
    """Texts and 0/1 labels: at most ``per_class`` rows a class, the same for the same tables.

    Held-out ids never take part. Ids whose labels contradict each other, null labels and null or empty texts
    are left out. Only the chosen ids, at most twice ``per_class``, are broadcast.
    """
    known = (labels.select(quoted("doc_id").alias("doc_id"), quoted(label).cast("int").alias("label"))
             .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top"))
             .where("label = top").drop("top"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.where("label = 0").orderBy(*order).limit(per_class).unionByName(
        known.where("label = 1").orderBy(*order).limit(per_class))
    texts = docs.select(quoted("doc_id").alias("doc_id"), quoted("text").cast("string").alias("text"))
    texts = texts.where(F.length("text").between(1, max_chars))
    rows = texts.join(F.broadcast(some), "doc_id").orderBy(*order, "text").limit(2 * per_class).select("text", "label").collect()
    return [r.text for r in rows], [r.label for r in rows]
