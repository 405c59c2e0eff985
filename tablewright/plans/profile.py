"""Dataset profile and the data-quality reports computed from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import (CATEGORICAL, DATETIME, NUMERIC, as_double, categorical_columns, is_missing,
                                           kind_of, numeric_columns, quoted, schema_frame, stats_rows)
from tablewright.functions.labels import display_round, quality_rating
from tablewright.operators.categories import top_values
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.summary import (QUARTILES, distinct_counts, duplicate_rows, null_counts, text_lengths,
                                           type_counts, value_table)


def profile(df: DataFrame, approximate_distinct: bool = False) -> DataFrame:
    """One row per column: kind, nulls, distinct values, moments and quartiles.

    Scans of the input: one for counts and moments, one for distinct values, two
    narrow ones (numeric columns only) for exact quartiles. Nothing but per-column
    rows is joined.
    """
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}

    def stats(d: DataFrame, c: str) -> list[Column]:
        v = as_double(d, c) if kinds[c] == NUMERIC else F.lit(None).cast("double")
        nulls = F.count_if(is_missing(d, c))
        return [F.count(F.lit(1)).alias("n_rows"), nulls.alias("nulls"),
                F.try_divide(nulls * 100.0, F.count(F.lit(1))).alias("null_pct"),
                F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")]

    out = F.broadcast(schema_frame(df)).join(stats_rows(df, df.columns, stats), "column")
    out = out.join(F.broadcast(distinct_counts(df, approximate=approximate_distinct)), "column", "left")
    numeric = numeric_columns(df)
    if numeric:
        quartiles = exact_quantiles(df, numeric, QUARTILES).drop("n")
        out = out.join(F.broadcast(quartiles), "column", "left")
    else:
        for q in QUARTILES:
            out = out.withColumn(q, F.lit(None).cast("double"))
    return out.select("position", "column", "dtype", "kind", "n_rows", "nulls", "null_pct", "n_unique",
                      "mean", "std", "min", "q25", "median", "q75", "max")


def profile_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, columns by kind, repeated rows, completeness."""
    kinds = type_counts(df)
    filled = null_counts(df).agg(F.sum("nulls").alias("missing_cells"), F.sum("n_rows").alias("cells"))
    return (duplicate_rows(df).crossJoin(F.broadcast(filled)).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        *[F.lit(kinds[k]).cast("bigint").alias(f"{k}_columns") for k in (NUMERIC, CATEGORICAL, DATETIME)],
        "duplicate_rows", ((1 - F.try_divide(F.col("missing_cells"), F.col("cells"))) * 100).alias("completeness_pct")))


def profile_top_values(df: DataFrame, k: int = 10) -> DataFrame:
    return top_values(df, k, categorical_columns(df))


# -- target column -------------------------------------------------------------------

# fixed values: the names a target column is recognised by
KEYWORDS = ["target", "label", "class", "outcome", "y"]
COMMON_NAMES = ["target", "label", "class", "y", "outcome", "result", "status"]
# the names that are looked for anywhere in a column name
NAME_PARTS = ["target", "label", "class", "category", "y", "outcome", "result", "status", "type", "response", "classification"]


def target_candidates(profile_rows: DataFrame, rule: str = "token") -> DataFrame:
    """(column, score, position, reason): one row per hint, strongest first.

    ``rule='token'`` matches whole name parts, ``'substring'`` any occurrence (then the
    keyword "y" matches nearly every name).
    """
    name = F.lower("column")
    if rule == "substring":
        keyword = F.lit(False)
        for k in KEYWORDS:
            keyword = keyword | name.contains(k)
    else:
        keyword = F.arrays_overlap(F.split(name, "[^a-z0-9]+"), F.array(*[F.lit(k) for k in KEYWORDS]))
    n = F.col("n_unique")
    low_category = (F.col("kind") == CATEGORICAL) & n.between(2, 20)
    hints = F.array(
        F.when(keyword, F.struct(F.lit(10).alias("score"), F.lit("name").alias("reason"))),
        F.when(n == 2, F.struct(F.lit(5).alias("score"), F.lit("binary").alias("reason"))),
        F.when(low_category, F.struct(F.lit(3).alias("score"), F.lit("low_cardinality").alias("reason"))))
    return (profile_rows.select("column", "position", F.inline(F.filter(hints, lambda h: h.isNotNull())))
            .orderBy(F.col("score").desc(), "position"))


def detect_target(profile_rows: DataFrame, rule: str = "token") -> DataFrame:
    """One row (column): the best candidate, or the last column where nothing hints at one.

    rules: ``token``, ``substring``, ``common_name`` (first column with an exact common name, else last column),
    ``cardinality`` (first column whose name holds one of the name parts; else the first column with 2–50 values that is text or has
    at most 20, and fewer values than a tenth of the rows; else last column).
    """
    last = profile_rows.select("column", F.lit(-1).alias("score"), (-F.col("position")).alias("order"))
    if rule in ("token", "substring"):
        found = target_candidates(profile_rows, rule).select("column", "score", F.col("position").alias("order"))
    else:
        named = F.lower("column").isin(COMMON_NAMES)
        if rule == "cardinality":
            for part in NAME_PARTS:
                named = named | F.lower("column").contains(part)
        found = profile_rows.where(named).select("column", F.lit(10).alias("score"), F.col("position").alias("order"))
        if rule == "cardinality":
            n = F.col("n_unique")
            fits = (n.between(2, 50) & (n < F.col("n_rows") * 0.1) & ((F.col("kind") == CATEGORICAL) | (n <= 20)))
            found = found.unionByName(profile_rows.where(fits).select(
                "column", F.lit(5).alias("score"), F.col("position").alias("order")))
    return found.unionByName(last).orderBy(F.col("score").desc(), "order").limit(1).select("column")


def problem_type(profile_rows: DataFrame, target: str, rule: str = "dashboard") -> DataFrame:
    """One row (column, n_unique, problem_type).

    ``dashboard``: text or fewer than 20 values → classification; ``suggest``: numeric and
    more than 20 values → regression.
    """
    n, numeric = F.col("n_unique"), F.col("kind") == NUMERIC
    classify = (~numeric | (n < 20)) if rule == "dashboard" else ~(numeric & (n > 20))
    return profile_rows.where(F.col("column") == target).select(
        "column", "n_unique", F.when(classify, "classification").otherwise("regression").alias("problem_type"))


# -- checks and scores ------------------------------------------------------------------

def validate(df: DataFrame, required: list[str], max_null_ratio: float = 0.5) -> DataFrame:
    """(check, column, severity, value): missing required columns are issues; sparse columns,
    constant columns and repeated rows are warnings. An empty result is a clean table."""
    spark = df.sparkSession
    gone = [(c,) for c in required if c not in df.columns]
    missing = spark.createDataFrame(gone, "column string").select(
        F.lit("missing_required_column").alias("check"), "column", F.lit("issue").alias("severity"),
        F.lit(None).cast("double").alias("value"))
    nulls = null_counts(df).where(F.col("nulls") > F.col("n_rows") * max_null_ratio).select(
        F.lit("high_null_ratio").alias("check"), "column", F.lit("warning").alias("severity"),
        (F.col("nulls") / F.col("n_rows")).alias("value"))
    constant = distinct_counts(df).where(F.col("n_unique") <= 1).select(
        F.lit("constant_column").alias("check"), "column", F.lit("warning").alias("severity"),
        F.col("n_unique").cast("double").alias("value"))
    repeats = duplicate_rows(df).where(F.col("duplicate_rows") > 0).select(
        F.lit("duplicate_rows").alias("check"), F.lit(None).cast("string").alias("column"),
        F.lit("warning").alias("severity"), F.col("duplicate_rows").cast("double").alias("value"))
    return missing.unionByName(nulls).unionByName(constant).unionByName(repeats)


def quality_columns(df: DataFrame) -> DataFrame:
    """(column, missing_pct, n_unique, unique_pct, quality_score) per column."""
    base = null_counts(df).join(F.broadcast(distinct_counts(df)), "column")
    texts = categorical_columns(df)
    if texts:
        base = base.join(F.broadcast(text_lengths(df, texts)), "column", "left")
    else:
        base = base.withColumn("max_length", F.lit(None).cast("bigint"))
    missing = display_round(F.try_divide("nulls", "n_rows") * 100, 2)
    score = 100 - missing - F.when(F.col("max_length") > 1000, 10).otherwise(0)
    return base.select(
        "column", missing.alias("missing_pct"), "n_unique",
        display_round(F.try_divide("n_unique", "n_rows") * 100, 2).alias("unique_pct"),
        display_round(F.greatest(score, F.lit(0.0)), 1).alias("quality_score"))


def quality_score(df: DataFrame) -> DataFrame:
    """One row: mean column score and its rating."""
    overall = display_round(F.avg("quality_score"), 1)
    return (quality_columns(df).agg(overall.alias("overall_score"))
            .withColumn("rating", quality_rating(F.col("overall_score"))))


def feature_categories(df: DataFrame) -> DataFrame:
    """(column, value, n): every category of every text column, one row each."""
    return value_table(df, categorical_columns(df))


def feature_metadata(df: DataFrame, categories: int | None = None) -> DataFrame:
    """One row per feature: kind, nulls, distinct values, numeric range or time range.

    Where the caller asks for it, also the most frequent categories, at most so many, in order;
    ``feature_categories`` gives all of them.
    """
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}

    def stats(d: DataFrame, c: str) -> list[Column]:
        v = as_double(d, c) if kinds[c] == NUMERIC else F.lit(None).cast("double")
        t = quoted(c).cast("string") if kinds[c] == DATETIME else F.lit(None).cast("string")
        return [F.count_if(is_missing(d, c)).alias("nulls"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"), F.max(v).alias("max"), F.min(t).alias("min_time"), F.max(t).alias("max_time")]

    out = F.broadcast(schema_frame(df)).join(stats_rows(df, df.columns, stats), "column")
    out = out.join(F.broadcast(distinct_counts(df)), "column", "left")
    texts = categorical_columns(df)
    if texts and categories:
        few = (top_values(df, categories, texts).groupBy("column")
               .agg(F.array_sort(F.collect_list("value")).alias("categories")))  # ≤ categories per column
        out = out.join(F.broadcast(few), "column", "left")
    else:
        out = out.withColumn("categories", F.lit(None).cast("array<string>"))
    return out.drop("position")
