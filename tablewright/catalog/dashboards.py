"""Dashboard parts, targets, suggestions and model ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.registry import query, rounded
from tablewright.catalog.tables import LINEITEM_DUP, LINEITEM_N, LINEITEM_N_COLUMNS, LINEITEM_N_NUMERIC, union_all
from tablewright.catalog.statistics import LINEITEM_TYPES, N_TYPES, pairs_sql
from tablewright.operators import trends
from tablewright.plans import dashboard as dash
from tablewright.plans import profile as prof
from tablewright.plans import suggest

CUSTOMER_TYPES = [("c_custkey", "bigint", "numeric"), ("c_name", "string", "categorical"), ("c_nationkey", "int", "numeric"),
                  ("c_acctbal", "double", "numeric"), ("c_mktsegment", "string", "categorical")]
ORDERS_TYPES = [("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"), ("o_orderstatus", "string", "categorical"),
                ("o_totalprice", "double", "numeric"), ("o_orderdate", "timestamp_ntz", "datetime"),
                ("o_orderpriority", "string", "categorical")]


def small_profile_sql(source: str, types) -> str:
    """position, column, kind, n_rows, nulls, null_pct, n_unique."""
    return union_all(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{k}' AS kind, count(*) AS n_rows, count(*) - count({c}) AS nulls, "
        f"(count(*) - count({c})) * 100.0 / count(*) AS null_pct, count(DISTINCT {c}) AS n_unique FROM {source}"
        for i, (c, _, k) in enumerate(types))


@query("validate", "I3", f"""
WITH p AS ({small_profile_sql(LINEITEM_N, N_TYPES)})
SELECT 'missing_required_column' AS "check", 'l_comment' AS "column", 'issue' AS severity, NULL::DOUBLE AS value
UNION ALL SELECT 'high_null_ratio', "column", 'warning', round(nulls / n_rows, 6) FROM p WHERE nulls / n_rows > 0.5
UNION ALL SELECT 'constant_column', "column", 'warning', n_unique FROM p WHERE n_unique <= 1
UNION ALL SELECT 'duplicate_rows', NULL, 'warning', n FROM (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {LINEITEM_N})) AS n
  FROM {LINEITEM_N}) WHERE n > 0""")
def _(t):
    return rounded(prof.validate(t.lineitem_n, ["l_orderkey", "l_comment"]))


QUALITY = f"""
WITH p AS ({small_profile_sql(LINEITEM_N, N_TYPES)}),
q AS (SELECT "column", round_even(nulls / n_rows * 100, 2) AS missing_pct, n_unique, round_even(n_unique / n_rows * 100, 2) AS unique_pct,
  round_even(100 - round_even(nulls / n_rows * 100, 2), 1) AS quality_score FROM p)"""


@query("quality_columns", "I4", QUALITY + " SELECT * FROM q")
def _(t):
    return prof.quality_columns(t.lineitem_n)


@query("quality_score", "I4 H20", QUALITY + """
SELECT round_even(avg(quality_score), 1) AS overall_score, CASE WHEN round_even(avg(quality_score), 1) >= 95 THEN 'Excellent'
  WHEN round_even(avg(quality_score), 1) >= 80 THEN 'Good' WHEN round_even(avg(quality_score), 1) >= 60 THEN 'Fair' ELSE 'Needs Improvement' END AS rating
FROM q""")
def _(t):
    return prof.quality_score(t.lineitem_n)


@query("quality_columns_long_text", "I4 H2", union_all(f"""
SELECT '{c}' AS "column", 0.0 AS missing_pct, count(DISTINCT {c}) AS n_unique, round(count(DISTINCT {c}) * 100.0 / count(*), 2) AS unique_pct,
  {"100.0 - CASE WHEN max(length(" + c + ")) > 1000 THEN 10 ELSE 0 END" if k else "100.0"} AS quality_score FROM documents"""
                                                       for c, k in [("doc_id", 0), ("text", 1), ("lang", 1), ("source", 1), ("n_chars", 0)]))
def _(t):
    return rounded(prof.quality_columns(t.documents))


@query("target_candidates", "I2", f"""
WITH p AS ({small_profile_sql("events", [("event_id", "", "numeric"), ("ts", "", "datetime"), ("user_id", "", "numeric"),
                                         ("event_type", "", "categorical"), ("value", "", "numeric"), ("props", "", "categorical")])})
SELECT "column", position, 10 AS score, 'name' AS reason FROM p WHERE "column" LIKE '%y%'
UNION ALL SELECT "column", position, 5, 'binary' FROM p WHERE n_unique = 2
UNION ALL SELECT "column", position, 3, 'low_cardinality' FROM p WHERE kind = 'categorical' AND n_unique BETWEEN 2 AND 20""")
def _(t):
    return rounded(prof.target_candidates(prof.profile(t.events), "substring"))


@query("detect_target", "I2", """
SELECT 'token' AS rule, 'label' AS "column" FROM (SELECT count(*) FROM labels)
UNION ALL SELECT 'substring', 'label' UNION ALL SELECT 'common_name', 'label' UNION ALL SELECT 'cardinality', 'label'""")
def _(t):
    df = t.labels.select("doc_id", F.col("quality").alias("label"), "toxic")
    rows = prof.profile(df).persist()
    out = None
    for rule in ("token", "substring", "common_name", "cardinality"):
        one = prof.detect_target(rows, rule).select(F.lit(rule).alias("rule"), "column")
        out = one if out is None else out.unionByName(one)
    return out


@query("detect_target_by_name", "I2", """
WITH c AS (SELECT 'orders' AS source, cid AS i, lower(name) AS name FROM pragma_table_info('orders')
  UNION ALL SELECT 'part', cid, lower(name) FROM pragma_table_info('part')),
h AS (SELECT source, i, name, list_contains(['target', 'label', 'class', 'y', 'outcome', 'result', 'status'], name) AS exact, regexp_matches(
  name, 'target|label|class|category|y|outcome|result|status|type|response') AS part FROM c)
SELECT source, 'common_name' AS rule, coalesce(arg_min(name, i) FILTER (WHERE exact), arg_max(name, i)) AS "column" FROM h GROUP BY source
UNION ALL SELECT source, 'cardinality', arg_min(name, i) FILTER (WHERE part) FROM h GROUP BY source HAVING bool_or(part)""")
def _(t):
    out = None
    for source in ("orders", "part"):
        rows = prof.profile(getattr(t, source))
        for rule in ("common_name", "cardinality"):
            one = prof.detect_target(rows, rule).select(F.lit(source).alias("source"), F.lit(rule).alias("rule"), "column")
            out = one if out is None else out.unionByName(one)
    return out


@query("feature_categories", "I13", union_all(f"""
SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM customer GROUP BY {c}""" for c in ("c_name", "c_mktsegment")))
def _(t):
    return prof.feature_categories(t.customer)


@query("problem_type", "I6 M10", """
SELECT 'o_orderstatus' AS "column", 3 AS n_unique, 'classification' AS dashboard, 'classification' AS suggest FROM (SELECT count(*) FROM orders)
UNION ALL SELECT 'o_totalprice', (SELECT count(DISTINCT o_totalprice) FROM orders), 'regression', 'regression'""")
def _(t):
    rows = prof.profile(t.orders).persist()
    out = None
    for c in ("o_orderstatus", "o_totalprice"):
        a = prof.problem_type(rows, c).withColumnRenamed("problem_type", "dashboard")
        b = prof.problem_type(rows, c, "suggest").select("column", F.col("problem_type").alias("suggest"))
        one = a.join(b, "column")
        out = one if out is None else out.unionByName(one)
    return out


@query("kpis", "I5", f"""
WITH p AS ({small_profile_sql("orders", ORDERS_TYPES)}), s AS (SELECT max(n_rows) AS n, round((1 - sum(nulls) / sum(n_rows)) * 100, 1) AS c FROM p),
b AS (SELECT round(min(n) * 100.0 / max(n), 1) AS b FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus))
SELECT 1 AS position, 'Total Records' AS name, format('{{:,}}', n) AS value, 'blue' AS color FROM s
UNION ALL SELECT 2, 'Data Completeness', printf('%.1f%%', c), CASE WHEN c >= 95 THEN 'green' WHEN c >= 80 THEN 'yellow' ELSE 'red' END FROM s
UNION ALL SELECT 3, 'Features', '6', 'purple' UNION ALL SELECT 4, 'Numeric Features', '3', 'indigo'
UNION ALL SELECT 5, 'Categorical Features', '2', 'pink'
UNION ALL SELECT 6, 'Class Balance', printf('%.1f%%', b), CASE WHEN b < 50 THEN 'orange' ELSE 'green' END FROM b""")
def _(t):
    return rounded(dash.kpis(t.orders, prof.profile(t.orders).persist(), "o_orderstatus"))


@query("key_statistics", "I6", union_all(
    f"SELECT '{c}' AS \"column\", round(avg({c}), 2) AS mean, round(median({c}), 2) AS median, round(stddev_samp({c}), 2) AS std FROM {LINEITEM_N}"
    for c in LINEITEM_N_NUMERIC))
def _(t):
    return dash.key_statistics(prof.profile(t.lineitem_n))


@query("target_analysis", "I6", """
SELECT 'class' AS kind, o_orderstatus AS name, count(*)::DOUBLE AS value FROM orders GROUP BY o_orderstatus""")
def _(t):
    return dash.target_analysis(t.orders, prof.profile(t.orders).persist(), "o_orderstatus")


@query("target_analysis_regression", "I6", union_all(
    f"SELECT 'number' AS kind, '{n}' AS name, round({f}(o_totalprice), 2) AS value FROM orders"
    for n, f in [("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")]))
def _(t):
    return dash.target_analysis(t.orders, prof.profile(t.orders).persist(), "o_totalprice")


@query("executive_summary", "I6", f"""
WITH p AS ({small_profile_sql(LINEITEM_N, N_TYPES)}), s AS (SELECT max(n_rows) AS n, round((1 - sum(nulls) / sum(n_rows)) * 100, 1) AS c,
  round(sum(nulls) / sum(n_rows) * 100, 1) AS m FROM p)
SELECT format('{{:,}}', n) || ' rows in 9 columns' AS headline, c AS data_completeness,
  format('{{:,}}', n) || ' rows, 9 columns. 6 of them are numbers. 2 of them are texts. '
  || CASE WHEN m < 5 THEN 'Few' WHEN m < 20 THEN 'Some' ELSE 'Many' END || ' cells are empty (' || printf('%.1f', m) || '%). '
  || 'Target l_linestatus: 2 classes, most often ' || (SELECT l_linestatus FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
  || '. ' AS narrative FROM s""")
def _(t):
    return dash.executive_summary(t.lineitem_n, prof.profile(t.lineitem_n).persist(), "l_linestatus")


SQ = "(SELECT value * value * value AS cubed, value, event_type, event_id FROM events)"


@query("insights", "I7", f"""
WITH b AS (SELECT quantile_cont(cubed, 0.25) AS q1, quantile_cont(cubed, 0.75) AS q3 FROM {SQ}),
o AS (SELECT count(*) FILTER (WHERE cubed < q1 - 1.5 * (q3 - q1) OR cubed > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*) AS pct FROM {SQ}, b),
v AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {SQ}),
ov AS (SELECT count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*) AS pct FROM {SQ}, v),
far AS (SELECT 0 AS i, 'cubed' AS c, pct FROM o UNION ALL SELECT 1, 'value', pct FROM ov),
r AS (SELECT min(n) / max(n) AS r FROM (SELECT count(*) AS n FROM events GROUP BY event_type)),
hc AS (SELECT corr(cubed, value) AS r FROM {SQ})
SELECT 1 AS position, 'success' AS type, 'completeness' AS category, 'no gaps found' AS title, 'no missing values' AS detail
FROM (SELECT count(*) AS n, count(value) AS a, count(event_type) AS b, count(event_id) AS c FROM events) WHERE a = n AND b = n AND c = n
UNION ALL SELECT 3, 'warning', 'extremes', 'columns with many far values', string_agg(c || ' (' || printf('%.1f', pct) || '%)', ', ' ORDER BY i) FROM far WHERE pct > 5 HAVING count(*) > 0
UNION ALL SELECT 4, CASE WHEN r < 0.3 THEN 'warning' ELSE 'success' END, 'target',
  CASE WHEN r < 0.3 THEN 'classes of very unequal size' ELSE 'classes of similar size' END, 'ratio: ' || printf('%.2f', r) FROM r
UNION ALL SELECT 6, 'info', 'redundancy', 'pairs of columns that move together', '1 pairs: cubed-value' FROM hc WHERE abs(r) > 0.8""")
def _(t):
    v = F.col("value")
    df = t.events.select((v * v * v).alias("cubed"), "value", "event_type", "event_id")
    return rounded(dash.insights(df, prof.profile(df).persist(), "event_type"))


LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_COLUMNS = [*LINEITEM_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]


@query("insights_numeric_target", "I7 D15", f"""
WITH c AS ({union_all(f"SELECT '{c}' AS n, abs(corr({c}, l_extendedprice)) AS r FROM lineitem" for c in
                      LINEITEM_NUMBERS)})
SELECT 2 AS position, 'info' AS type, 'target relation' AS category, 'columns that move with the target' AS title,
  string_agg(n, ', ' ORDER BY r DESC) AS detail FROM (SELECT * FROM c ORDER BY r DESC LIMIT 3)
UNION ALL SELECT 1, 'success', 'completeness', 'no gaps found', 'no missing values'
  FROM (SELECT 1) x WHERE (SELECT count(*) FROM lineitem WHERE {" OR ".join(f"{c} IS NULL" for c in LINEITEM_COLUMNS)}) = 0
UNION ALL SELECT 6, 'info', 'redundancy', 'pairs of columns that move together', count(*) || ' pairs: ' || string_agg(a || '-' || b, ', ' ORDER BY i, j)
  FROM ({union_all(f"SELECT {i} AS i, {j} AS j, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(LINEITEM_NUMBERS)
                   for j, b in enumerate(LINEITEM_NUMBERS) if i < j)}) WHERE abs(r) > 0.8 HAVING count(*) > 0""")
def _(t):
    return rounded(dash.insights(t.lineitem, prof.profile(t.lineitem).persist(), "l_extendedprice"))


@query("recommendations", "I8", """
SELECT 2 AS position, 'high' AS priority, 'model' AS category,
  CASE WHEN n = 2 THEN 'tell two classes apart' ELSE 'tell several classes apart' END AS title FROM (SELECT count(DISTINCT l_linestatus) AS n FROM lineitem)
UNION ALL SELECT 3, 'medium', 'columns', 'try products of numeric columns'
UNION ALL SELECT 1, 'low', 'scale', 'more than 100000 rows' FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 100000
UNION ALL SELECT 1, 'medium', 'sample size', 'fewer than 1000 rows' FROM (SELECT count(*) AS n FROM lineitem) WHERE n < 1000""")
def _(t):
    return rounded(dash.recommendations(prof.profile(t.lineitem), "l_linestatus"))


@query("dashboard", "I9")
def _(t):
    parts = dash.dashboard(t.events, "event_type", sample_key="event_id")
    out = None
    for name, part in parts.items():  # one row per part: how many rows it has
        one = part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("feature_metadata", "I13", union_all(f"""
SELECT '{c}' AS "column", '{ty}' AS dtype, '{k}' AS kind, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_unique,
  {f"round(avg({c}), 4)" if k == "numeric" else "NULL::DOUBLE"} AS mean, {f"round(stddev_samp({c}), 4)" if k == "numeric" else "NULL::DOUBLE"} AS std,
  {f"round(min({c})::DOUBLE, 4)" if k == "numeric" else "NULL::DOUBLE"} AS min, {f"round(max({c})::DOUBLE, 4)" if k == "numeric" else "NULL::DOUBLE"} AS max,
  {f"min({c})::VARCHAR" if k == "datetime" else "NULL::VARCHAR"} AS min_time, {f"max({c})::VARCHAR" if k == "datetime" else "NULL::VARCHAR"} AS max_time,
  {f"string_agg(DISTINCT {c}, ',' ORDER BY {c})" if k == "categorical" else "NULL::VARCHAR"} AS categories FROM {LINEITEM_N}""" for c, ty, k in N_TYPES))
def _(t):
    meta = prof.feature_metadata(t.lineitem_n, 50)
    return rounded(meta.withColumn("categories", F.array_join("categories", ",")), 4)


@query("feature_statistics", "I14", f"""
SELECT 'l_tax' AS "column", count(l_tax) AS n, round(avg(l_tax), 6) AS mean, round(stddev_samp(l_tax), 6) AS std, min(l_tax) AS min, max(l_tax) AS max,
  round(quantile_cont(l_tax, 0.25), 6) AS q25, round(median(l_tax), 6) AS median, round(quantile_cont(l_tax, 0.75), 6) AS q75,
  round(quantile_cont(l_tax, 0.95), 6) AS q95, round(skewness(l_tax), 6) AS skewness, round(kurtosis(l_tax), 6) AS kurtosis FROM {LINEITEM_N}""")
def _(t):
    from tablewright.plans.features import feature_statistics
    return rounded(feature_statistics(t.lineitem_n, "l_tax"))


@query("training_metadata", "I16", union_all(f"""
SELECT '{c}' AS "column", '{k}' AS kind, {f"round(avg({c}), 6)" if k == "numeric" else "NULL::DOUBLE"} AS mean,
  {f"min({c})::DOUBLE" if k == "numeric" else "NULL::DOUBLE"} AS min, {f"max({c})::DOUBLE" if k == "numeric" else "NULL::DOUBLE"} AS max,
  count(DISTINCT {c}) AS n_unique, {f"(SELECT string_agg({c}, ',' ORDER BY {c}) FROM (SELECT {c} FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10))" if k == "categorical" else "NULL::VARCHAR"} AS categories
FROM customer""" for c, _, k in CUSTOMER_TYPES))
def _(t):
    meta = prof.feature_metadata(t.customer, 10).select("column", "kind", "mean", "min", "max", "n_unique",
                                                        F.array_join("categories", ",").alias("categories"))
    return rounded(meta)


@query("dataset_complexity", "I15", f"""
WITH p AS ({small_profile_sql(LINEITEM_N, N_TYPES)}), v AS ({union_all(f"SELECT var_samp({c}) AS v FROM {LINEITEM_N}" for c in LINEITEM_N_NUMERIC)}),
b AS (SELECT max(n) / min(n) AS r, count(*) AS k FROM (SELECT count(*) AS n FROM {LINEITEM_N} GROUP BY l_linestatus))
SELECT max(n_rows) AS n_samples, 8 AS n_features, round(max(n_rows) / 8, 6) AS sample_feature_ratio, max(n_rows) < 1000 AS is_small_dataset,
  max(n_rows) >= 1000 AND max(n_rows) < 50000 AS is_medium_dataset, max(n_rows) >= 50000 AS is_large_dataset, false AS is_high_dimensional,
  bool_or(null_pct > 0) AS has_missing_values, round(avg(null_pct), 6) AS missing_value_ratio, 2 AS n_categorical, 6 AS n_numerical,
  round(2 / 9, 6) AS categorical_ratio, (SELECT round(r, 6) FROM b) AS class_imbalance_ratio, (SELECT k FROM b) AS n_classes,
  (SELECT r > 3 FROM b) AS is_imbalanced, (SELECT k > 2 FROM b) AS is_multiclass,
  (SELECT count(*) FROM v WHERE v > 10 * (SELECT median(v) FROM v)) AS high_variance_features FROM p""")
def _(t):
    return rounded(suggest.dataset_complexity(t.lineitem_n, prof.profile(t.lineitem_n).persist(), "l_linestatus"))


@query("suggest_steps", "J14", f"""
WITH p AS ({small_profile_sql(LINEITEM_N, N_TYPES)}),
d AS (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {LINEITEM_N})) AS dup FROM {LINEITEM_N}),
s AS (
SELECT 1 AS phase, position, CASE WHEN null_pct > 50 THEN 'drop_column' ELSE 'impute' END AS type, "column" AS target_columns,
  CASE WHEN null_pct > 50 THEN NULL WHEN kind <> 'numeric' THEN 'most_frequent' WHEN null_pct > 10 THEN 'median' ELSE 'mean' END AS parameter,
  CASE WHEN null_pct > 50 THEN 0.95 WHEN kind = 'numeric' THEN 0.88 ELSE 0.85 END AS confidence,
  CASE WHEN null_pct > 50 THEN 'drop-' ELSE 'impute-' END || "column" AS tag FROM p WHERE null_pct > 0
UNION ALL SELECT 2, 0, 'drop_duplicates', '', NULL, 0.92, 'drop-duplicates' FROM d WHERE dup > 0
UNION ALL SELECT 3, position, 'encode', "column", CASE WHEN n_unique <= 10 THEN 'onehot' ELSE 'label' END,
  CASE WHEN n_unique <= 10 THEN 0.9 ELSE 0.82 END, CASE WHEN n_unique <= 10 THEN 'onehot-' ELSE 'label-' END || "column"
  FROM p WHERE kind = 'categorical' AND "column" <> 'l_linestatus'
UNION ALL SELECT 4, 0, 'scale', string_agg("column", ',' ORDER BY position), 'standard', 0.87, 'scale' FROM p WHERE kind = 'numeric')
SELECT row_number() OVER (ORDER BY phase, position) AS step, printf('step-%02d-', row_number() OVER (ORDER BY phase, position)) || tag AS id,
  type, target_columns, parameter, confidence::DOUBLE AS confidence FROM s""")
def _(t):
    rows = prof.profile(t.lineitem_n).persist()
    steps = suggest.suggest_steps(rows, prof.profile_summary(t.lineitem_n), "l_linestatus")
    return rounded(steps.withColumn("target_columns", F.array_join("target_columns", ",")).drop("rationale"))


@query("rank_models", "M10", f"""
WITH n AS (SELECT count(*) AS n FROM {LINEITEM_N}), c AS (SELECT n, n >= 50000 AS large, n >= 1000 AND n < 50000 AS medium, n < 1000 AS small,
  least(200, greatest(50, n // 100)) AS trees FROM n),
b AS (SELECT max(k) / min(k) > 3 AS imb FROM (SELECT count(*) AS k FROM {LINEITEM_N} GROUP BY l_linestatus)),
m AS (
SELECT 0 AS o, 'XGBoostClassifier' AS model, 50.0 + CASE WHEN large THEN 25 WHEN medium THEN 20 ELSE 10 END + CASE WHEN imb THEN 15 ELSE 0 END + 10 AS score,
  (0.00005 * n * 8 * (trees / 100) + 2) * 1.5 AS secs, trees AS iterations FROM c, b
UNION ALL SELECT 1, 'RandomForestClassifier', 50.0 + CASE WHEN medium THEN 20 WHEN small THEN 15 ELSE 10 END + CASE WHEN imb THEN 8 ELSE 0 END + 5,
  (0.00008 * n * 8 * (trees / 100) + 2) * 1.5, trees FROM c, b
UNION ALL SELECT 2, 'LogisticRegression', 50.0 + CASE WHEN small THEN 20 WHEN medium THEN 10 ELSE -10 END - CASE WHEN imb THEN 5 ELSE 0 END + 10,
  0.00001 * n * 8 + 2, 1000 FROM c, b)
SELECT row_number() OVER (ORDER BY score DESC, o) AS rank, model, score::DOUBLE AS score, round(score / 100, 2)::DOUBLE AS confidence,
  round(secs, 1)::DOUBLE AS estimated_seconds, round(secs / 60, 2)::DOUBLE AS estimated_minutes, iterations::BIGINT AS iterations,
  row_number() OVER (ORDER BY score DESC, o) = 1 AS is_recommended FROM m""")
def _(t):
    rows = prof.profile(t.lineitem_n).persist()
    return rounded(suggest.rank_models(suggest.dataset_complexity(t.lineitem_n, rows, "l_linestatus"), "classification"))


@query("baseline_statistics", "I17 D5", """
SELECT p_brand AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rank,
  round(count(*) / (SELECT count(*) FROM part), 6) AS share FROM part GROUP BY p_brand QUALIFY rank <= 20""")
def _(t):
    from tablewright.plans.features import baseline_shares
    return rounded(baseline_shares(t.part.select("p_brand"), 20).drop("column"))


TREND_VALUES = ["o_orderkey", "o_custkey", "o_totalprice"]
BUCKET = "last_day(o_orderdate::DATE)"


@query("trend_resample", "E2 I9", union_all(f"""
SELECT * FROM (SELECT '{c}' AS "column", 'Monthly' AS frequency, {BUCKET}::VARCHAR AS bucket, round(avg({c}), 4) AS value FROM orders
GROUP BY {BUCKET} ORDER BY {BUCKET} DESC LIMIT 50)""" for c in TREND_VALUES))
def _(t):
    points = trends.last_points(trends.resample(t.orders, "o_orderdate"))
    return rounded(points.withColumn("bucket", F.col("bucket").cast("string")), 4)


@query("trend_resample_daily", "E2", """
SELECT 'value' AS "column", 'Daily' AS frequency, ts::DATE::VARCHAR AS bucket, round(avg(value), 4) AS value FROM events GROUP BY ts::DATE""")
def _(t):
    points = trends.last_points(trends.resample(t.events, "ts", ["value"]))
    return rounded(points.withColumn("bucket", F.col("bucket").cast("string")), 4)


@query("trend_resample_weekly", "E2", """
SELECT 'value' AS "column", 'Weekly' AS frequency, (date_trunc('week', d) + INTERVAL 6 DAY)::DATE::VARCHAR AS bucket, round(avg(value), 4) AS value
FROM (SELECT (ts + to_days((event_id % 50)::INT))::DATE AS d, value FROM events) GROUP BY date_trunc('week', d)""")
def _(t):
    shifted = t.events.select((F.col("ts") + F.make_dt_interval((F.col("event_id") % 50).cast("int"))).alias("ts"), "value")
    points = trends.resample(shifted, "ts", ["value"])
    return rounded(points.withColumn("bucket", F.col("bucket").cast("string")), 4)


@query("trend_direction", "E3", union_all(f"""
SELECT '{c}' AS "column", 'Monthly' AS frequency, round(a, 4) AS first_value, round(b, 4) AS last_value,
  CASE WHEN b > a THEN 'Increasing' ELSE 'Decreasing' END AS trend_direction, round((b - a) / abs(a) * 100, 4) AS change_pct
FROM (SELECT arg_min(v, k) AS a, arg_max(v, k) AS b FROM (SELECT {BUCKET} AS k, avg({c}) AS v FROM orders GROUP BY 1))""" for c in TREND_VALUES))
def _(t):
    return rounded(trends.direction(trends.resample(t.orders, "o_orderdate")), 4)
