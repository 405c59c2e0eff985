"""Confusion, metrics, calibration and curves over scored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.registry import query, rounded
from tablewright.catalog.tables import SCORED_BINARY, SCORED_MULTI, SCORED_REG
from tablewright.operators import evaluation as ev


def matrix_sql(src: str) -> str:
    return f"""
WITH k AS (SELECT actual, pred, count(*) AS n FROM {src} GROUP BY ALL),
c AS (SELECT DISTINCT actual AS c FROM k UNION SELECT DISTINCT pred FROM k),
f AS (SELECT a.c AS actual, b.c AS pred, coalesce(k.n, 0) AS n FROM c a CROSS JOIN c b
  LEFT JOIN k ON k.actual = a.c AND k.pred = b.c)
"""


@query("confusion_matrix", "D23", matrix_sql(SCORED_MULTI) + """
SELECT actual, pred, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY actual), 0), 0), 6) AS row_share FROM f""")
def _(t):
    return rounded(ev.confusion_matrix(t.scored_multi))


NULL_LABELS = f"(SELECT CASE WHEN actual <> 'P' THEN actual END AS actual, CASE WHEN pred <> 'F' THEN pred END AS pred FROM {SCORED_MULTI})"


def null_labels(t):
    return t.scored_multi.select(F.when(F.col("actual") != "P", F.col("actual")).alias("actual"),
                                 F.when(F.col("pred") != "F", F.col("pred")).alias("pred"))


@query("confusion_matrix_null_labels", "D23", matrix_sql(NULL_LABELS).replace(
    "k.actual = a.c AND k.pred = b.c", "k.actual IS NOT DISTINCT FROM a.c AND k.pred IS NOT DISTINCT FROM b.c") + """
SELECT actual, pred, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY actual), 0), 0), 6) AS row_share FROM f""")
def _(t):
    return rounded(ev.confusion_matrix(null_labels(t)))


@query("per_class_metrics_null_labels", "D24", f"""
WITH k AS (SELECT * FROM {NULL_LABELS}), c AS (SELECT actual AS c FROM k UNION SELECT pred FROM k),
m AS (SELECT c, (SELECT count(*) FROM k WHERE actual IS NOT DISTINCT FROM c) AS support,
  (SELECT count(*) FROM k WHERE pred IS NOT DISTINCT FROM c) AS predicted,
  (SELECT count(*) FROM k WHERE actual IS NOT DISTINCT FROM c AND pred IS NOT DISTINCT FROM c) AS tp FROM c),
p AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM m)
SELECT c AS "class", round(p, 6) AS precision, round(r, 6) AS recall,
  round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, support::BIGINT AS support FROM p""")
def _(t):
    return rounded(ev.per_class_metrics(null_labels(t)))


BRANDS = ("(SELECT p_brand AS actual, CASE WHEN p_size > 25 THEN p_brand ELSE 'Brand#1' END AS pred FROM part)")


def brands(t):
    return t.part.select(F.col("p_brand").alias("actual"),
                         F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("Brand#1").alias("pred"))


TOP10 = f"""
WITH k AS (SELECT actual, pred, count(*) AS n FROM {BRANDS} GROUP BY ALL),
c AS (SELECT actual AS c FROM k GROUP BY actual ORDER BY sum(n) DESC, actual LIMIT 10),
f AS (SELECT a.c AS actual, b.c AS pred, coalesce(k.n, 0) AS n FROM c a CROSS JOIN c b
  LEFT JOIN k ON k.actual = a.c AND k.pred = b.c)
"""


@query("confusion_matrix_top_classes", "D23 N7", TOP10 + """
SELECT actual, pred, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY actual), 0), 0), 6) AS row_share FROM f""")
def _(t):
    return rounded(ev.confusion_matrix(brands(t), top=10))


@query("per_class_metrics", "D24 N7", TOP10 + """,
m AS (SELECT c.c, (SELECT sum(n) FROM f WHERE actual = c.c) AS support, (SELECT sum(n) FROM f WHERE pred = c.c) AS predicted,
  (SELECT sum(n) FROM f WHERE actual = c.c AND pred = c.c) AS tp FROM c),
p AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM m)
SELECT c AS "class", round(p, 6) AS precision, round(r, 6) AS recall,
  round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, support::BIGINT AS support FROM p""")
def _(t):
    return rounded(ev.per_class_metrics(brands(t), top=10))


@query("rows_of_top_classes", "C7", f"""
SELECT actual, count(*) AS n FROM {BRANDS} WHERE actual IN (SELECT actual FROM {BRANDS} GROUP BY actual
ORDER BY count(*) DESC, actual LIMIT 5) GROUP BY actual""")
def _(t):
    return ev.rows_of_top_classes(brands(t), 5).groupBy("actual").agg(F.count(F.lit(1)).alias("n"))


def metrics_sql(src: str) -> str:
    return f"""
WITH s AS {src}, c AS (SELECT DISTINCT actual AS c FROM s UNION SELECT DISTINCT pred FROM s),
m AS (SELECT c.c, (SELECT count(*) FROM s WHERE actual = c.c) AS sup, (SELECT count(*) FROM s WHERE pred = c.c) AS q,
  (SELECT count(*) FROM s WHERE actual = c.c AND pred = c.c) AS tp FROM c),
p AS (SELECT *, coalesce(tp / nullif(q, 0), 0) AS p, coalesce(tp / nullif(sup, 0), 0) AS r FROM m)
SELECT round(sum(tp) / sum(sup), 6) AS accuracy, round(sum(sup * p) / sum(sup), 6) AS precision,
  round(sum(sup * r) / sum(sup), 6) AS recall,
  round(sum(sup * coalesce(2 * p * r / nullif(p + r, 0), 0)) / sum(sup), 6) AS f1_score,
  sum(sup)::BIGINT AS sample_count FROM p"""


@query("classification_metrics", "D25", metrics_sql(SCORED_MULTI))
def _(t):
    return rounded(ev.classification_metrics(t.scored_multi))


@query("classification_metrics_binary", "D25", metrics_sql(SCORED_BINARY))
def _(t):
    return rounded(ev.classification_metrics(t.scored_binary))


@query("regression_metrics", "D26", f"""
SELECT round(avg(power(actual - pred, 2)), 2) AS mse, round(sqrt(avg(power(actual - pred, 2))), 4) AS rmse,
  round(avg(abs(actual - pred)), 4) AS mae,
  round(1 - sum(power(actual - pred, 2)) / (var_pop(actual) * count(*)), 6) AS r2_score, count(*) AS sample_count
FROM {SCORED_REG}""")
def _(t):
    return rounded(ev.regression_metrics(t.scored_reg), mse=2, rmse=4, mae=4)


GAPS = f"(SELECT actual, CASE WHEN floor(actual) % 10 <> 0 THEN pred END AS pred FROM {SCORED_REG})"


@query("regression_metrics_gaps", "D26", f"""
SELECT round(avg(power(actual - pred, 2)), 2) AS mse, round(sqrt(avg(power(actual - pred, 2))), 4) AS rmse,
  round(avg(abs(actual - pred)), 4) AS mae,
  round(1 - sum(power(actual - pred, 2)) / (var_pop(actual) * count(*)), 6) AS r2_score, count(*) AS sample_count
FROM {GAPS} WHERE pred IS NOT NULL""")
def _(t):
    gaps = t.scored_reg.withColumn("pred", F.when(F.floor("actual") % 10 != 0, F.col("pred")))
    return rounded(ev.regression_metrics(gaps), mse=2, rmse=4, mae=4)


@query("residual_summary", "D27", f"""
SELECT count(*) AS n, round(avg(actual - pred), 4) AS mean, round(stddev_pop(actual - pred), 4) AS std FROM {SCORED_REG}""")
def _(t):
    return rounded(ev.residual_summary(t.scored_reg), 4)


@query("residual_histogram", "D27 D11", f"""
SELECT 'residual' AS "column", g.b AS bin, round(lo + g.b * ((hi - lo) / 30), 4) AS bin_start,
  round(lo + (g.b + 1) * ((hi - lo) / 30), 4) AS bin_end, count(v) AS n
FROM (SELECT min(actual - pred) AS lo, max(actual - pred) AS hi FROM {SCORED_REG}) CROSS JOIN (SELECT unnest(range(30)) AS b) g
LEFT JOIN (SELECT actual - pred AS v FROM {SCORED_REG}) ON v >= lo + g.b * ((hi - lo) / 30)
  AND (g.b = 29 OR v < lo + (g.b + 1) * ((hi - lo) / 30)) GROUP BY g.b, lo, hi""")
def _(t):
    return rounded(ev.residual_histogram(t.scored_reg), 4)


@query("calibration_curve", "D28 N7", f"""
SELECT least(greatest(ceil(prob * 10) - 1, 0), 9)::BIGINT AS bin, round(avg(prob), 6) AS mean_predicted,
  round(avg(actual), 6) AS fraction_positive, count(*) AS n FROM {SCORED_BINARY} GROUP BY bin""")
def _(t):
    return rounded(ev.calibration_curve(t.scored_binary))


@query("class_distribution", "D29", f"""
SELECT 'actual' AS side, actual AS "class", count(*) AS n FROM {SCORED_MULTI} GROUP BY actual
UNION ALL SELECT 'pred', pred, count(*) FROM {SCORED_MULTI} GROUP BY pred""")
def _(t):
    return ev.class_distribution(t.scored_multi)


CURVE = f"""(SELECT prob AS threshold, sum(sum(actual)) OVER w AS tp, sum(sum(1 - actual)) OVER w AS fp,
  sum(sum(actual)) OVER () AS pos, sum(sum(1 - actual)) OVER () AS neg FROM {SCORED_BINARY} GROUP BY prob
  WINDOW w AS (ORDER BY prob DESC))"""


@query("roc_curve", "D35", f"""
SELECT round(threshold, 9) AS threshold, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr FROM {CURVE}""")
def _(t):
    return rounded(ev.roc_curve(t.scored_binary), threshold=9)


@query("auc", "D35", f"""
SELECT round(sum((fp - pf) * (tp + pt) / 2.0) / any_value(pos * neg), 6) AS auc FROM (
SELECT *, lag(tp, 1, 0) OVER (ORDER BY threshold DESC) AS pt, lag(fp, 1, 0) OVER (ORDER BY threshold DESC) AS pf FROM {CURVE})""")
def _(t):
    return rounded(ev.auc(t.scored_binary))


@query("precision_recall_curve", "D36", f"""
SELECT round(threshold, 9) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall FROM {CURVE}""")
def _(t):
    return rounded(ev.precision_recall_curve(t.scored_binary), threshold=9)
