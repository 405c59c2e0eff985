"""Distribution drift: lineitem shipped before July 1998 against the rest, quantity shifted."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.registry import query, rounded
from tablewright.catalog.tables import DRIFT_CUR, DRIFT_REF, LINEITEM_NUMERIC, union_all
from tablewright.operators import categories, drift, summary
from tablewright.operators.evaluation import long_metrics, regression_metrics

TEXTS = ["l_returnflag", "l_linestatus"]


def bins_sql(cols, bins: int = 10) -> str:
    return union_all(f"""
SELECT '{c}' AS "column", g.b AS bin, count(*) FILTER (WHERE v.s = 1) AS r, count(*) FILTER (WHERE v.s = 0) AS c
FROM (SELECT least((SELECT min({c}) FROM {DRIFT_REF}), (SELECT min({c}) FROM {DRIFT_CUR}))::DOUBLE AS lo,
  greatest((SELECT max({c}) FROM {DRIFT_REF}), (SELECT max({c}) FROM {DRIFT_CUR}))::DOUBLE AS hi) x
CROSS JOIN (SELECT unnest(range({bins})) AS b) g
LEFT JOIN (SELECT {c}::DOUBLE AS v, 1 AS s FROM {DRIFT_REF} UNION ALL SELECT {c}::DOUBLE, 0 FROM {DRIFT_CUR}) v
  ON v.v >= x.lo + g.b * ((x.hi - x.lo) / {bins}) AND (g.b = {bins - 1} OR v.v < x.lo + (g.b + 1) * ((x.hi - x.lo) / {bins}))
GROUP BY g.b""" for c in cols)


def cats_sql(cols) -> str:
    return union_all(f"""
SELECT '{c}' AS "column", {c} AS bin, count(*) FILTER (WHERE s = 1) AS r, count(*) FILTER (WHERE s = 0) AS c
FROM (SELECT {c}, 1 AS s FROM {DRIFT_REF} UNION ALL SELECT {c}, 0 FROM {DRIFT_CUR}) GROUP BY {c}""" for c in cols)


TOTALS = 'sum(r) OVER (PARTITION BY "column") AS rt, sum(c) OVER (PARTITION BY "column") AS ct, ' \
         'count(*) OVER (PARTITION BY "column") AS k'
TERMS = {"psi": "(q - p) * ln((q + {e}) / (p + {e}))", "kl_divergence": "p * ln((p + {e}) / (q + {e}))",
         "js_divergence": "0.5 * p * ln(p / (0.5 * (p + q))) + 0.5 * q * ln(q / (0.5 * (p + q)))"}
SHARES = {
    ("numeric", "monitor"): ("(r + 1) / (rt + k)", "(c + 1) / (ct + k)"),
    ("numeric", "service"): ("(r + 1e-8) / (rt + 1e-8 * k)", "(c + 1e-8) / (ct + 1e-8 * k)"),
    ("floored", "monitor"): ("greatest(r / rt, 0.0001)", "greatest(c / ct, 0.0001)"),
    ("categorical", "monitor"): ("CASE WHEN r = 0 THEN 0.0001 ELSE r / rt END",
                                 "CASE WHEN c = 0 THEN 0.0001 ELSE c / ct END"),
    ("raw", "service"): ("r::DOUBLE", "c::DOUBLE"),
    ("categorical", "service"): ("r / rt", "c / ct"),
}


def divergence_sql(counts: str, method: str, shares, eps: str = "0", digits: int = 6) -> str:
    p, q = shares
    term = TERMS[method].format(e=eps)
    return (f'SELECT "column", round(sum({term}), {digits}) AS score FROM (SELECT "column", {p} AS p, {q} AS q FROM '
            f'(SELECT *, {TOTALS} FROM ({counts}))) GROUP BY "column"')


NUM_BINS, CAT_COUNTS = bins_sql(LINEITEM_NUMERIC), cats_sql(TEXTS)

for _method, _row in (("psi", "K1"), ("kl_divergence", "K5"), ("js_divergence", "K7")):
    def _numeric(t, m=_method):
        return rounded(drift.divergence(drift.numeric_bins(t.drift_ref, t.drift_cur), m, "numeric"))

    def _text(t, m=_method):
        return rounded(drift.divergence(drift.category_counts(t.drift_ref, t.drift_cur), m, "categorical"))
    query(f"{_method}_numeric", f"{_row} C6 H13", divergence_sql(NUM_BINS, _method, SHARES["numeric", "monitor"]))(_numeric)
    query(f"{_method}_categorical", "K2 C3" if _method == "psi" else f"{_row} C3", divergence_sql(
        CAT_COUNTS, _method, SHARES["floored" if _method == "psi" else "categorical", "monitor"]))(_text)

PSI_SERVICE = (divergence_sql(NUM_BINS, "psi", SHARES["numeric", "service"], "1e-8") + "\nUNION ALL\n"
               + divergence_sql(CAT_COUNTS, "psi", SHARES["raw", "service"], "1e-8", 4))
KL_SERVICE = (divergence_sql(NUM_BINS, "kl_divergence", SHARES["numeric", "service"], "1e-8") + "\nUNION ALL\n"
              + divergence_sql(CAT_COUNTS, "kl_divergence", SHARES["categorical", "service"], "1e-8"))


@query("psi_service", "K3", PSI_SERVICE)
def _(t):
    num = drift.divergence(drift.numeric_bins(t.drift_ref, t.drift_cur), "psi", "numeric", "service")
    cat = drift.divergence(drift.category_counts(t.drift_ref, t.drift_cur), "psi", "categorical", "service")
    return rounded(num).unionByName(rounded(cat, 4))


@query("kl_service", "K6", KL_SERVICE)
def _(t):
    num = drift.divergence(drift.numeric_bins(t.drift_ref, t.drift_cur), "kl_divergence", "numeric", "service")
    cat = drift.divergence(drift.category_counts(t.drift_ref, t.drift_cur), "kl_divergence", "categorical", "service")
    return rounded(num.unionByName(cat))


def own_bins_sql(cols) -> str:
    def side(c, src, s):
        return (f"SELECT least(floor((v - lo) / (hi - lo) * 10), 9)::BIGINT AS bin, {s} AS s FROM "
                f"(SELECT {c}::DOUBLE AS v, min({c}) OVER ()::DOUBLE AS lo, max({c}) OVER ()::DOUBLE AS hi FROM {src})")
    return union_all(f"""
SELECT '{c}' AS "column", g.b AS bin, count(*) FILTER (WHERE s = 1) AS r, count(*) FILTER (WHERE s = 0) AS c
FROM (SELECT unnest(range(10)) AS b) g LEFT JOIN ({side(c, DRIFT_REF, 1)} UNION ALL {side(c, DRIFT_CUR, 0)}) v
ON v.bin = g.b GROUP BY g.b""" for c in cols)


@query("psi_deployed", "K4", divergence_sql(own_bins_sql(LINEITEM_NUMERIC), "psi", SHARES["floored", "monitor"]))
def _(t):
    return rounded(drift.divergence(drift.numeric_bins(t.drift_ref, t.drift_cur, own_range=True), "psi", "numeric",
                                    "deployed"))


def ks_sql(cols) -> str:
    return union_all(f"""
SELECT '{c}' AS "column", (SELECT count(*) FROM {DRIFT_REF}) AS n_ref, (SELECT count(*) FROM {DRIFT_CUR}) AS n_cur,
  max(abs(cr / (SELECT count(*) FROM {DRIFT_REF}) - cc / (SELECT count(*) FROM {DRIFT_CUR}))) AS score
FROM (SELECT v, sum(r) OVER (ORDER BY v) AS cr, sum(c) OVER (ORDER BY v) AS cc FROM (
  SELECT v, sum(r) AS r, sum(c) AS c FROM (SELECT {c} AS v, 1 AS r, 0 AS c FROM {DRIFT_REF}
  UNION ALL SELECT {c}, 0, 1 FROM {DRIFT_CUR}) GROUP BY v))""" for c in cols)


@query("ks_two_sample", "K8", f'SELECT "column", n_ref, n_cur, round(score, 6) AS score FROM ({ks_sql(LINEITEM_NUMERIC)})')
def _(t):
    return rounded(drift.ks_two_sample(t.drift_ref, t.drift_cur).drop("p_value"))


CHI = f"""SELECT "column", round(sum(power(c + 1 - e, 2) / e), 6) AS score FROM (
SELECT *, (r + 1) * (ct + k) / (rt + k) AS e FROM (SELECT *, {TOTALS} FROM ({CAT_COUNTS}))) GROUP BY "column" """


@query("chi_square", "K9", CHI)
def _(t):
    return rounded(drift.chi_square(drift.category_counts(t.drift_ref, t.drift_cur)).drop("p_value"))


@query("detect_drift", "K10", f"""
SELECT "column", 'psi' AS method, score, 0.2 AS threshold, score >= 0.2 AS drift_detected
FROM ({divergence_sql(NUM_BINS, "psi", SHARES["numeric", "monitor"])} UNION ALL
{divergence_sql(CAT_COUNTS, "psi", SHARES["floored", "monitor"])})
UNION ALL SELECT "column", 'js_divergence', score, 0.1, score >= 0.1
FROM ({divergence_sql(NUM_BINS, "js_divergence", SHARES["numeric", "monitor"])} UNION ALL
{divergence_sql(CAT_COUNTS, "js_divergence", SHARES["categorical", "monitor"])})""")
def _(t):
    report = drift.detect_drift(t.drift_ref, t.drift_cur, ["psi", "js_divergence"])
    return rounded(report.select("column", "method", "score", "threshold", "drift_detected"))


@query("detect_drift_all_methods", "K10 H13")
def _(t):
    return drift.detect_drift(t.drift_ref, t.drift_cur, list(drift.THRESHOLDS), [
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])


@query("overall_drift", "K10", f"""
WITH s AS (SELECT "column", sum((q - p) * ln(q / p)) AS score FROM (SELECT "column", (r + 1) / (rt + k) AS p,
  (c + 1) / (ct + k) AS q FROM (SELECT *, {TOTALS} FROM ({NUM_BINS}))) GROUP BY "column")
SELECT bool_or(score >= 0.2) AS drift_detected, round(avg(score) FILTER (WHERE score >= 0.2), 6) AS overall_drift_score,
  string_agg("column", ',' ORDER BY "column") FILTER (WHERE score >= 0.2) AS columns_with_drift FROM s""")
def _(t):
    report = drift.detect_drift(t.drift_ref, t.drift_cur, ["psi"], LINEITEM_NUMERIC)
    return rounded(drift.overall_drift(report).withColumn("columns_with_drift", F.concat_ws(",", "columns_with_drift")))


CHECK = f"""
SELECT "column", 'numeric' AS kind, round(score, 4) AS score, NULL::BOOLEAN AS sums_match, round(score, 4) > 0.2 AS drift_detected
FROM ({ks_sql(LINEITEM_NUMERIC)})
UNION ALL
SELECT "column", 'categorical', round(least(chi / 100, 1), 4), true, round(least(chi / 100, 1), 4) > 0.2
FROM (SELECT "column", sum(power(c / ct - r / rt, 2) / (r / rt)) AS chi FROM (SELECT *, {TOTALS} FROM ({CAT_COUNTS}))
GROUP BY "column")"""


@query("check_drift", "K11", CHECK)
def _(t):
    return drift.check_drift(t.drift_ref, t.drift_cur)


@query("drift_health", "K14", f"""
SELECT max(score) AS max_drift, round(greatest(0, 100 - max(score) * 100), 2) AS health_score FROM ({CHECK})""")
def _(t):
    return rounded(drift.drift_health(drift.check_drift(t.drift_ref, t.drift_cur)))


@query("monitor_drift", "K12", f"""
SELECT p."column", round(p.score, 4) AS psi, round(k.score, 4) AS kl_divergence,
  abs(p.score) > 0.2 OR abs(k.score) > 0.2 AS adwin_drift, p.score > 0.2 OR k.score > 0.2 AS drift_detected
FROM ({PSI_SERVICE}) p JOIN ({KL_SERVICE}) k USING ("column")""")
def _(t):
    return rounded(drift.monitor_drift(t.drift_ref, t.drift_cur), 4)


@query("baseline_check", "K13")
def _(t):
    ref = t.drift_ref.select("l_quantity", "l_extendedprice", "l_discount", *TEXTS)
    shares = categories.value_shares(ref, "l_returnflag").select(F.lit("l_returnflag").alias("column"), "value", "share")
    return drift.baseline_check(summary.moments(ref), shares, t.drift_cur.select(*ref.columns))


DEG = """
WITH m AS (SELECT era, avg(power(a - p, 2)) AS mse, avg(abs(a - p)) AS mae,
  1 - sum(power(a - p, 2)) / (var_pop(a) * count(*)) AS r2_score
  FROM (SELECT l_shipdate < TIMESTAMP '1998-07-01' AS era, l_extendedprice AS a,
    CASE WHEN l_shipdate < TIMESTAMP '1998-07-01' THEN l_quantity ELSE l_quantity + 10 END * 2000 AS p FROM lineitem) GROUP BY era),
l AS (SELECT era, unnest(['mse', 'rmse', 'mae', 'r2_score']) AS metric, unnest([mse, sqrt(mse), mae, r2_score]) AS v FROM m),
j AS (SELECT b.metric, b.v AS baseline, c.v AS current,
  CASE WHEN b.metric = 'r2_score' THEN b.v - c.v ELSE c.v - b.v END AS change,
  CASE WHEN b.metric = 'r2_score' THEN 0.05 ELSE 0.1 END AS lim
  FROM l b JOIN l c USING (metric) WHERE b.era AND NOT c.era)
SELECT metric, round(baseline, 2) AS baseline, round(current, 2) AS current, round(change, 2) AS change,
  round(change / baseline * 100, 2) AS change_pct, round(lim * 100, 2) AS threshold_pct, change > baseline * lim AS degraded FROM j"""


@query("degradation", "K15", DEG)
def _(t):
    def scored(df):
        return long_metrics(regression_metrics(df.select(
            F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 2000).alias("pred")), "actual", "pred"))
    return rounded(drift.degradation(scored(t.drift_ref), scored(t.drift_cur)), 2)


@query("drift_alerts", "K16", f"""
SELECT 'shipping' AS model_id, 'psi' AS metric, round(score, 6) AS value, 0.2 AS threshold,
  CASE WHEN score / 0.2 >= 3 THEN 'HIGH' WHEN score / 0.2 >= 1.5 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  "column", '1998-07-01' AS detected_at
FROM ({divergence_sql(NUM_BINS, "psi", SHARES["numeric", "monitor"], digits=12)}) WHERE score >= 0.2""")
def _(t):
    report = drift.detect_drift(t.drift_ref, t.drift_cur, ["psi"], LINEITEM_NUMERIC)
    return rounded(drift.drift_alerts(report, "shipping", F.lit("1998-07-01")))
