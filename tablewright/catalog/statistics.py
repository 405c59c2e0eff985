"""Profile, summary, histogram, correlation and category queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.registry import query, rounded
from tablewright.catalog.tables import (LINEITEM_DUP, LINEITEM_N, LINEITEM_N_COLUMNS, LINEITEM_N_NUMERIC,
                                        LINEITEM_NUMERIC, union_all)
from tablewright.functions.columns import select_kind
from tablewright.operators import categories, correlation, histograms, summary
from tablewright.plans import profile as prof

LINEITEM_TYPES = [("l_orderkey", "bigint", "numeric"), ("l_partkey", "bigint", "numeric"),
                  ("l_suppkey", "bigint", "numeric"), ("l_linenumber", "int", "numeric"),
                  ("l_quantity", "double", "numeric"), ("l_extendedprice", "double", "numeric"),
                  ("l_discount", "double", "numeric"), ("l_tax", "double", "numeric"),
                  ("l_returnflag", "string", "categorical"), ("l_linestatus", "string", "categorical"),
                  ("l_shipdate", "timestamp_ntz", "datetime")]


def kind(t: str) -> str:
    return "categorical" if t == "string" else "datetime" if t.startswith("timestamp") else "numeric"


N_TYPES = [(c, t, kind(t)) for c, t in LINEITEM_N_COLUMNS.items()]


def profile_sql(source: str, types) -> str:
    parts = []
    for i, (c, t, k) in enumerate(types):
        num = k == "numeric"

        def q(e: str, digits: int = 6) -> str:
            return f"round({e}, {digits})" if num else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS \"column\", '{t}' AS dtype, '{k}' AS kind, "
            f"count(*) AS n_rows, count(*) - count({c}) AS nulls, "
            f"round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct, "
            f"count(DISTINCT {c}) AS n_unique, {q(f'avg({c})', 4)} AS mean, {q(f'stddev_samp({c})')} AS std, "
            f"{q(f'CAST(min({c}) AS DOUBLE)')} AS min, {q(f'quantile_cont({c}, 0.25)')} AS q25, "
            f"{q(f'quantile_cont({c}, 0.5)')} AS median, {q(f'quantile_cont({c}, 0.75)')} AS q75, "
            f"{q(f'CAST(max({c}) AS DOUBLE)')} AS max FROM {source}")
    return union_all(parts)


@query("profile", "I1 D1 D2 D3 A3", profile_sql("lineitem", LINEITEM_TYPES))
def _(t):
    return rounded(prof.profile(t.lineitem), mean=4)


@query("profile_with_nulls", "I1 D1 D2 D3", profile_sql(LINEITEM_N, N_TYPES))
def _(t):
    return rounded(prof.profile(t.lineitem_n), mean=4)


@query("profile_summary", "I1 D7 D8", f"""
WITH s AS {LINEITEM_N}, d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM s))
SELECT count(*) AS n_rows, CAST(9 AS BIGINT) AS n_columns, CAST(6 AS BIGINT) AS numeric_columns,
  CAST(2 AS BIGINT) AS categorical_columns, CAST(1 AS BIGINT) AS datetime_columns,
  count(*) - (SELECT n FROM d) AS duplicate_rows,
  round((1 - CAST({" + ".join(f"(count(*) - count({c}))" for c in LINEITEM_N_COLUMNS)} AS DOUBLE)
    / (count(*) * 9)) * 100, 6) AS completeness_pct FROM s""")
def _(t):
    return rounded(prof.profile_summary(t.lineitem_n))


def summary_sql(source: str, cols) -> str:
    return union_all(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, "
        f"round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS median, "
        f"round(quantile_cont({c}, 0.75), 6) AS q75 FROM {source}" for c in cols)


@query("numeric_summary", "D1", summary_sql(LINEITEM_N, LINEITEM_N_NUMERIC))
def _(t):
    return rounded(summary.numeric_summary(t.lineitem_n))


@query("null_counts", "D2", union_all(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS nulls, "
    f"round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct FROM {LINEITEM_N}" for c in LINEITEM_N_COLUMNS))
def _(t):
    return rounded(summary.null_counts(t.lineitem_n))


@query("distinct_counts", "D3", union_all(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique FROM {LINEITEM_N}" for c in LINEITEM_N_COLUMNS))
def _(t):
    return summary.distinct_counts(t.lineitem_n)


@query("value_counts", "D4 F3", """
SELECT p_type AS value, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY p_type
ORDER BY n DESC, value LIMIT 10""")
def _(t):
    return categories.value_counts(t.part, "p_type", 10)


@query("top_values", "D4 I1", union_all(f"""
SELECT * FROM (SELECT '{c}' AS "column", {c} AS value, count(*) AS n,
  row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM part GROUP BY {c}) WHERE rank <= 10"""
                                        for c in ["p_name", "p_brand", "p_type"]))
def _(t):
    return rounded(prof.profile_top_values(t.part))


@query("value_shares", "D5", f"""
SELECT l_returnflag AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM {LINEITEM_N} WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""")
def _(t):
    return rounded(categories.value_shares(t.lineitem_n, "l_returnflag"))


@query("value_shares_of_all_rows", "D5", f"""
SELECT l_returnflag AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM {LINEITEM_N}), 6) AS share
FROM {LINEITEM_N} WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""")
def _(t):
    return rounded(categories.value_shares(t.lineitem_n, "l_returnflag", of_all_rows=True))


@query("modes", "D6", union_all(f"""
SELECT * FROM (SELECT '{c}' AS "column", {c} AS mode, count(*) AS n FROM {LINEITEM_N} WHERE {c} IS NOT NULL
GROUP BY {c} ORDER BY n DESC, mode LIMIT 1)""" for c in ["l_returnflag", "l_linestatus"]))
def _(t):
    return categories.modes(t.lineitem_n, ["l_returnflag", "l_linestatus"])


@query("duplicate_rows", "D7", f"""
SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM {LINEITEM_DUP})) AS n_distinct,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {LINEITEM_DUP})) AS duplicate_rows FROM {LINEITEM_DUP}""")
def _(t):
    return summary.duplicate_rows(t.lineitem_dup)


@query("completeness", "D8", f"""
SELECT {" + ".join(f"(count(*) - count({c}))" for c in LINEITEM_N_COLUMNS)} AS missing_cells, count(*) * 9 AS cells,
  round((1 - CAST({" + ".join(f"(count(*) - count({c}))" for c in LINEITEM_N_COLUMNS)} AS DOUBLE)
  / (count(*) * 9)) * 100, 6) AS completeness_pct FROM {LINEITEM_N}""")
def _(t):
    return rounded(summary.completeness(t.lineitem_n))


@query("shape", "D9", union_all(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, round(skewness({c}), 6) AS skewness, "
    f"round(kurtosis({c}), 6) AS kurtosis FROM {LINEITEM_N}" for c in LINEITEM_N_NUMERIC))
def _(t):
    return rounded(summary.shape(t.lineitem_n))


@query("percentiles", "D10", union_all(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, round(quantile_cont({c}, 0.25), 6) AS p25, "
    f"round(quantile_cont({c}, 0.75), 6) AS p75, round(quantile_cont({c}, 0.95), 6) AS p95 FROM {LINEITEM_N}"
    for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def _(t):
    return rounded(summary.percentiles(t.lineitem_n, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                                       {"p25": 0.25, "p75": 0.75, "p95": 0.95}))


@query("percentiles_infinite", "D10 H10", """
WITH x AS (SELECT CASE WHEN l_partkey % 10 = 0 THEN 'inf'::DOUBLE WHEN l_partkey % 10 = 1 THEN '-inf'::DOUBLE ELSE l_extendedprice END AS price
FROM lineitem)
SELECT 'price' AS "column", count(*) AS n, round(quantile_cont(price, 0.25), 6) AS p25, round(quantile_cont(price, 0.75), 6) AS p75,
  round(quantile_cont(price, 0.8), 6) AS p80 FROM x""")
def _(t):
    part = F.col("l_partkey") % 10
    price = (F.when(part == 0, F.lit(float("inf"))).when(part == 1, F.lit(float("-inf"))).otherwise(F.col("l_extendedprice")))
    return rounded(summary.percentiles(t.lineitem.select(price.alias("price")), ["price"], {"p25": 0.25, "p75": 0.75, "p80": 0.8}))


def histogram_sql(source: str, cols, bins: int = 20) -> str:
    """NumPy's rule in SQL: a guess by division, corrected against the edges."""
    return union_all(f"""
SELECT '{c}' AS "column", CAST(g.b AS BIGINT) AS bin, round(r.lo + g.b * ((r.hi - r.lo) / {bins}), 6) AS bin_start,
  round(r.lo + (g.b + 1) * ((r.hi - r.lo) / {bins}), 6) AS bin_end, count(v.v) AS n
FROM (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {source}) r
CROSS JOIN (SELECT unnest(range({bins})) AS b) g
LEFT JOIN (SELECT CAST({c} AS DOUBLE) AS v FROM {source} WHERE {c} IS NOT NULL) v
  ON v.v >= r.lo + g.b * ((r.hi - r.lo) / {bins})
  AND (g.b = {bins - 1} OR v.v < r.lo + (g.b + 1) * ((r.hi - r.lo) / {bins}))
GROUP BY g.b, r.lo, r.hi""" for c in cols)


@query("histogram", "D11", histogram_sql(LINEITEM_N, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def _(t):
    return rounded(histograms.histogram(t.lineitem_n, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


def pairs_sql(source: str, cols) -> str:
    return union_all(
        f"SELECT '{a}' AS feature1, '{b}' AS feature2, corr({a}, {b}) AS correlation FROM {source}"
        for i, a in enumerate(cols) for b in cols[i + 1:])


PAIRS = pairs_sql(LINEITEM_N, LINEITEM_N_NUMERIC)
STRENGTH = ("CASE WHEN abs(correlation) >= 0.7 THEN 'Strong' WHEN abs(correlation) >= 0.4 THEN 'Moderate' "
            "ELSE 'Weak' END")


@query("correlation_matrix", "D12", f"""
WITH p AS ({PAIRS})
SELECT feature1, feature2, round(correlation, 6) AS correlation FROM p
UNION ALL SELECT feature2, feature1, round(correlation, 6) FROM p
UNION ALL SELECT unnest([{", ".join(f"'{c}'" for c in LINEITEM_N_NUMERIC)}]) AS a, a, 1.0""")
def _(t):
    return rounded(correlation.correlation_matrix(t.lineitem_n))


@query("top_correlations", "D13", f"""
WITH p AS ({PAIRS})
SELECT feature1, feature2, round(correlation, 6) AS correlation, {STRENGTH} AS strength,
  CASE WHEN correlation > 0 THEN 'Positive' ELSE 'Negative' END AS direction
FROM p ORDER BY abs(p.correlation) DESC, feature1, feature2 LIMIT 10""")
def _(t):
    return rounded(correlation.top_correlations(t.lineitem_n))


DERIVED = ("(SELECT o_totalprice, o_totalprice * 0.1 + o_custkey AS levy, o_custkey, "
           "-o_totalprice + 5.0 * (o_orderkey % 50) AS rest FROM orders)")


def derived_orders(t):
    return t.orders.select(
        "o_totalprice", (F.col("o_totalprice") * 0.1 + F.col("o_custkey")).alias("levy"), "o_custkey",
        (-F.col("o_totalprice") + 5.0 * (F.col("o_orderkey") % 50)).alias("rest"))


@query("high_correlations", "D14", f"""
SELECT feature1, feature2, round(correlation, 6) AS correlation
FROM ({pairs_sql(DERIVED, ["o_totalprice", "levy", "o_custkey", "rest"])}) WHERE abs(correlation) > 0.8""")
def _(t):
    return rounded(correlation.high_correlations(derived_orders(t), 0.8))


@query("correlation_with_target", "D15", f"""
SELECT * FROM ({union_all(
    f"SELECT '{c}' AS " + '"column"' + f", round(abs(corr({c}, l_extendedprice)), 6) AS abs_correlation FROM lineitem"
    for c in LINEITEM_NUMERIC)}) ORDER BY abs_correlation DESC, "column" LIMIT 3""")
def _(t):
    return rounded(correlation.correlation_with_target(t.lineitem, "l_extendedprice"))


@query("crosstab", "D16", f"""
WITH s AS (SELECT * FROM {LINEITEM_N} WHERE l_returnflag IS NOT NULL),
c AS (SELECT l_returnflag AS category, l_linestatus AS target, count(*) AS n FROM s GROUP BY ALL)
SELECT a.category, b.target, coalesce(c.n, 0) AS n,
  round(coalesce(c.n, 0) * 100.0 / sum(coalesce(c.n, 0)) OVER (PARTITION BY a.category), 6) AS row_pct
FROM (SELECT DISTINCT category FROM c) a CROSS JOIN (SELECT DISTINCT target FROM c) b LEFT JOIN c USING (category, target)
""")
def _(t):
    return rounded(categories.crosstab(t.lineitem_n, "l_returnflag", "l_linestatus"))


@query("crosstab_wide", "D16", """
SELECT o_orderpriority AS category, round(avg((o_orderstatus = 'F')::INT) * 100, 6) AS F,
  round(avg((o_orderstatus = 'O')::INT) * 100, 6) AS O, round(avg((o_orderstatus = 'P')::INT) * 100, 6) AS P
FROM orders GROUP BY o_orderpriority""")
def _(t):
    return rounded(categories.crosstab_wide(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"]))


@query("by_target", "D17", union_all(
    f"SELECT l_returnflag AS target, '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, "
    f"round(stddev_samp({c}), 6) AS std, round(median({c}), 6) AS median FROM {LINEITEM_N} "
    f"WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag" for c in ["l_quantity", "l_extendedprice", "l_tax"]))
def _(t):
    return rounded(categories.by_target(t.lineitem_n, "l_returnflag", ["l_quantity", "l_extendedprice", "l_tax"]))


@query("class_balance", "D18", """
SELECT count(*) AS n_classes, min(n) AS min_class, max(n) AS max_class, round(min(n) * 100.0 / max(n), 6) AS balance_pct,
  round(max(n) / min(n), 6) AS imbalance_ratio
FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)""")
def _(t):
    return rounded(categories.class_balance(t.events, "event_type"))


SQUARES = "(SELECT value, value * value AS squared, value * value * value AS cubed FROM events)"


def squares(t):
    v = F.col("value")
    return t.events.select("value", (v * v).alias("squared"), (v * v * v).alias("cubed"))


def bounds_sql(source: str, c: str) -> str:
    return (f"SELECT min({c}) AS mn, max({c}) AS mx, median({c}) AS md, quantile_cont({c}, 0.25) AS q1, "
            f"quantile_cont({c}, 0.75) AS q3, avg({c}) AS mean, stddev_samp({c}) AS std, count({c}) AS n FROM {source}")


@query("outliers_iqr", "D19", union_all(f"""
SELECT '{c}' AS "column", count(*) AS n, round(q1 - 1.5 * (q3 - q1), 6) AS lower_bound,
  round(q3 + 1.5 * (q3 - q1), 6) AS upper_bound,
  count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers,
  round(count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*), 6)
    AS outlier_pct
FROM {SQUARES} CROSS JOIN ({bounds_sql(SQUARES, c)}) GROUP BY q1, q3""" for c in ["value", "squared", "cubed"]))
def _(t):
    return rounded(summary.outliers_iqr(squares(t)))


@query("box_plots", "D20", union_all(f"""
SELECT '{c}' AS "column", n, round(mean, 6) AS mean, round(std, 4) AS std, round(mn, 6) AS min, round(mx, 6) AS max,
  round(q1, 6) AS q25, round(md, 6) AS median, round(q3, 6) AS q75, round(q1 - 1.5 * (q3 - q1), 6) AS lower_bound,
  round(q3 + 1.5 * (q3 - q1), 6) AS upper_bound, round(greatest(mn, q1 - 1.5 * (q3 - q1)), 6) AS lower_fence,
  round(least(mx, q3 + 1.5 * (q3 - q1)), 6) AS upper_fence FROM ({bounds_sql(SQUARES, c)})"""
                                     for c in ["value", "squared", "cubed"]))
def _(t):
    return rounded(summary.box_plots(squares(t)), std=4)


@query("entity_count", "D21", """
SELECT count(*) AS entity_count FROM (SELECT DISTINCT user_id, event_type FROM events)""")
def _(t):
    return summary.entity_count(t.events, ["user_id", "event_type"])


@query("top_variance", "D22", f"""
SELECT * FROM ({union_all(f"SELECT '{c}' AS " + '"column"' + f", round(var_samp({c}), 2) AS variance FROM {LINEITEM_N}"
                          for c in LINEITEM_N_NUMERIC)}) ORDER BY variance DESC LIMIT 4""")
def _(t):
    return rounded(summary.top_variance(t.lineitem_n, 4), 2)


@query("high_variance_count", "D22 I15", f"""
WITH v AS ({union_all(f"SELECT var_samp({c}) AS variance FROM {LINEITEM_N}" for c in LINEITEM_N_NUMERIC)}),
m AS (SELECT median(variance) AS m FROM v)
SELECT round(any_value(m), 4) AS median_variance, count(*) FILTER (WHERE variance > m * 10) AS high_variance_features
FROM v CROSS JOIN m""")
def _(t):
    return rounded(summary.high_variance_count(t.lineitem_n, LINEITEM_N_NUMERIC), 4)


@query("distributions", "I9 D9 H20", union_all(f"""
SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max,
  round(quantile_cont({c}, 0.25), 6) AS q25, round(median({c}), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75,
  round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis,
  round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr,
  CASE WHEN abs(skewness({c})) < 0.5 THEN 'Normal (Symmetric)' WHEN skewness({c}) > 0.5 THEN 'Right-skewed (Positive)'
  ELSE 'Left-skewed (Negative)' END AS distribution_type FROM {SQUARES}""" for c in ["value", "squared"]))
def _(t):
    return rounded(summary.distributions(squares(t).drop("cubed")))


@query("numeric_columns_only", "B1", f"""
SELECT {", ".join(f"round(sum({c}), 2) AS {c}" for c in ["c_custkey", "c_nationkey", "c_acctbal"])} FROM customer""")
def _(t):
    numeric = select_kind(t.customer, "numeric")
    return rounded(numeric.agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in numeric.columns]), 2)


@query("share_of_total", "E11", """
SELECT event_type AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM events GROUP BY event_type""")
def _(t):
    return rounded(categories.share_of_total(categories.value_counts(t.events, "event_type"), "n"))


@query("category_changes", "G4 C3", """
WITH a AS (SELECT o_orderpriority AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-07-01' AND o_orderpriority <> '5-LOW'),
b AS (SELECT o_orderpriority AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderpriority <> '1-URGENT')
SELECT value, sum(r)::BIGINT AS ref_n, sum(c)::BIGINT AS cur_n,
  CASE WHEN sum(r) = 0 THEN 'new' WHEN sum(c) = 0 THEN 'vanished' ELSE 'common' END AS status
FROM (SELECT v AS value, 1 AS r, 0 AS c FROM a UNION ALL SELECT v, 0, 1 FROM b) GROUP BY value""")
def _(t):
    cut = F.lit("1998-07-01").cast("timestamp_ntz")
    old = t.orders.where((F.col("o_orderdate") < cut) & (F.col("o_orderpriority") != "5-LOW"))
    new = t.orders.where((F.col("o_orderdate") >= cut) & (F.col("o_orderpriority") != "1-URGENT"))
    return categories.category_changes(old, new, "o_orderpriority")


@query("content_hash", "D34")
def _(t):
    return summary.content_hash(t.lineitem)
