"""Sources and sinks, projections, joins, ordered operators, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.registry import query, rounded
from tablewright.catalog.tables import SCORED_MULTI, union_all
from tablewright.operators import joins, operations, ordered, sampling, trends
from tablewright.operators.evaluation import classification_metrics
from tablewright.sources import feature_sets, logs, tables

SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


@query("scan_csv", "A1 A4 A5", SUPPLIER)
def _(t):
    path = tables.write(t.supplier, tables.scratch_dir(t.spark, "supplier.csv"))
    return tables.load(t.spark, path)


@query("scan_json", "A2 A4", SUPPLIER)
def _(t):
    path = tables.scratch_dir(t.spark, "supplier.json")
    t.supplier.write.json(path)
    return tables.load(t.spark, path)


@query("scan_parquet", "A3 A4 A5", "SELECT * FROM customer")
def _(t):
    path = tables.write(t.customer, tables.scratch_dir(t.spark, "customer.parquet"))
    return tables.load(t.spark, path)


@query("load_many", "A6 G1", """
SELECT c_custkey AS key, c_name AS name, c_acctbal, NULL::DOUBLE AS s_acctbal FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), "c_acctbal")
    b = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), "s_acctbal")
    return tables.load_many(t.spark, [tables.write(x, tables.scratch_dir(t.spark, name)) for x, name in ((a, "first.parquet"), (b, "second.parquet"))])


@query("source_counts", "A6", union_all(f"SELECT '{n}' AS source, count(*) AS n_rows FROM {n}" for n in ("orders", "lineitem", "events")))
def _(t):
    return tables.source_counts({"orders": t.orders, "lineitem": t.lineitem, "events": t.events})


@query("dataset_columns", "A7", """
SELECT unnest([0, 1, 2, 3]) AS position, unnest(['s_suppkey', 's_name', 's_nationkey', 's_acctbal']) AS "column",
  unnest(['bigint', 'string', 'int', 'double']) AS dtype FROM (SELECT count(*) FROM supplier)""")
def _(t):
    return tables.dataset_columns(t.spark, t.path("supplier"))


@query("feature_set_round_trip", "A8 B3 B4", "SELECT event_id, user_id, value FROM events WHERE event_type IN ('click', 'view')")
def _(t):
    store = feature_sets.FeatureStore(t.spark, tables.scratch_dir(t.spark, "features"))
    store.write("activity", t.events.select("event_id"), ["event_id"])
    store.write("activity", t.events, ["event_id"], "ts")
    return store.read("activity", columns=["user_id", "value", "not_there"], entities=["event_id"],
                      where={"event_type": ["click", "view"], "unknown": 1})


@query("feature_catalogue", "A8", """
WITH c AS (SELECT 'activity' AS name, 2 AS version, name AS "column" FROM pragma_table_info('events')
  UNION ALL SELECT 'money', 1, name FROM pragma_table_info('orders') WHERE name IN ('o_custkey', 'o_totalprice'))
SELECT c.*, "column" IN ('event_id', 'o_custkey') AS is_entity, (SELECT count(*) FROM events) + (SELECT count(*) FROM orders) AS n_rows FROM c""")
def _(t):
    store = feature_sets.FeatureStore(t.spark, tables.scratch_dir(t.spark, "catalogue"))
    store.write("activity", t.events.select("event_id"), ["event_id"])
    store.write("activity", t.events, ["event_id"], "ts")
    store.write("money", t.orders.select("o_custkey", "o_totalprice"), ["o_custkey"])
    total = store.sets().agg(F.sum("n_rows").alias("n_rows"))
    return rounded(store.features().drop("dtype").crossJoin(F.broadcast(total)))


@query("performance_summary", "E4 K15", """
WITH e AS (SELECT CASE event_type WHEN 'click' THEN 'accuracy' WHEN 'view' THEN 'rmse' ELSE event_type END AS metric, ts::DATE AS d, value FROM events),
h AS (SELECT metric, d, avg(value) AS v FROM e GROUP BY ALL), b AS (SELECT metric, avg(value) AS b FROM e GROUP BY metric),
c AS (SELECT metric, arg_max(v, d) AS c FROM h GROUP BY metric),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY d DESC) AS r FROM h QUALIFY r <= 10),
s AS (SELECT metric, count(*) AS points, regr_slope(v, -r) AS slope FROM r GROUP BY metric),
x AS (SELECT *, CASE WHEN metric = 'accuracy' THEN b - c ELSE c - b END AS ch, CASE WHEN metric = 'accuracy' THEN 0.05 ELSE 0.1 END AS lim
  FROM b JOIN c USING (metric) JOIN s USING (metric))
SELECT metric, round(b, 4) AS baseline, round(c, 4) AS current, round(ch / b * 100, 4) AS change_pct, ch > b * lim AS degraded, points, round(slope, 4) AS slope,
  CASE WHEN points < 2 THEN 'unknown' WHEN abs(slope) < 0.001 THEN 'stable' WHEN (slope > 0) = (metric = 'accuracy') THEN 'improving' ELSE 'degrading' END AS trend FROM x""")
def _(t):
    from tablewright.operators.trends import performance_summary
    kind = F.when(F.col("event_type") == "click", "accuracy").when(F.col("event_type") == "view", "rmse").otherwise(F.col("event_type"))
    rows = t.events.select(kind.alias("metric"), F.col("ts").cast("date").alias("at"), "value")
    history = rows.groupBy("metric", "at").agg(F.avg("value").alias("value"))
    return rounded(performance_summary(rows.groupBy("metric").agg(F.avg("value").alias("value")), history), 4)


@query("jsonl_log_source", "A9", """
SELECT event_type AS level, count(*) AS n FROM events GROUP BY event_type""")
def _(t):
    path = tables.scratch_dir(t.spark, "logs")
    lines = t.events.select(F.to_json(F.struct(
        F.col("ts").cast("string").alias("timestamp"), F.col("event_type").alias("level"), F.lit("m").alias("message"))).alias("value"))
    broken = t.events.select(F.concat(F.lit("{broken "), F.col("event_id").cast("string")).alias("value"))
    lines.unionByName(broken).write.text(path)
    return logs.read_jsonl(t.spark, path).groupBy("level").agg(F.count("timestamp").alias("n"))


@query("entity_filter", "B4", "SELECT * FROM customer WHERE c_nationkey IN (3, 4, 5) AND c_mktsegment = 'BUILDING'")
def _(t):
    return joins.entity_filter(t.customer, {"c_nationkey": [3, 4, 5], "c_mktsegment": "BUILDING", "nope": 1})


@query("select_features", "B3", "SELECT c_custkey, c_acctbal FROM customer")
def _(t):
    return joins.select_features(t.customer, ["c_custkey"], ["c_acctbal", "c_missing"])


@query("time_range_filter", "B6", """
SELECT event_id, event_type FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOURS""")
def _(t):
    newest = t.events.agg(F.max("ts").alias("__as_of"))
    return (operations.since(t.events.crossJoin(F.broadcast(newest)), "ts", F.col("__as_of"), 24).select("event_id", "event_type"))


@query("task_list", "B10 F1", """
SELECT o_orderkey AS id, o_orderpriority AS type, o_orderdate::VARCHAR AS created_at FROM orders WHERE o_orderpriority = '1-URGENT'
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def _(t):
    tasks = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), F.col("o_orderdate").alias("created_at"))
    return operations.task_list(tasks, "1-URGENT").withColumn("created_at", F.col("created_at").cast("string"))


# -- joins ----------------------------------------------------------------------------------

@query("feature_join", "C1", """
SELECT o_custkey AS c_custkey, o_orderkey, c_acctbal, c_nationkey FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING')
ON c_custkey = o_custkey""")
def _(t):
    left = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.feature_join(left, t.customer.where("c_mktsegment <> 'BUILDING'"), ["c_custkey"], ["c_acctbal", "c_nationkey"])


PIT = """(SELECT e.event_id, e.user_id, e.ts, f.value AS value, f.event_type AS feature_type
FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'purchase') f
ON e.user_id = f.user_id AND e.ts >= f.ts)"""


@query("point_in_time_join", "C2", f"SELECT event_id, user_id, value, feature_type FROM {PIT}")
def _(t):
    left = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = t.events.where("event_type <> 'purchase'").select("user_id", "ts", "value", F.col("event_type").alias("feature_type"))
    return joins.point_in_time_join(left, right, ["user_id"], "ts", ["value", "feature_type"]).drop("ts")


@query("point_in_time_orders", "C2", """
SELECT o_orderkey, o_custkey, previous FROM (
SELECT o.o_orderkey, o.o_custkey, f.o_totalprice AS previous FROM orders o ASOF LEFT JOIN
  (SELECT o_custkey, o_orderdate, max(o_totalprice) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) f
ON o.o_custkey = f.o_custkey AND o.o_orderdate >= f.o_orderdate)""")
def _(t):
    right = t.orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderdate", F.col("o_totalprice").alias("previous"))
    left = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return joins.point_in_time_join(left, right, ["o_custkey"], "o_orderdate", bucket_seconds=90 * 86_400).drop("o_orderdate")


@query("common_columns", "C6", """
SELECT 'r' AS side, count(*) AS n FROM orders UNION ALL SELECT 'c', count(*) FROM orders WHERE o_orderstatus = 'F'""")
def _(t):
    from tablewright.operators.drift import tagged
    cols = joins.common_columns(t.orders, t.orders.drop("o_custkey"))
    both = tagged(t.orders, t.orders.where("o_orderstatus = 'F'").drop("o_custkey"), cols)
    return both.groupBy(F.when(F.col("is_ref") == 1, "r").otherwise("c").alias("side")).agg(F.count(F.lit(1)).alias("n"))


# -- ordered ------------------------------------------------------------------------------

@query("latest_per_entity", "E1", """
SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value FROM events GROUP BY user_id""")
def _(t):
    return joins.online_features(t.events.select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], "ts").drop("ts")


@query("metric_trend", "E4", """
WITH h AS (SELECT o_orderpriority AS metric, o_orderdate AS tm, avg(o_totalprice) / 100 AS value FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY tm DESC) AS rn FROM h QUALIFY rn <= 10),
a AS (SELECT metric, count(*) AS points, regr_slope(value, -rn) AS slope, arg_max(value, tm) AS current, min(value) AS min, max(value) AS max, avg(value) AS mean
  FROM r GROUP BY metric)
SELECT metric, points, round(slope, 6) AS slope, round(current, 6) AS current, round(min, 6) AS min, round(max, 6) AS max, round(mean, 6) AS mean,
  CASE WHEN points < 2 THEN 'unknown' WHEN abs(slope) < 0.001 THEN 'stable' WHEN slope > 0 THEN 'degrading' ELSE 'improving' END AS trend FROM a""")
def _(t):
    history = t.orders.groupBy(F.col("o_orderpriority").alias("metric"), F.col("o_orderdate").alias("at")).agg(
        (F.avg("o_totalprice") / 100).alias("value"))
    return rounded(trends.metric_trend(history))


@query("recent_performance", "E5", f"""
WITH s AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM {SCORED_MULTI} JOIN (SELECT o_orderkey, o_orderdate FROM orders) USING (o_orderkey)
  QUALIFY rn <= 1000),
c AS (SELECT DISTINCT actual AS c FROM s UNION SELECT DISTINCT pred FROM s),
m AS (SELECT c.c, (SELECT count(*) FROM s WHERE actual = c.c) AS sup, (SELECT count(*) FROM s WHERE pred = c.c) AS q,
  (SELECT count(*) FROM s WHERE actual = c.c AND pred = c.c) AS tp FROM c),
p AS (SELECT *, coalesce(tp / nullif(q, 0), 0) AS p, coalesce(tp / nullif(sup, 0), 0) AS r FROM m)
SELECT 'm' AS model, round(sum(tp) / sum(sup), 6) AS accuracy, round(sum(sup * p) / sum(sup), 6) AS precision, round(sum(sup * r) / sum(sup), 6) AS recall,
  round(sum(sup * coalesce(2 * p * r / nullif(p + r, 0), 0)) / sum(sup), 6) AS f1_score, sum(sup)::BIGINT AS sample_count FROM p""")
def _(t):
    scored = t.scored_multi.join(t.orders.select("o_orderkey", "o_orderdate"), "o_orderkey").withColumn("model", F.lit("m"))
    newest = ordered.last_n(scored, ["model"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 1000)
    return rounded(classification_metrics(newest, by=["model"]).where("sample_count >= 10"))


@query("rolling_performance", "E5", f"""
SELECT o_orderkey, round(avg((actual = pred)::INT) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey
  ROWS BETWEEN 999 PRECEDING AND CURRENT ROW), 6) AS accuracy
FROM {SCORED_MULTI} JOIN (SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders) USING (o_orderkey)""")
def _(t):
    scored = t.scored_multi.join(t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority"), "o_orderkey")
    hit = F.avg((F.col("actual") == F.col("pred")).cast("int"))
    out = ordered.rolling(scored, ["o_orderpriority"], "o_orderdate", ["o_orderkey"], 1000, {"accuracy": hit},
                          seconds=30 * 86_400)
    return rounded(out.select("o_orderkey", "accuracy"))


@query("previous_value", "E7 E10", """
SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events""")
def _(t):
    out = ordered.previous_value(t.events.select("user_id", "ts", "event_id"), ["user_id"], "ts", ["event_id"], "event_id", "previous")
    return out.select("event_id", "previous")


@query("previous_value_nulls", "E7", """
SELECT event_id, lag(v) OVER w AS previous, lead(v) OVER w AS following
FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN event_id END AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _(t):
    v = F.when(F.col("event_id") % 3 != 0, F.col("event_id"))
    out = t.events.select("user_id", "ts", "event_id", v.alias("v"))
    for step, name in ((ordered.previous_value, "previous"), (ordered.next_value, "following")):
        out = step(out, ["user_id"], "ts", ["event_id"], "v", name)
    return out.select("event_id", "previous", "following")


@query("row_numbers", "E5", """
SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events""")
def _(t):
    return ordered.row_numbers(t.events.select("event_type", "ts", "event_id"), ["event_type"], "ts", ["event_id"]).select("event_id", "rn")


# -- sampling -------------------------------------------------------------------------------

@query("sample_n", "F5", "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def _(t):
    return sampling.sample_n(t.documents.select("doc_id", "lang"), "doc_id", 100)


@query("scatter_samples", "F4", """
WITH p AS (SELECT 'value' AS a, 'cubed' AS b, corr(value, value * value * value) AS r FROM events UNION ALL
  SELECT 'value', 'squared', corr(value, value * value) FROM events UNION ALL SELECT 'squared', 'cubed', corr(value * value, value * value * value) FROM events)
SELECT a AS feature1, b AS feature2, round(r, 6) AS correlation, CASE a WHEN 'value' THEN value ELSE round(value * value, 6) END AS x,
  CASE b WHEN 'squared' THEN round(value * value, 6) ELSE round(value * value * value, 6) END AS y
FROM p CROSS JOIN (SELECT * FROM events ORDER BY md5(event_id::VARCHAR) LIMIT 500)""")
def _(t):
    from tablewright.operators.correlation import scatter_samples
    v = F.col("value")
    df = t.events.select("event_id", "value", (v * v).alias("squared"), (v * v * v).alias("cubed"))
    return rounded(scatter_samples(df, "event_id", cols=["value", "squared", "cubed"]))


@query("train_test_split", "F6", """
SELECT o_orderkey, CASE WHEN ('0x' || substr(md5('42:' || o_orderkey), 1, 8))::BIGINT % 10000 < 2000 THEN 'test' ELSE 'train' END AS side FROM orders""")
def _(t):
    train, test = sampling.train_test_split(t.orders.select("o_orderkey"), "o_orderkey")
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
