"""Imputation, encoding, scaling, checks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.registry import query, rounded
from tablewright.catalog.tables import LINEITEM_DUP, LINEITEM_N, union_all
from tablewright.functions import text
from tablewright.functions.labels import display_round
from tablewright.operators import checks, cleaning, summary

KEYS = "l_orderkey, l_linenumber, l_extendedprice"


@query("impute_mean", "J1", f"""
SELECT {KEYS}, round(coalesce(l_discount, avg(l_discount) OVER ()), 6) AS l_discount,
  round(coalesce(l_tax, avg(l_tax) OVER ()), 6) AS l_tax FROM {LINEITEM_N}""")
def _(t):
    df = t.lineitem_n.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    return rounded(cleaning.impute(df, ["l_discount", "l_tax"], "mean"))


@query("impute_median", "J1 J2", f"""
SELECT {KEYS}, coalesce(l_quantity, (SELECT median(l_quantity) FROM {LINEITEM_N})) AS l_quantity,
  coalesce(l_discount, (SELECT median(l_discount) FROM {LINEITEM_N})) AS l_discount,
  coalesce(l_tax, (SELECT median(l_tax) FROM {LINEITEM_N})) AS l_tax FROM {LINEITEM_N}""")
def _(t):
    df = t.lineitem_n.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return rounded(cleaning.fill_na_median(df))


@query("impute_most_frequent", "J1 J2", f"""
SELECT {KEYS}, coalesce(l_returnflag, (SELECT l_returnflag FROM {LINEITEM_N} WHERE l_returnflag IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag FROM {LINEITEM_N}""")
def _(t):
    return rounded(cleaning.fill_na_mode(t.lineitem_n.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")))


@query("fill_median_then_zero", "J3", f"""
SELECT l_linestatus, round(sum(coalesce(l_tax, (SELECT median(l_tax) FROM {LINEITEM_N}))), 4) AS tax, sum(0.0)::DOUBLE AS empty,
  count(*) AS n FROM {LINEITEM_N} GROUP BY l_linestatus""")
def _(t):
    df = t.lineitem_n.select("l_linestatus", "l_tax", F.lit(None).cast("double").alias("empty"))
    filled = cleaning.fill_median_then_zero(df)
    return rounded(filled.groupBy("l_linestatus").agg(
        F.sum("l_tax").alias("tax"), F.sum("empty").alias("empty"), F.count(F.lit(1)).alias("n")), 4)


@query("one_hot", "J4", f"""
SELECT {KEYS}, coalesce((l_returnflag = 'A')::BIGINT, 0) AS "l_returnflag_A", coalesce((l_returnflag = 'N')::BIGINT, 0) AS "l_returnflag_N",
  coalesce((l_returnflag = 'R')::BIGINT, 0) AS "l_returnflag_R" FROM {LINEITEM_N}""")
def _(t):
    return rounded(cleaning.one_hot(t.lineitem_n.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"),
                                    "l_returnflag"))


@query("label_encode", "J5", """
SELECT p_partkey, (SELECT count(DISTINCT q.p_brand) FROM part q WHERE q.p_brand < p.p_brand) AS p_brand FROM part p""")
def _(t):
    return rounded(cleaning.label_encode(t.part.select("p_partkey", "p_brand"), "p_brand"))


@query("label_encode_missing_token", "J6", f"""
WITH s AS (SELECT {KEYS}, coalesce(l_returnflag, '_MISSING_') AS f FROM {LINEITEM_N}),
m AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS code FROM (SELECT DISTINCT f FROM s))
SELECT {KEYS}, code AS l_returnflag FROM s JOIN m USING (f)""")
def _(t):
    df = t.lineitem_n.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    return rounded(cleaning.label_encode(df, "l_returnflag", "_MISSING_"))


@query("label_mapping", "J5", """
SELECT c_name AS label, row_number() OVER (ORDER BY c_name) - 1 AS code FROM (SELECT DISTINCT c_name FROM customer)""")
def _(t):
    return rounded(cleaning.label_mapping(t.customer, "c_name"))


@query("encode_unseen", "J9", """
WITH m AS (SELECT s AS label, row_number() OVER (ORDER BY s) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS s FROM orders
  WHERE o_orderdate < TIMESTAMP '1998-07-01' AND o_orderpriority <> '5-LOW'))
SELECT o_orderkey, coalesce(code, -1) AS minus_one, coalesce(code, 0) AS first_class
FROM orders LEFT JOIN m ON label = o_orderpriority""")
def _(t):
    old = t.orders.where((F.col("o_orderdate") < F.lit("1998-07-01").cast("timestamp_ntz")) & (F.col("o_orderpriority") != "5-LOW"))
    mapping = cleaning.label_mapping(old, "o_orderpriority")
    df = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("minus_one"), F.col("o_orderpriority").alias("first_class"))
    df = cleaning.label_encode(df, "minus_one", mapping=mapping)
    return rounded(cleaning.label_encode(df, "first_class", mapping=mapping, unseen="missing_or_first"))


@query("standard_scale", "J7", f"""
SELECT {KEYS}, round((l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER (), 6) AS l_discount,
  round((l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER (), 6) AS l_tax, 0.0 AS one FROM {LINEITEM_N}""")
def _(t):
    df = t.lineitem_n.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", F.lit(1.0).alias("one"))
    return rounded(cleaning.standard_scale(df, ["l_discount", "l_tax", "one"]))


@query("minmax_scale", "J8", f"""
SELECT {KEYS}, round((l_discount - min(l_discount) OVER ()) / (max(l_discount) OVER () - min(l_discount) OVER ()), 6) AS l_discount,
  0.0 AS one FROM {LINEITEM_N}""")
def _(t):
    df = t.lineitem_n.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", F.lit(1.0).alias("one"))
    return rounded(cleaning.minmax_scale(df, ["l_discount", "one"]))


@query("sanitize", "J10 H10 H11", """
WITH s AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS value, event_type FROM events),
c AS (SELECT event_id, CASE WHEN value IS NULL THEN NULL ELSE greatest(10, least(value, 60)) END AS value,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'click' END AS event_type FROM s)
SELECT event_id::DOUBLE AS event_id, coalesce(value, (SELECT median(value) FROM c)) AS value, event_type FROM c""")
def _(t):
    v = F.when(F.col("event_id") % 97 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    df = t.events.select("event_id", v.alias("value"), "event_type")
    return rounded(cleaning.sanitize(df, {"value": (10, 60)}, {"event_type": ["click", "view", "purchase"]}))


@query("run_steps", "J13 U2 U3 B2 G2", f"""
WITH d AS (SELECT DISTINCT l_discount, l_tax, l_returnflag FROM {LINEITEM_DUP}),
e AS (SELECT l_discount, l_tax, (l_returnflag = 'A')::BIGINT AS "l_returnflag_A", (l_returnflag = 'N')::BIGINT AS "l_returnflag_N",
  (l_returnflag = 'R')::BIGINT AS "l_returnflag_R" FROM d)
SELECT round((l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER (), 6) AS l_discount,
  round((l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER (), 6) AS l_tax, "l_returnflag_A", "l_returnflag_N", "l_returnflag_R" FROM e""")
def _(t):
    steps = [{"type": "drop_column", "target_columns": ["l_quantity", "l_linestatus"]}, {"type": "drop_duplicates"},
             {"type": "encode", "target_columns": ["l_returnflag"], "params": {"method": "onehot"}},
             {"type": "scale", "target_columns": ["l_discount", "l_tax"], "params": {"method": "standard"}}]
    return rounded(cleaning.run_steps(t.lineitem_dup, steps))


@query("preprocess_for_training", "J11 J12", f"""
WITH s AS (SELECT l_tax AS x, coalesce(l_returnflag, 'nan') AS f, l_linestatus AS g, l_extendedprice AS target FROM {LINEITEM_N}),
m AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS code FROM (SELECT DISTINCT f FROM s)),
h AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS gcode FROM (SELECT DISTINCT g FROM s)),
e AS (SELECT x, code::DOUBLE AS f, gcode::DOUBLE AS g, target FROM s JOIN m USING (f) JOIN h USING (g)),
z AS (SELECT (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, (f - avg(f) OVER ()) / stddev_pop(f) OVER () AS f,
  (g - avg(g) OVER ()) / stddev_pop(g) OVER () AS g, target FROM e)
SELECT round(coalesce(x, (SELECT median(x) FROM z)), 6) AS l_tax, round(f, 6) AS l_returnflag, round(g, 6) AS l_linestatus,
  target AS l_extendedprice FROM z""")
def _(t):
    df = t.lineitem_n.select("l_tax", "l_returnflag", "l_linestatus", "l_extendedprice")
    fitted = cleaning.Preprocessor("l_extendedprice").fit(df)
    return rounded(fitted.transform(df))


@query("drop_columns", "B2", "SELECT c_custkey, c_acctbal FROM customer")
def _(t):
    return cleaning.drop_columns(t.customer, ["c_name", "c_nationkey", "c_mktsegment", "not_there"])


@query("align_to_schema", "B8 M8", "SELECT NULL::DOUBLE AS discount, s_acctbal, s_suppkey FROM supplier")
def _(t):
    return cleaning.align_to_schema(t.supplier, ["discount", "s_acctbal", "s_suppkey"])


@query("drop_duplicates", "G2", f"SELECT DISTINCT * FROM {LINEITEM_DUP}")
def _(t):
    return t.lineitem_dup.dropDuplicates()


@query("dropna_column", "B5", f"""
SELECT l_linestatus, count(l_tax) AS n, round(avg(l_tax), 6) AS mean FROM {LINEITEM_N} WHERE l_tax IS NOT NULL GROUP BY l_linestatus""")
def _(t):
    filled = t.lineitem_n.where(F.col("l_tax").isNotNull())
    return rounded(filled.groupBy("l_linestatus").agg(F.count("l_tax").alias("n"), F.avg("l_tax").alias("mean")))


# -- checks -----------------------------------------------------------------------------

RULES = [
    checks.FieldRule("p_partkey", checks.INTEGER, min_value=1),
    checks.FieldRule("p_name", checks.STRING, max_length=12, pattern=r"[a-m]"),
    checks.FieldRule("p_brand", checks.STRING, allowed=[f"Brand#{i}" for i in range(1, 20)]),
    checks.FieldRule("p_size", checks.INTEGER, min_value=5, max_value=40),
    checks.FieldRule("p_container", checks.STRING),
]
VIOLATIONS = """(SELECT p_partkey, unnest(list_filter([
  CASE WHEN p_partkey < 1 THEN 'p_partkey:below_minimum' END, CASE WHEN length(p_name) > 12 THEN 'p_name:too_long' END,
  CASE WHEN NOT regexp_matches(p_name, '^[a-m]') THEN 'p_name:pattern' END,
  CASE WHEN split_part(p_brand, '#', 2)::INT NOT BETWEEN 1 AND 19 THEN 'p_brand:not_allowed' END,
  CASE WHEN p_size < 5 THEN 'p_size:below_minimum' END, CASE WHEN p_size > 40 THEN 'p_size:above_maximum' END,
  'p_container:missing'], lambda x: x IS NOT NULL)) AS v FROM part)"""


@query("validate_records", "I12 H6 H7", f"SELECT p_partkey, v FROM {VIOLATIONS}")
def _(t):
    checked = checks.validate_records(t.part, RULES)
    return checked.select("p_partkey", F.explode("violations").alias("x")).select(
        "p_partkey", F.concat_ws(":", "x.field", "x.code").alias("v"))


@query("violation_counts", "I12 H6", f"""
SELECT split_part(v, ':', 1) AS field, split_part(v, ':', 2) AS code, count(*) AS n FROM {VIOLATIONS} GROUP BY ALL""")
def _(t):
    return checks.violation_counts(checks.validate_records(t.part, RULES))


@query("schema_report", "I11 G3", """
SELECT unnest(['s_suppkey', 's_phone', 's_name', 's_nationkey', 's_acctbal']) AS "column",
  unnest(['present', 'missing', 'extra', 'extra', 'extra']) AS status FROM (SELECT count(*) FROM supplier)""")
def _(t):
    return checks.schema_report(t.supplier, ["s_suppkey", "s_phone"])


@query("zscore_anomalies", "I10", union_all(f"""
SELECT '{c}' AS "column", count(*) AS n, count(*) FILTER (WHERE abs((x - m) / s) > 1.5) AS anomalies, round(max(abs((x - m) / s)), 6) AS max_z
FROM (SELECT {c}::DOUBLE AS x FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-07-01'),
  (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-07-01')"""
                                            for c in ["l_quantity", "l_extendedprice", "l_tax"]))
def _(t):
    cols = ["l_quantity", "l_extendedprice", "l_tax"]
    cut = F.lit("1998-07-01").cast("timestamp_ntz")
    old, new = t.lineitem.where(F.col("l_shipdate") < cut), t.lineitem.where(F.col("l_shipdate") >= cut)
    return rounded(summary.zscore_anomalies(new.select(*cols), summary.moments(old, cols), 1.5))


# -- scalar functions ---------------------------------------------------------------------

@query("lowercase_strings", "H1", "SELECT c_custkey, lower(c_name) AS c_name, lower(c_mktsegment) AS c_mktsegment FROM customer")
def _(t):
    return text.lowercase_strings(t.customer.select("c_custkey", "c_name", "c_mktsegment"))


@query("text_lengths", "H2", """
SELECT 'text' AS "column", max(length(text))::BIGINT AS max_length FROM documents
UNION ALL SELECT 'lang', max(length(lang)) FROM documents""")
def _(t):
    return summary.text_lengths(t.documents, ["text", "lang"])


@query("html_escape", "H3", r"""
SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
  '''', '&#x27;')) AS escaped FROM pages""")
def _(t):
    return t.pages.select("page_id", F.md5(text.html_escape(F.col("html"))).alias("escaped"))


def flag_sql(patterns, col: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, '(?i){p}')" for p in patterns) + ")"


@query("injection_flags", "H4 H5", union_all(
    f"SELECT '{tab}' AS source, {key} AS id, {flag_sql(text.SQL_INJECTION_PATTERNS, col)} AS sql_injection, "
    f"{flag_sql(text.XSS_PATTERNS, col)} AS xss FROM {tab}"
    for tab, key, col in [("documents", "doc_id", "text"), ("pages", "page_id", "html")]))
def _(t):
    def flags(df, source, key, col):
        return df.select(F.lit(source).alias("source"), F.col(key).alias("id"),
                         text.sql_injection_flag(F.col(col)).alias("sql_injection"), text.xss_flag(F.col(col)).alias("xss"))
    return flags(t.documents, "documents", "doc_id", "text").unionByName(flags(t.pages, "pages", "page_id", "html"))


@query("cast_with_rules", "H7 H8", """
WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'false' WHEN 2 THEN '1' WHEN 3 THEN ' 12 ' ELSE value::VARCHAR END AS raw FROM events)
SELECT event_id, CASE WHEN lower(raw) IN ('true', '1', 'yes') THEN true WHEN lower(raw) IN ('false', '0', 'no') THEN false END AS as_bool,
  CASE WHEN regexp_matches(trim(raw), '^[+-]?[0-9]+$') THEN try_cast(trim(raw) AS BIGINT) END AS as_int,
  coalesce(try_cast(trim(raw) AS DOUBLE), -1) AS as_number FROM s""")
def _(t):
    k, raw = F.col("event_id") % 5, F.col("raw")
    df = t.events.select("event_id", F.when(k == 0, "Yes").when(k == 1, "false").when(k == 2, "1").when(k == 3, " 12 ")
                         .otherwise(F.col("value").cast("string")).alias("raw"))
    return df.select("event_id", text.parse_boolean(raw).alias("as_bool"), text.parse_integer(raw).alias("as_int"),
                     text.parse_number(raw, -1).alias("as_number"))


@query("hashes", "H14 H15", """
SELECT user_id, md5('exp:' || user_id) AS m, substr(sha256('exp:' || user_id), 1, 16) AS s,
  list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 8), lambda i: concat('0x', substr(md5('exp:' || user_id), i * 4 + 1, 4))::BIGINT)),
    lambda a, p: (a * 65536 + p) % 1000) AS bucket FROM (SELECT DISTINCT user_id FROM events)""")
def _(t):
    key = F.concat(F.lit("exp:"), F.col("user_id").cast("string"))
    return t.events.select("user_id").distinct().select(
        "user_id", F.md5(key).alias("m"), F.substring(F.sha2(key, 256), 1, 16).alias("s"), text.md5_mod(key).alias("bucket"))


@query("log_line", "H16", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' [' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || '] ' || event_type AS line
FROM events""")
def _(t):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    return t.events.select("event_id", text.log_line(stamp, level, F.col("event_type")).alias("line"))


@query("client_ip", "H17", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || user_id WHEN event_id % 3 = 1 THEN '192.168.1.' || user_id ELSE 'host-' || user_id END AS ip
FROM events""")
def _(t):
    k, u = F.col("event_id") % 3, F.col("user_id").cast("string")
    forwarded = F.when(k == 0, F.concat(F.lit(" 10.0.0."), u, F.lit(" , 172.16.0.1")))
    real = F.when(k == 1, F.concat(F.lit("192.168.1."), u))
    return t.events.select("event_id", text.client_ip(forwarded, real, F.concat(F.lit("host-"), u)).alias("ip"))


@query("json_fields", "H18", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("row_key", "H21", """
SELECT count(*) AS n_rows, count(DISTINCT (l_quantity, l_discount, l_tax)) AS n_keys FROM lineitem""")
def _(t):
    df = t.lineitem.select("l_quantity", "l_discount", "l_tax")
    # the same feature row hashes alike: one key per distinct row is what scoring needs
    keys = df.select(text.row_key(df).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))


@query("flatten_struct", "B9", """
SELECT o_orderkey AS "key", o_totalprice AS "money.total", o_orderstatus AS "state.flag.status" FROM orders""")
def _(t):
    nested = t.orders.select(
        F.col("o_orderkey").alias("key"), F.struct(F.col("o_totalprice").alias("total")).alias("money"),
        F.struct(F.struct(F.col("o_orderstatus").alias("status")).alias("flag")).alias("state"))
    return text.flatten_struct(nested)


@query("display_rounding", "H12", """
SELECT p_partkey, round_even(p_retailprice / 7 * 100, 0) / 100 AS r2, round_even(p_retailprice / 7 * 10000, 0) / 10000 AS r4,
  round_even(p_partkey / 8.0 * 100, 0) / 100 AS ties FROM part""")
def _(t):
    x = F.col("p_retailprice") / 7
    return t.part.select("p_partkey", display_round(x, 2).alias("r2"), display_round(x, 4).alias("r4"),
                         display_round(F.col("p_partkey") / 8, 2).alias("ties"))


@query("date_detection", "H9", """
SELECT 'stamp' AS "column", count(*) AS n, count(ts) AS parsed, max(ts)::DATE::VARCHAR AS last_day FROM events""")
def _(t):
    df = t.events.select(F.col("ts").cast("string").alias("stamp"), "event_type", "props")
    found = text.date_like_columns(df)
    times = df.select(*[F.try_to_timestamp(F.col(c)).alias(c) for c in found])
    return times.agg(F.array(*[F.struct(
        F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), F.count(c).alias("parsed"),
        F.max(c).cast("date").cast("string").alias("last_day")) for c in found]).alias("r")).select(F.inline("r"))
