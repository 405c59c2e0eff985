"""The input tables and the derived frames that several queries share, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
         "benchmark labels conversations").split()


class Tables:
    """``tables.lineitem`` reads that parquet file lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    # -- lineitem with nulls put in by rule, because the tables hold none
    @property
    def lineitem_n(self) -> DataFrame:
        return self.lineitem.select(
            "l_orderkey", "l_linenumber",
            F.when(F.col("l_orderkey") % 5 < 3, None).otherwise(F.col("l_quantity")).alias("l_quantity"),
            "l_extendedprice",
            F.when(F.col("l_partkey") % 100 == 0, None).otherwise(F.col("l_discount")).alias("l_discount"),
            F.when(F.col("l_orderkey") % 7 == 0, None).otherwise(F.col("l_tax")).alias("l_tax"),
            F.when(F.col("l_orderkey") % 11 == 0, None).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
            "l_linestatus", "l_shipdate")

    @property
    def lineitem_dup(self) -> DataFrame:
        return self.lineitem.select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")

    @property
    def drift_ref(self) -> DataFrame:
        return self.lineitem.where(F.col("l_shipdate") < F.lit("1998-07-01").cast("timestamp_ntz"))

    @property
    def drift_cur(self) -> DataFrame:
        later = self.lineitem.where(F.col("l_shipdate") >= F.lit("1998-07-01").cast("timestamp_ntz"))
        return later.withColumn("l_quantity", F.col("l_quantity") + 10)

    @property
    def scored_binary(self) -> DataFrame:
        d = self.documents.select("doc_id", "n_chars")
        return self.labels.join(d, "doc_id").select(
            "doc_id", F.col("quality").alias("actual"), (F.col("n_chars") >= 500).cast("int").alias("pred"),
            (F.col("n_chars") / (F.col("n_chars") + 1000)).alias("prob"))

    @property
    def scored_multi(self) -> DataFrame:
        classes = F.array(F.lit("F"), F.lit("O"), F.lit("P"))
        return self.orders.select(
            "o_orderkey", F.col("o_orderstatus").alias("actual"),
            F.element_at(classes, (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int")).alias("pred"))

    @property
    def scored_reg(self) -> DataFrame:
        return self.lineitem.select(F.col("l_extendedprice").alias("actual"),
                                    (F.col("l_quantity") * 2000).alias("pred"))


LINEITEM_N = """(SELECT l_orderkey, l_linenumber,
  CASE WHEN l_orderkey % 5 < 3 THEN NULL ELSE l_quantity END AS l_quantity, l_extendedprice,
  CASE WHEN l_partkey % 100 = 0 THEN NULL ELSE l_discount END AS l_discount,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS l_tax,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
  l_linestatus, l_shipdate FROM lineitem)"""
LINEITEM_N_COLUMNS = {
    "l_orderkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
    "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz"}
LINEITEM_N_NUMERIC = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax"]
LINEITEM_DUP = "(SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem)"
DRIFT_REF = "(SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-07-01')"
DRIFT_CUR = ("(SELECT * REPLACE (l_quantity + 10 AS l_quantity) FROM lineitem "
             "WHERE l_shipdate >= TIMESTAMP '1998-07-01')")
SCORED_BINARY = """(SELECT doc_id, quality AS actual, CAST(n_chars >= 500 AS INT) AS pred,
  n_chars / (n_chars + 1000) AS prob FROM labels JOIN documents USING (doc_id))"""
SCORED_MULTI = """(SELECT o_orderkey, o_orderstatus AS actual,
  ['F','O','P'][(o_orderkey % 3 + 1)::INT] AS pred FROM orders)"""
SCORED_REG = "(SELECT l_extendedprice AS actual, l_quantity * 2000 AS pred FROM lineitem)"


def union_all(parts) -> str:
    return "\nUNION ALL\n".join(parts)
