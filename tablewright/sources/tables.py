"""Reading and writing tables by extension."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.lineage import local_folder

FORMATS = {"csv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "parquet": "parquet"}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder; a temporary one only where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/tablewright-{uuid.uuid4().hex}/{name}"
    return os.path.join(local_folder(spark.sparkContext.master, "tablewright-"), name)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Header CSV. Give a schema for large inputs: inference reads the files a second time."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def scan_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """JSON records, one per line; ``multi_line`` for files that hold an array."""
    reader = spark.read.option("multiLine", multi_line)
    return reader.schema(schema).json(path) if schema else reader.json(path)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def extension(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""


def load(spark: SparkSession, path: str, file_type: str | None = None) -> DataFrame:
    """Any supported file by its extension, or by ``file_type``."""
    kind = FORMATS.get((file_type or extension(path)).lower())
    if kind is None:
        raise ValueError(f"unsupported file type: {file_type or path}")
    try:
        return {"csv": scan_csv, "json": scan_json, "parquet": scan_parquet}[kind](spark, path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from e
        raise


def write(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    """Parquet where the path ends in .parquet, else CSV with a header."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if extension(path) == "parquet":
        writer.parquet(path)
    else:
        writer.option("header", True).csv(path)
    return path


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; columns are the union, null where a source lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def load_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    return union_sources([load(spark, p) for p in paths])


def source_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(source, n_rows) in one job."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("source"), "n_rows") for name, df in frames.items()])


def dataset_columns(spark: SparkSession, path: str) -> DataFrame:
    """(position, column, dtype) of a stored table; no row is read (CSV reads one header line)."""
    schema = (spark.read.option("header", True).csv(path).schema if extension(path) == "csv"
              else load(spark, path).schema)
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(rows, "position int, column string, dtype string")
