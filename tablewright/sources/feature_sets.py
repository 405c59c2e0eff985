"""Versioned feature sets in parquet: ``root/name=…/version=…``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.joins import entity_filter, select_features
from tablewright.operators.summary import content_hash, entity_count
from tablewright.plans.profile import feature_metadata


class FeatureStore:
    """Feature sets below one root folder; a version is written once and read by number or as the latest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str, version: int) -> str:
        return f"{self.root}/name={name}/version={version}"

    def versions(self, name: str) -> list[int]:
        """Numbers of the stored versions; none for an unknown set."""
        try:
            files = self.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option(
                "recursiveFileLookup", "true").load(f"{self.root}/name={name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        number = F.regexp_extract("path", r"/version=(\d+)/", 1).cast("int")
        return sorted(r[0] for r in files.select(number.alias("v")).distinct().collect())

    def write(self, name: str, df: DataFrame, entities: list[str], time: str | None = None) -> int:
        """Stores the next version and its metadata row; returns the number."""
        version = (self.versions(name) or [0])[-1] + 1
        df.write.mode("errorifexists").parquet(self._path(name, version))
        stored = self.spark.read.parquet(self._path(name, version))
        info = (content_hash(stored).crossJoin(entity_count(stored, entities))
                .select(F.lit(name).alias("name"), F.lit(version).alias("version"), "n_rows", "entity_count",
                        F.concat_ws("-", "n_rows", "xor_hash", "sum_hash").alias("data_hash"),
                        F.array(*[F.lit(e) for e in entities]).alias("entities"), F.lit(time).cast("string").alias("time_column"),
                        F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"))
                                  for f in stored.schema.fields]).alias("columns")))
        info.coalesce(1).write.mode("append").parquet(f"{self.root}/_sets")
        return version

    def info(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/_sets").where(F.col("name") == name)

    def sets(self) -> DataFrame:
        """(name, versions, version, n_rows, entity_count, entities, time_column, columns): the newest version of every set."""
        rest = ["n_rows", "entity_count", "entities", "time_column", "columns"]
        every = self.spark.read.parquet(f"{self.root}/_sets")
        newest = F.max_by(F.struct("version", *rest), "version").alias("newest")
        return every.groupBy("name").agg(F.count_distinct("version").alias("versions"), newest).select("name", "versions", "newest.*")

    def features(self) -> DataFrame:
        """(name, version, column, dtype, is_entity): the features of all sets, by their newest versions."""
        return self.sets().select("name", "version", "entities", F.inline("columns")).withColumn(
            "is_entity", F.array_contains("entities", F.col("column"))).drop("entities")

    def read(self, name: str, version: int | None = None, columns: list[str] | None = None,
             where: dict[str, object] | None = None, entities: list[str] | None = None) -> DataFrame:
        """Columns and entity filter reach the parquet scan."""
        version = version or self.versions(name)[-1]
        df = self.spark.read.parquet(self._path(name, version))
        if where:
            df = entity_filter(df, where)
        return select_features(df, entities or [], columns) if columns is not None else df

    def metadata(self, name: str, version: int | None = None) -> DataFrame:
        return feature_metadata(self.read(name, version))
