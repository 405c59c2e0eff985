"""JSON-lines logs and audit files, as a batch or as a stream; malformed lines are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOG_SCHEMA = "timestamp string, level string, message string, task_id string, source string, meta map<string,string>"
AUDIT_SCHEMA = ("event_id string, timestamp string, action string, severity string, user_id string, ip_address string, "
                "resource string, details map<string,string>, success boolean")


def read_jsonl(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def stream_jsonl(spark: SparkSession, path: str, schema: str = LOG_SCHEMA, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("mode", "DROPMALFORMED")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def append_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)
