"""Running a streaming query over what is there now, with durable output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.tables import scratch_dir


def stream_table(spark: SparkSession, folder: str, name: str, schema=None, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over ``folder``/``name``.parquet; zone-less times become timestamps (for watermarks)."""
    schema = schema or spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(folder)
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def marker_stream(spark: SparkSession) -> tuple[DataFrame, Callable[[], None]]:
    """A stream of one column ``at`` without rows, and a function that puts one far-off time into it.

    Such a row moves the watermark past everything that waits: it closes the stream.
    """
    folder = scratch_dir(spark, "stream-markers")
    spark.createDataFrame([], "at timestamp").write.mode("append").parquet(folder)

    def close() -> None:
        spark.sql("SELECT TIMESTAMP '2200-01-01 00:00:00' AS at").write.mode("append").parquet(folder)

    return spark.readStream.schema("at timestamp").parquet(folder), close


def drain(stream: DataFrame, mode: str = "append", timeout: int | None = None, closing: Callable[[], None] | None = None) -> DataFrame:
    """Processes all available input and returns the stored output.

    ``timeout`` ends a run after so many seconds; without it a run lasts as long as its input needs.
    ``closing`` is called when the input is through; the query then goes on from its checkpoint with what that added.

    ``append`` uses the parquet sink; ``update`` and ``complete`` write each micro-batch to
    its own folder, so that a replayed batch replaces itself. For ``complete`` the last
    batch is the result, for ``update`` all versions are returned with their ``batch``.
    """
    spark = stream.sparkSession
    out, checkpoint = scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-checkpoint")
    for step in (None, closing) if closing else (None,):
        if step:
            step()
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        if mode == "append":
            query = writer.format("parquet").option("path", out).start()
        else:
            query = writer.foreachBatch(
                lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
        try:
            # without a timeout the call returns when the query has ended, and raises what failed it
            if timeout is None:
                query.awaitTermination()
            elif not query.awaitTermination(timeout):
                raise TimeoutError("the stream did not finish")
        finally:
            query.stop()
    rows = spark.read.schema(stream.schema).parquet(out) if mode == "append" else spark.read.parquet(out)
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("__last"))
        return rows.join(F.broadcast(last), F.col("batch") == F.col("__last")).drop("batch", "__last")
    return rows
