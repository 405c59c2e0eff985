"""Predictions and the truth that comes later, for every prediction once: a stream-stream outer join that can be closed.

Such a join lets a prediction without truth out only when later rows have moved the watermark past the end of its wait; the
last ones would stay inside. A closing row on both sides (``marker_stream``) moves the watermark past all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import quoted
from tablewright.streaming.detectors import ROCKSDB


def delayed_truth(predictions: DataFrame, actuals: DataFrame, key: str, prediction_time: str, actual_time: str, delay_seconds: int = 86_400,
                  lateness: str = "10 minutes", closing: DataFrame | None = None) -> DataFrame:
    """The predictions' columns and the truth's others: a row for every truth of the key within ``delay_seconds`` after the
    prediction, and one with nulls for a prediction that gets none, when its wait is over or the stream is closed.

    ``closing`` is a marker stream. Rows later than the watermark are dropped, as in any event-time operator. A prediction
    whose key or time is null is given without a truth, at once, as it waits for nothing.
    """
    spark = predictions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rest = [c for c in actuals.columns if c != key and c not in predictions.columns]
    kind = predictions.schema[key].dataType

    def side(df: DataFrame, at: str, time: str, same: str, columns: list[str]) -> DataFrame:
        moment = quoted(time).cast("timestamp")
        # keys are compared as text of the predictions' type, behind a letter
        rows = df.where(moment.isNotNull() & quoted(key).cast(kind).isNotNull()).select(
            F.concat(F.lit("k"), quoted(key).cast(kind).cast("string")).alias(same), moment.alias(at), F.struct(*[quoted(c) for c in columns]).alias(f"{at}_row"))
        if closing is not None:
            # a key of its own, and no row
            rows = rows.unionByName(closing.select(F.lit("").alias(same), F.col("at").alias(at),
                                                   F.lit(None).cast(rows.schema[f"{at}_row"].dataType).alias(f"{at}_row")))
        return rows.withWatermark(at, lateness)

    left = side(predictions, "__p", prediction_time, "__pk", predictions.columns)
    right = side(actuals, "__a", actual_time, "__ak", rest or [key])
    within = ((F.col("__pk") == F.col("__ak")) & (F.col("__a") >= F.col("__p"))
              & (F.col("__a") <= F.col("__p") + F.expr(f"INTERVAL {int(delay_seconds)} SECONDS")))
    # asked of both sides: a filter on one side would move below its watermark and keep the closing row from it
    real = F.col("__p_row").isNotNull() | F.col("__a_row").isNotNull()
    out = left.join(right, within, "left_outer").where(real).select(
        "__p_row.*", *[F.col("__a_row").getField(c).alias(c) for c in rest])
    nothing = [F.lit(None).cast(actuals.schema[c].dataType).alias(c) for c in rest]
    alone = quoted(prediction_time).cast("timestamp").isNull() | quoted(key).isNull()
    return out.unionByName(predictions.where(alone).select(*[quoted(c) for c in predictions.columns], *nothing))
