"""Feature joins: equi and point-in-time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tablewright.functions.columns import quoted
from tablewright.operators.ordered import BUCKET, DAY, bucketed, carry_in, latest, same


def entity_filter(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows whose columns equal the value, or one of the values; unknown columns are ignored."""
    for name, value in wanted.items():
        if name in df.columns:
            df = df.where(quoted(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else quoted(name) == value)
    return df


def select_features(df: DataFrame, entities: list[str], features: list[str] | None = None) -> DataFrame:
    """Entity columns and those requested features that exist."""
    if features is None:
        return df
    return df.select(*[quoted(c) for c in entities], *[quoted(c) for c in features if c in df.columns and c not in entities])


def feature_join(entity_df: DataFrame, features: DataFrame, entities: list[str],
                 columns: list[str] | None = None) -> DataFrame:
    """Left equi-join; AQE picks broadcast or splits skewed keys at run time."""
    return entity_df.join(select_features(features, entities, columns), entities, "left")


def point_in_time_join(entity_df: DataFrame, features: DataFrame, entities: list[str], time: str,
                       columns: list[str] | None = None, feature_time: str | None = None,
                       bucket_seconds: int = DAY) -> DataFrame:
    """Every left row with the newest feature row of its entity at or before its time.

    Equal times match; of several feature rows at one time the largest by value wins, so the
    result does not depend on row order; left rows without a match keep nulls. Both sides are
    unioned and walked by a window per entity and piece of time; the last feature of the
    earlier pieces is carried in, so a hot entity is split however many of its rows share a time.
    """
    feature_time = feature_time or time
    columns = columns or [c for c in features.columns if c not in entities and c != feature_time]
    left_cols = entity_df.columns
    left_type = entity_df.select(F.struct(*[quoted(c) for c in left_cols]).alias("l")).schema["l"].dataType
    right = features.where(quoted(feature_time).isNotNull())
    for e in entities:
        right = right.where(quoted(e).isNotNull())
    right_type = right.select(F.struct(*[quoted(c) for c in columns]).alias("f")).schema["f"].dataType
    hashed = [quoted(f.name) for f in entity_df.schema.fields if "map<" not in f.dataType.simpleString()]
    both = entity_df.select(
        *[quoted(e) for e in entities], quoted(time).alias("__t"), F.lit(1).alias("__side"), F.xxhash64(*hashed).alias("__h"),
        F.struct(*[quoted(c) for c in left_cols]).alias("__l"), F.lit(None).cast(right_type).alias("__f"),
    ).unionByName(right.select(
        *[quoted(e) for e in entities], quoted(feature_time).alias("__t"), F.lit(0).alias("__side"), F.lit(0).cast("bigint").alias("__h"),
        F.lit(None).cast(left_type).alias("__l"), F.struct(*[quoted(c) for c in columns]).alias("__f")))
    # left rows of one time may stand in any order, so a hash of the row parts them
    b = bucketed(both, entities, "__t", ["__side", "__f", "__h"], bucket_seconds)
    carry = carry_in(b, entities, F.col("__f"), F.struct("__t", "__f"))
    inside = W.partitionBy(*entities, BUCKET).orderBy("__t", "__side", "__f").rowsBetween(W.unboundedPreceding, 0)
    local = b.withColumn("__m", F.last("__f", ignorenulls=True).over(inside)).where("__side = 1")
    joined = local.join(carry, same(local, carry, [*entities, BUCKET]), "left").select(
        local["__l"], F.coalesce(local["__m"], carry["__carry"]).alias("__m"))
    taken = set(left_cols)
    return joined.select(*[F.col("__l").getField(c).alias(c) for c in left_cols],
                         *[F.col("__m").getField(c).alias(c if c not in taken else f"{c}_feature") for c in columns])


def online_features(features: DataFrame, entities: list[str], time: str | None,
                    tie: list[str] | None = None) -> DataFrame:
    """The row an online lookup returns, for all entities at once: the newest one.

    Without a time it is the first one by ``tie``, else by all other columns in their order (maps as JSON).
    """
    if time is None:
        rest = [c for c in features.columns if c not in entities]
        kinds = {f.name: f.dataType.typeName() for f in features.schema.fields}
        order = [F.to_json(quoted(c)) if kinds[c] == "map" else quoted(c) for c in [*(tie or []), *rest]]
        if not rest:
            return features.distinct()
        first = features.groupBy(*[quoted(c) for c in entities]).agg(
            F.min_by(F.struct(*[quoted(c) for c in rest]), F.struct(*order)).alias("__first"))
        return first.select(*[F.col("__first").getField(c).alias(c) if c in rest else quoted(c) for c in features.columns])
    return latest(features, entities, time, tie)


def common_columns(reference: DataFrame, current: DataFrame) -> list[str]:
    return [c for c in reference.columns if c in current.columns]


def align_maps(a: DataFrame, b: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, a, b, changed): full outer alignment of two (key, value) tables, null where absent."""
    left = a.select(quoted(key).alias("key"), quoted(value).alias("a"))
    right = b.select(quoted(key).alias("key"), quoted(value).alias("b"))
    return left.join(right, "key", "full_outer").withColumn("changed", ~F.col("a").eqNullSafe(F.col("b")))
