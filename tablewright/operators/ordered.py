"""Order-dependent work per key that does not put a whole key into one task.

Rows are cut into time buckets, and buckets that hold too many rows into pieces of about
equal depth, at cut points in (time, tie) order. Inside a piece a window does the work; what
crosses a border (the last value, a count) is one row per key and piece, so a key that
holds a third of all rows, or all of them at one time, is spread over as many tasks as its
rows need.

The cut points come from two passes: one counts rows per key and bucket, the other takes a
sample, by hash, of the buckets found too large. The sample affects balance, never the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tablewright.functions.columns import quoted

BUCKET = "__bucket"
DAY = 86_400
#: rows wanted in a piece, sample rows drawn for each piece, and most pieces that hot buckets are cut into
#: (their cut points are broadcast, about a hundred bytes each; beyond that pieces get larger)
TARGET_ROWS, DRAWN, MOST_CUTS = 1_000_000, 64, 50_000


def micros(df: DataFrame, time: str) -> Column:
    """Time as microseconds since 1970; integer columns are taken as they are."""
    c = quoted(time)
    if df.schema[time].dataType.typeName() in ("long", "integer"):
        return c.cast("bigint")
    return F.unix_micros(c.cast("timestamp"))


def bucketed(df: DataFrame, keys: list[str], time: str, tie: list[str], seconds: int = DAY, target: int | None = None) -> DataFrame:
    """Adds ``BUCKET``, a (time bucket, piece) pair that is in the order of (time, tie) within the keys.

    No piece holds many more than ``target`` rows unless more rows agree in keys, time and ties.
    """
    target = target or TARGET_ROWS
    coarse = F.floor(micros(df, time) / (seconds * 1_000_000)).cast("bigint")
    sizes = df.select(*[quoted(k).alias(f"__k{i}") for i, k in enumerate(keys)], coarse.alias("__c")).groupBy(
        *[f"__k{i}" for i in range(len(keys))], "__c").agg(F.count(F.lit(1)).alias("__n"))
    total, most = sizes.agg(F.sum("__n"), F.max("__n")).first()
    if (most or 0) <= 2 * target:
        return df.withColumn(BUCKET, F.struct(coarse.alias("b"), F.lit(0).cast("bigint").alias("p")))
    target = max(target, -(-total // MOST_CUTS))
    names = [f"__k{i}" for i in range(len(keys))] + ["__c"]
    hot = F.broadcast(sizes.where(F.col("__n") > 2 * target))  # at most total / (2 target) rows, so half of MOST_CUTS
    place = F.struct(quoted(time).alias("t"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(tie)])
    there = df.withColumn("__cell", coarse)

    def on(other: DataFrame) -> Column:
        return reduce(lambda x, y: x & y, [there[k].eqNullSafe(other[n]) for k, n in zip([*keys, "__cell"], names)])

    # rows that agree in key, time and ties have one hash; DRAWN sample rows for each piece
    drawn = F.pmod(F.xxhash64(*[there[k] for k in keys], F.to_json(F.struct(place))), F.lit(target)) < DRAWN
    sample = there.where(drawn).join(hot, on(hot)).select(*[F.col(n) for n in names], "__n", place.alias("at")).distinct()
    inside = W.partitionBy(*names).orderBy("at")
    whole = W.partitionBy(*names)
    share = F.floor((F.row_number().over(inside) - 1) * F.ceil(F.col("__n") / target) / F.count(F.lit(1)).over(whole))
    cuts = (sample.withColumn("piece", share).groupBy(*names, "piece").agg(F.min("at").alias("at")).where("piece > 0")
            .groupBy(*names).agg(F.sort_array(F.collect_list("at")).alias("__cuts")))
    # blocks of cut points: a row is held against the first of each block, then against one block
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("__cuts"))).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("__cuts") - 1) / size).cast("int")), lambda i: F.slice("__cuts", i * size + 1, size))
    cuts = F.broadcast(cuts.withColumn("__size", size).withColumn("__blocks", blocks).drop("__cuts"))
    joined = there.join(cuts, on(cuts), "left")
    before = F.size(F.filter("__blocks", lambda b: F.get(b, F.lit(0)) <= place))
    within = F.size(F.filter(F.get("__blocks", before - 1), lambda c: c <= place))
    piece = F.when(F.col("__blocks").isNull() | (before == 0), F.lit(0)).otherwise((before - 1) * F.col("__size") + within)
    return joined.select(*[there[c] for c in df.columns], F.struct(there["__cell"].alias("b"), piece.cast("bigint").alias("p")).alias(BUCKET))


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def carry_in(df: DataFrame, keys: list[str], value: Column, order: Column) -> DataFrame:
    """(keys, bucket, __carry): the last non-null value of all earlier buckets of the key.

    ``df`` is bucketed; the window runs over one row per key and bucket.
    """
    per_bucket = df.groupBy(*keys, BUCKET).agg(
        F.max_by(F.when(value.isNotNull(), F.struct(value.alias("v"))), F.when(value.isNotNull(), order)).alias("__last"))
    earlier = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    return per_bucket.select(*keys, BUCKET, F.last("__last", ignorenulls=True).over(earlier)["v"].alias("__carry"))


def previous_value(df: DataFrame, keys: list[str], time: str, tie: list[str], value: str, name: str,
                   seconds: int = DAY) -> DataFrame:
    """Adds the value of the row before, in (time, tie) order within the keys; null where that row has none."""
    b = bucketed(df, keys, time, tie, seconds)
    order = F.struct(quoted(time), *[quoted(c) for c in tie])
    row = F.struct(quoted(value).alias("v"))  # never null itself, so a null value is carried too
    carry = carry_in(b, keys, row, order)
    inside = W.partitionBy(*keys, BUCKET).orderBy(time, *tie)
    local = b.withColumn("__prev", F.lag(row).over(inside))
    joined = local.join(carry, same(local, carry, [*keys, BUCKET]), "left")
    return joined.select(*[local[c] for c in df.columns], F.coalesce(local["__prev"], carry["__carry"])["v"].alias(name))


def row_numbers(df: DataFrame, keys: list[str], time: str, tie: list[str], name: str = "rn",
                seconds: int = DAY) -> DataFrame:
    """Adds the 1-based position in (time, tie) order within the keys."""
    b = bucketed(df, keys, time, tie, seconds)
    sizes = b.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, BUCKET, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__o"))
    local = b.withColumn("__r", F.row_number().over(W.partitionBy(*keys, BUCKET).orderBy(time, *tie)))
    joined = local.join(offsets, same(local, offsets, [*keys, BUCKET]))
    return joined.select(*[local[c] for c in df.columns], (offsets["__o"] + local["__r"]).alias(name))


def rolling(df: DataFrame, keys: list[str], time: str, tie: list[str], window: int, stats: dict[str, Column],
            seconds: int = DAY, chunk: int | None = None) -> DataFrame:
    """Adds ``stats`` (aggregate Columns) over the last ``window`` rows up to each row.

    Rows are numbered per key and cut into chunks; the last window − 1 rows of a chunk are
    repeated in the next one, so every frame lies inside one chunk.
    """
    chunk = chunk or max(window * 10, 10_000)
    if chunk < window:
        raise ValueError("a chunk must hold a whole window")
    numbered = row_numbers(df, keys, time, tie, "__rn", seconds).withColumn("__own", F.floor((F.col("__rn") - 1) / chunk))
    spill = (F.col("__rn") - 1) % chunk >= chunk - (window - 1)
    copies = numbered.withColumn("__chunk", F.explode(
        F.when(spill, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))))
    frame = W.partitionBy(*keys, "__chunk").orderBy("__rn").rowsBetween(-(window - 1), 0)
    out = copies.select("*", *[c.over(frame).alias(n) for n, c in stats.items()]).where(F.col("__chunk") == F.col("__own"))
    return out.select(*df.columns, *stats)


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The n newest rows per key; row_number ≤ n is pushed below the shuffle (WindowGroupLimit)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def latest(df: DataFrame, keys: list[str], time: str, tie: list[str] | None = None) -> DataFrame:
    """The newest row per key, as a combining aggregate instead of a window."""
    order = F.struct(quoted(time), *[quoted(c) for c in tie or []])
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*[quoted(c) for c in rest]), order).alias("__row"))
    return picked.select(*keys, *[F.col("__row").getField(c).alias(c) for c in rest])


def next_value(df: DataFrame, keys: list[str], time: str, tie: list[str], value: str, name: str,
               seconds: int = DAY) -> DataFrame:
    """Adds the value of the row after, in (time, tie) order; ties must be numeric."""
    back = df.withColumn("__t", -micros(df, time)).select(
        "*", *[(-quoted(c)).alias(f"__tie_{c}") for c in tie])
    out = previous_value(back, keys, "__t", [f"__tie_{c}" for c in tie], value, name, seconds)
    return out.select(*df.columns, name)
