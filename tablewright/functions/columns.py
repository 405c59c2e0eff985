"""Schema questions and the one definition of "missing" used everywhere."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, CATEGORICAL, DATETIME, OTHER = "numeric", "categorical", "datetime", "other"


def kind_of(dtype: T.DataType) -> str:
    """numeric / categorical / datetime / other, decided from the schema alone."""
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return CATEGORICAL
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    return OTHER


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == kind]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of_kind(df, NUMERIC)


def categorical_columns(df: DataFrame) -> list[str]:
    return columns_of_kind(df, CATEGORICAL)


def datetime_columns(df: DataFrame) -> list[str]:
    return columns_of_kind(df, DATETIME)


def select_kind(df: DataFrame, kind: str) -> DataFrame:
    """Only the columns of one kind."""
    return df.select(*[quoted(c) for c in columns_of_kind(df, kind)])


def quoted(name: str) -> Column:
    """Column by literal name (dots in names are not paths)."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN for floating columns."""
    c = quoted(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null, so that built-in aggregates skip it."""
    c = quoted(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c), None).otherwise(c)
    return c


def as_double(df: DataFrame, name: str) -> Column:
    return present(df, name).cast("double")


def chunks(items: Iterable, size: int) -> list[list]:
    items = list(items)
    return [items[i:i + size] for i in range(0, len(items), size)]


def schema_frame(df: DataFrame) -> DataFrame:
    """(position, column, dtype, kind): the schema as rows; no data is scanned."""
    rows = [(i, f.name, f.dataType.simpleString(), kind_of(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string, kind string")


def melt(df: DataFrame, cols: list[str], keep: list[str] | None = None, to: str = "double",
         drop_missing: bool = True) -> DataFrame:
    """(keep…, column, value) rows; Catalyst turns this into one Expand without a shuffle."""
    keep = keep or []
    wide = df.select(*[quoted(k) for k in keep], *[present(df, c).cast(to).alias(c) for c in cols])
    long = wide.unpivot([quoted(k) for k in keep], [quoted(c) for c in cols], "column", "value")
    return long.where(F.col("value").isNotNull()) if drop_missing else long


def stats_rows(df: DataFrame, cols: list[str], stats, by: list[str] | None = None, chunk: int = 16) -> DataFrame:
    """One row per column from wide aggregates.

    ``stats(df, name)`` gives the aggregate Columns of one column. All columns of a
    chunk share one aggregate and one scan; a chunk keeps the generated code below
    the code-size limits, and with a columnar source each chunk reads only its own
    columns, so several chunks do not read more bytes than one.
    """
    parts = []
    for part in chunks(cols, chunk):
        rows = F.array(*[F.struct(F.lit(c).alias("column"), *stats(df, c)) for c in part])
        grouped = df.groupBy(*[quoted(b) for b in by]) if by else df.groupBy()
        parts.append(grouped.agg(rows.alias("__rows")).select(*(by or []), F.inline("__rows")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
