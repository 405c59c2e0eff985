"""String, hashing and casting expressions used by checks, logs and A/B analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import categorical_columns, quoted

# fixed values: patterns that mark a string as a possible SQL injection, case ignored
SQL_INJECTION_PATTERNS = [
    r"(\b(SELECT|INSERT|UPDATE|DELETE|DROP|UNION|ALTER)\b)",
    r"(--|;|\/\*|\*\/)",
    r"(\bOR\b\s+\d+\s*=\s*\d+)",
    r"(\bAND\b\s+\d+\s*=\s*\d+)",
]
# fixed values: patterns that mark a string as possible cross-site scripting, case ignored
XSS_PATTERNS = [
    r"<script\b[^>]*>.*?</script>",
    r"javascript:",
    r"on\w+\s*=",
    r"<\s*iframe",
    r"<\s*object",
]
# fixed values: spellings of booleans
TRUE_WORDS = ["true", "1", "yes"]
FALSE_WORDS = ["false", "0", "no"]


def matches_any(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(f"(?i){p}")
    return out


def sql_injection_flag(c: Column) -> Column:
    return matches_any(c, SQL_INJECTION_PATTERNS)


def xss_flag(c: Column) -> Column:
    return matches_any(c, XSS_PATTERNS)


def html_escape(c: Column) -> Column:
    """The ampersand first, so that the entities it adds stay whole."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def lowercase_strings(df: DataFrame) -> DataFrame:
    texts = set(categorical_columns(df))
    return df.select(*[F.lower(quoted(c)).alias(c) if c in texts else quoted(c) for c in df.columns])


def parse_boolean(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin(TRUE_WORDS), True).when(low.isin(FALSE_WORDS), False)


def parse_integer(c: Column) -> Column:
    """Whole-number strings only; null where it does not parse."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))


def parse_number(c: Column, fill: float | None = None) -> Column:
    """Number or null; with ``fill`` the fallback for text that is none."""
    v = F.trim(c).try_cast("double")
    return v if fill is None else F.coalesce(v, F.lit(float(fill)))


def finite(c: Column) -> Column:
    """Infinities and NaN as null."""
    return F.when((F.abs(c) == float("inf")) | F.isnan(c), None).otherwise(c)


def clip(c: Column, low: float, high: float) -> Column:
    """Clamped value; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(c, F.lit(high))))


def md5_mod(c: Column, modulus: int = 1000) -> Column:
    """md5(c) as a 128-bit number modulo ``modulus``, folded over 16-bit pieces."""
    digest = F.md5(c)
    pieces = F.transform(F.sequence(F.lit(1), F.lit(29), F.lit(4)),
                         lambda i: F.conv(F.substring(digest, i, F.lit(4)), 16, 10).cast("bigint"))
    return F.aggregate(pieces, F.lit(0).cast("bigint"), lambda acc, p: F.pmod(acc * 65536 + p, F.lit(modulus)))


def chain_hash(previous: Column, event_id: Column, timestamp: Column) -> Column:
    """32 hex digits that tie an event to the stored hash before it."""
    return F.substring(F.sha2(F.concat_ws(":", previous, event_id, timestamp), 256), 1, 32)


def log_line(timestamp: Column, level: Column, message: Column) -> Column:
    """``timestamp [LEVEL] message`` with the fraction of the second cut off."""
    return F.concat(F.split_part(timestamp, F.lit("."), F.lit(1)), F.lit(" ["), level, F.lit("] "), message)


def client_ip(forwarded_for: Column, real_ip: Column, host: Column) -> Column:
    first = F.trim(F.split_part(forwarded_for, F.lit(","), F.lit(1)))
    return F.coalesce(F.when(F.length(first) > 0, first), F.when(F.length(real_ip) > 0, real_ip), host)


def row_key(df: DataFrame, cols: list[str] | None = None) -> Column:
    """Hash of a feature row that does not depend on column order."""
    return F.md5(F.to_json(F.struct(*[quoted(c).alias(c) for c in sorted(cols or df.columns)])))


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as columns named by their path; schema walk only."""
    out = []

    def walk(c: Column, dtype: T.DataType, name: str) -> None:
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(c.getField(f.name), f.dataType, f"{name}{sep}{f.name}")
        else:
            out.append(c.alias(name))

    for field in df.schema.fields:
        walk(quoted(field.name), field.dataType, field.name)
    return df.select(*out)


def date_like_columns(df: DataFrame) -> list[str]:
    """Text columns of which every non-null value parses as a time; one aggregate over all rows."""
    texts = categorical_columns(df)
    if not texts:
        return []
    row = df.agg(*[
        F.struct(F.count(quoted(c)).alias("n"), F.count(F.try_to_timestamp(quoted(c))).alias("ok")).alias(c)
        for c in texts]).first()
    return [c for c in texts if row[c]["n"] > 0 and row[c]["n"] == row[c]["ok"]]
