"""Row-level contracts and schema comparison."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import quoted
from tablewright.functions.text import parse_boolean, parse_integer, parse_number, sql_injection_flag, xss_flag

STRING, INTEGER, FLOAT, BOOLEAN, ARRAY, OBJECT = "string", "integer", "float", "boolean", "array", "object"


@dataclass(frozen=True)
class FieldRule:
    """What one field of a record must satisfy. Values are strings unless typed already."""

    name: str
    dtype: str = STRING
    required: bool = True
    nullable: bool = False
    min_value: float | None = None
    max_value: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    allowed: list = field(default_factory=list)


def parsed(df: DataFrame, rule: FieldRule) -> Column:
    """The value in the rule's type, null where it is not of that type."""
    c, actual = quoted(rule.name), df.schema[rule.name].dataType.simpleString()
    if rule.dtype == STRING:
        return c.cast("string")
    if rule.dtype == INTEGER:
        if actual == "boolean":  # a truth value is not a number
            return F.lit(None).cast("bigint")
        return parse_integer(c) if actual == "string" else c.cast("bigint")
    if rule.dtype == FLOAT:
        if actual == "boolean":
            return F.lit(None).cast("double")
        return parse_number(c) if actual == "string" else c.cast("double")
    if rule.dtype == BOOLEAN:
        return c if actual == "boolean" else parse_boolean(c.cast("string"))
    if rule.dtype == ARRAY:
        return c if actual.startswith("array") else F.lit(None)
    if rule.dtype == OBJECT:
        return c if actual.startswith(("map", "struct")) else F.lit(None)
    raise ValueError(f"unknown type {rule.dtype}")


def field_violations(df: DataFrame, rule: FieldRule) -> list[Column]:
    """struct(field, code) or null, one per check of the field."""
    def found(test: Column, code: str) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(rule.name).alias("field"), F.lit(code).alias("code")))

    if rule.name not in df.columns:
        return [found(F.lit(True), "missing")] if rule.required else []
    raw, value = quoted(rule.name), parsed(df, rule)
    out = []
    if not rule.nullable:
        out.append(found(raw.isNull(), "null"))
    if rule.dtype != STRING:
        out.append(found(raw.isNotNull() & value.isNull(), "type"))
    else:
        out += [found(sql_injection_flag(value), "sql_injection"), found(xss_flag(value), "xss")]
        if rule.min_length:
            out.append(found(F.length(value) < rule.min_length, "too_short"))
        if rule.max_length:
            out.append(found(F.length(value) > rule.max_length, "too_long"))
        if rule.pattern:
            out.append(found(~value.rlike("^(?:" + rule.pattern + ")"), "pattern"))
    if rule.min_value is not None:
        out.append(found(value < rule.min_value, "below_minimum"))
    if rule.max_value is not None:
        out.append(found(value > rule.max_value, "above_maximum"))
    if rule.allowed:
        out.append(found(~value.isin(rule.allowed), "not_allowed"))
    return out


def validate_records(df: DataFrame, rules: list[FieldRule], strict: bool = False) -> DataFrame:
    """The rows with a ``violations`` array of (field, code): all of them, not only the first.

    With ``strict`` a column without a rule is a violation of every row.
    """
    checks = [c for r in rules for c in field_violations(df, r)]
    if strict:
        known = {r.name for r in rules}
        checks += [F.struct(F.lit(c).alias("field"), F.lit("unknown").alias("code")) for c in df.columns if c not in known]
    return df.withColumn("violations", F.filter(F.array(*checks), lambda v: v.isNotNull()))


def accepted(validated: DataFrame, rules: list[FieldRule]) -> DataFrame:
    """Rows without a violation, fields in the types of their rules."""
    good = validated.where(F.size("violations") == 0)
    typed = {r.name: parsed(good, r).alias(r.name) for r in rules if r.name in good.columns}
    return good.select(*[typed[c] for c in good.columns if c in typed])


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("violations") > 0)


def violation_counts(validated: DataFrame) -> DataFrame:
    """(field, code, n)."""
    return (validated.select(F.explode("violations").alias("v"))
            .groupBy(F.col("v.field").alias("field"), F.col("v.code").alias("code")).agg(F.count(F.lit(1)).alias("n")))


def schema_report(df: DataFrame, expected: list[str]) -> DataFrame:
    """(column, status): missing / extra / present; reads no data."""
    rows = [(c, "present" if c in df.columns else "missing") for c in expected]
    rows += [(c, "extra") for c in df.columns if c not in expected]
    return df.sparkSession.createDataFrame(rows, "column string, status string")
