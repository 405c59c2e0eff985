"""Verdict labels derived from numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_round(c: Column, digits: int) -> Column:
    """Rounding as NumPy displays it: scale, to the nearest integer with ties to even, scale back."""
    return F.rint(c * 10.0 ** digits) / 10.0 ** digits


def ladder(c: Column, steps: list[tuple[float, str]], default: str, strict: bool = False) -> Column:
    """First label whose lower bound the value reaches (or exceeds, when strict)."""
    out = None
    for bound, label in steps:
        test = c > bound if strict else c >= bound
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(default)


def quality_rating(score: Column) -> Column:
    return ladder(score, [(95, "Excellent"), (80, "Good"), (60, "Fair")], "Needs Improvement")


def correlation_strength(r: Column) -> Column:
    return ladder(F.abs(r), [(0.7, "Strong"), (0.4, "Moderate")], "Weak")


def correlation_direction(r: Column) -> Column:
    return F.when(r > 0, "Positive").otherwise("Negative")


def distribution_label(skew: Column) -> Column:
    return (F.when(F.abs(skew) < 0.5, "Normal (Symmetric)")
            .when(skew > 0.5, "Right-skewed (Positive)")
            .otherwise("Left-skewed (Negative)"))


def completeness_colour(pct: Column) -> Column:
    return ladder(pct, [(95, "green"), (80, "yellow")], "red")


def audit_severity(action: Column, success: Column) -> Column:
    """Severity an audit event gets when none is given."""
    watched = ["security.permission_denied", "security.suspicious", "auth.login_failed", "security.rate_limit"]
    return (F.when(action.isin(watched), "warning").when(~success, "error").otherwise("info"))


def health_status(score: Column, otherwise: Column) -> Column:
    return F.when(score < 50, "critical").when(score < 80, "warning").otherwise(otherwise)
