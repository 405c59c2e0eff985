"""Alert rules as SQL predicates, with cooldown, over batches and streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import quoted
from tablewright.operators.admission import fire_with_cooldown


@dataclass(frozen=True)
class AlertRule:
    """A rule fires where ``condition`` (SQL text or a Column over the metrics row) holds."""

    rule: str
    condition: str | Column
    severity: str = "warning"
    cooldown_seconds: int = 1800
    enabled: bool = True
    description: str = ""


# fixed values: the rules every monitor starts with
DEFAULT_RULES = [
    AlertRule("drift_detected", "drift_detected", "warning", 3600, description="the data has drifted"),
    AlertRule("performance_degradation", "degradation_detected", "critical", 1800, description="metrics fell below the baseline"),
    AlertRule("high_error_rate", "error_rate > 0.1", "critical", 900, description="more than one request in ten fails"),
    AlertRule("low_accuracy", "accuracy < 0.8", "warning", 3600, description="fewer than four predictions in five are right"),
]


def candidates(metrics: DataFrame, rules: list[AlertRule]) -> DataFrame:
    """The metric rows once per rule whose condition holds; a null condition does not fire.

    A rule whose columns the row lacks never fires; any other error in a condition is raised.
    """
    hits = []
    for r in rules:
        if not r.enabled:
            continue
        test = F.expr(r.condition) if isinstance(r.condition, str) else r.condition
        try:
            metrics.select(test)
        except AnalysisException as e:
            if not (e.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
                raise
            continue
        hits.append(F.when(F.coalesce(test, F.lit(False)), F.struct(
            F.lit(r.rule).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.cooldown_seconds).alias("cooldown"))))
    if not hits:
        hits = [F.lit(None).cast("struct<rule:string,severity:string,cooldown:int>")]
    return metrics.select("*", F.explode(F.array_compact(F.array(*hits))).alias("__hit")).select("*", "__hit.*").drop("__hit")


def evaluate_rules(metrics: DataFrame, rules: list[AlertRule], time: str) -> DataFrame:
    """(rule, t, severity, message) of the alerts that fire, t in microseconds."""
    found = candidates(metrics, rules)
    fired = fire_with_cooldown(found.select("rule", quoted(time), "cooldown"), "rule", time, F.col("cooldown"))
    severity = F.element_at(F.create_map(*[x for r in rules for x in (F.lit(r.rule), F.lit(r.severity))]), F.col("rule"))
    about = F.element_at(F.create_map(*[x for r in rules for x in (F.lit(r.rule), F.lit(r.description))]), F.col("rule"))
    return fired.select("rule", "t", severity.alias("severity"),
                        F.concat(F.lit("["), F.upper(severity), F.lit("] "), F.col("rule"),
                                 F.when(about != "", F.concat(F.lit(": "), about)).otherwise("")).alias("message"))
