"""A/B assignment and results, experiment runs, model versions and deployments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tablewright.functions.columns import quoted
from tablewright.functions.text import md5_mod
from tablewright.operators.joins import align_maps, entity_filter
from tablewright.operators.ordered import last_n, next_value

# -- A/B tests ------------------------------------------------------------------------


def ab_assign(experiment: str, user: Column, weights: dict[str, float]) -> Column:
    """Variant of a user: md5 bucket in thousandths of the total weight, first variant whose
    cumulative weight reaches it, in the given order."""
    total = sum(weights.values())
    point = md5_mod(F.concat(F.lit(f"{experiment}:"), user.cast("string"))) / 1000.0 * total
    out, running = None, 0.0
    for name, weight in weights.items():
        running += weight
        out = F.when(point <= running, name) if out is None else out.when(point <= running, name)
    return out.otherwise(list(weights)[-1])


def ab_results(log: DataFrame, experiment: str, weights: dict[str, float], user: str, success: Column, conversion: Column,
               latency: Column, variant: Column | None = None) -> DataFrame:
    """One row per variant: requests, successes, errors, rates and mean latency of successes.

    ``variant`` holds a known variant; where null the user's assignment is used.
    """
    assigned = ab_assign(experiment, quoted(user), weights)
    chosen = assigned if variant is None else F.coalesce(variant, assigned)
    ok = F.count_if(success)
    order = F.element_at(F.create_map(*[x for i, n in enumerate(weights) for x in (F.lit(n), F.lit(i))]), F.col("variant"))
    weight = F.element_at(F.create_map(*[x for n, w in weights.items() for x in (F.lit(n), F.lit(float(w)))]), F.col("variant"))
    grouped = log.select(chosen.alias("variant"), success.alias("s"), conversion.alias("c"), latency.alias("l"))
    n, ok, conv = F.count(F.lit(1)), F.count_if("s"), F.count_if("c")
    return (grouped.groupBy("variant").agg(
        n.alias("request_count"), ok.alias("success_count"), (n - ok).alias("error_count"),
        ((n - ok) / F.greatest(n, F.lit(1))).alias("error_rate"),
        (F.coalesce(F.sum(F.when(F.col("s"), F.col("l"))), F.lit(0.0)) / F.greatest(ok, F.lit(1))).alias("avg_latency_ms"),
        conv.alias("conversions"), F.when(ok > 0, conv / ok).otherwise(0.0).alias("conversion_rate"))
        .withColumn("weight", weight).withColumn("position", order))


def ab_winner(results: DataFrame, control: str, min_requests: int = 100, min_success: int = 50,
              min_lift: float = 0.05) -> DataFrame:
    """Zero or one row (variant, lift): largest lift over control above the minimum, given enough data."""
    base = results.agg(
        F.sum("request_count").alias("total"),
        F.max(F.when(F.col("variant") == control, F.col("success_count"))).alias("control_success"),
        F.max(F.when(F.col("variant") == control, F.col("conversion_rate"))).alias("control_rate"))
    rate, c = F.col("conversion_rate"), F.col("control_rate")
    return (results.crossJoin(F.broadcast(base))  # one row
            .where((F.col("variant") != control) & (F.col("total") > min_requests) & (F.col("control_success") >= min_success)
                   & (F.col("success_count") >= min_success))
            .withColumn("lift", F.when(c > 0, (rate - c) / c).otherwise(rate)).where(F.col("lift") > min_lift)
            .orderBy(F.col("lift").desc(), "position").limit(1).select("variant", "lift"))


# -- experiment runs: (experiment, run_id, created_at, metrics map, params map) ----------------

def metric_rows(runs: DataFrame, column: str = "metrics") -> DataFrame:
    """(experiment, run_id, created_at, key, value)."""
    return runs.select("experiment", "run_id", "created_at", F.explode(column).alias("key", "value"))


def get_runs(runs: DataFrame, experiment: str, order_by: str = "created_at", ascending: bool = False,
             limit: int | None = None) -> DataFrame:
    """Runs of an experiment in order; a limit becomes TakeOrdered."""
    key = quoted(order_by)
    out = runs.where(F.col("experiment") == experiment).orderBy(key.asc() if ascending else key.desc(), "run_id")
    return out.limit(limit) if limit else out


def metrics_summary(runs: DataFrame) -> DataFrame:
    """(experiment, metric, min, max, mean, std, count); the deviation is the population one."""
    v = F.col("value")
    return metric_rows(runs).groupBy("experiment", F.col("key").alias("metric")).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.count(v).alias("count"))


def best_run(runs: DataFrame, metric: str = "accuracy", higher_is_better: bool = True) -> DataFrame:
    """(experiment, run_id, value): best run per experiment among those with the metric, first created on a tie."""
    value = F.try_element_at("metrics", F.lit(metric))
    sign = value if higher_is_better else -value
    order = F.struct(sign.alias("v"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), (-F.col("run_id")).alias("i"))
    picked = (runs.where(value.isNotNull()).groupBy("experiment")
              .agg(F.max_by(F.struct("run_id", value.alias("value")), order).alias("r")))
    return picked.select("experiment", "r.run_id", "r.value")


def compare_runs(runs: DataFrame, experiment: str, run_ids: list, metrics: list[str] | None = None) -> DataFrame:
    """(metric, one column per run): null where a run lacks the metric; unknown runs give no column values."""
    rows = metric_rows(runs.where((F.col("experiment") == experiment) & F.col("run_id").isin(run_ids)))
    if metrics:
        rows = rows.where(F.col("key").isin(metrics))
    return rows.groupBy(F.col("key").alias("metric")).pivot("run_id", run_ids).agg(F.first("value"))


def search_runs(runs: DataFrame, condition: str, order_by: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Runs that satisfy a SQL predicate over columns and map fields, e.g. ``metrics['accuracy'] > 0.8``."""
    out = runs.where(F.expr(condition))
    out = out.orderBy(*[F.expr(o.rsplit(" ", 1)[0]).desc() if o.lower().endswith(" desc") else F.expr(o) for o in order_by or []])
    return out.limit(limit) if limit else out


def timeline(runs: DataFrame, experiment: str, metric: str = "accuracy") -> DataFrame:
    """(run_id, created_at, primary_metric), oldest first."""
    return (runs.where(F.col("experiment") == experiment).orderBy("created_at", "run_id")
            .select("run_id", "created_at", F.try_element_at("metrics", F.lit(metric)).alias("primary_metric")))


def list_experiments(runs: DataFrame) -> DataFrame:
    """(experiment, total_runs, created_at, updated_at), last updated first."""
    return (runs.groupBy("experiment").agg(F.count(F.lit(1)).alias("total_runs"), F.min("created_at").alias("created_at"),
                                           F.max("created_at").alias("updated_at"))
            .orderBy(F.col("updated_at").desc(), "experiment"))


def experiment_report(runs: DataFrame) -> DataFrame:
    """One row per experiment: runs, best accuracy and its run."""
    return list_experiments(runs).join(best_run(runs).withColumnRenamed("run_id", "best_run")
                                       .withColumnRenamed("value", "best_value"), "experiment", "left")


# -- model versions: (name, version, status, hash, metrics map, params map) ------------------

def listing(rows: DataFrame, newest: list[str], wanted: dict[str, object] | None = None, limit: int | None = None) -> DataFrame:
    """Versions, deployments or rollbacks whose columns equal what is wanted, by descending ``newest``; all unless limited."""
    out = entity_filter(rows, {k: v for k, v in (wanted or {}).items() if v is not None}).orderBy(*[quoted(c).desc() for c in newest])
    return out if limit is None else out.limit(limit)


def latest_version(versions: DataFrame, stage: str | None = None) -> DataFrame:
    """(name, version): highest version per model, or per model within a stage."""
    rows = versions if stage is None else versions.where(F.col("stage") == stage)
    return rows.groupBy("name").agg(F.max("version").alias("version"))


def compare_versions(versions: DataFrame, name, a: int, b: int) -> DataFrame:
    """(key, a, b, diff): metrics of two versions; diff is null only where one lacks the metric."""
    def side(v: int) -> DataFrame:
        return versions.where((F.col("name") == name) & (F.col("version") == v)).select(F.explode("metrics").alias("key", "value"))
    return align_maps(side(a), side(b)).withColumn("diff", F.col("b") - F.col("a")).drop("changed")


def changed_params(versions: DataFrame, name, a: int, b: int) -> DataFrame:
    """(key, a, b) of the parameters that differ."""
    def side(v: int) -> DataFrame:
        return versions.where((F.col("name") == name) & (F.col("version") == v)).select(F.explode("params").alias("key", "value"))
    return align_maps(side(a), side(b)).where("changed").drop("changed")


def current_stages(transitions: DataFrame) -> DataFrame:
    """(name, version, stage) from a log (name, version, stage, at).

    A version keeps the stage of its last own move, but is archived if another version of the
    model later moved to Production or Staging in its place. Two aggregates and a join.
    """
    own = transitions.groupBy("name", "version").agg(
        F.max_by("stage", "at").alias("stage"), F.max("at").alias("moved_at"))
    holder = (transitions.where(F.col("stage").isin("Production", "Staging")).groupBy("name", "stage")
              .agg(F.max_by("version", "at").alias("holder"), F.max("at").alias("held_since")))
    displaced = (F.col("holder") != F.col("version")) & (F.col("held_since") > F.col("moved_at"))
    return own.join(holder, ["name", "stage"], "left").select(
        "name", "version", F.when(displaced, "Archived").otherwise(F.col("stage")).alias("stage"))


def production_rollback_target(versions: DataFrame, production: DataFrame) -> DataFrame:
    """(name, current, target): highest READY version below the production one."""
    p = production.select("name", F.col("version").alias("current"))
    return (versions.where(F.col("status") == "READY").join(p, "name").where(F.col("version") < F.col("current"))
            .groupBy("name", "current").agg(F.max("version").alias("target")))


def dedupe_by_hash(versions: DataFrame) -> DataFrame:
    """First version of every (name, hash)."""
    return versions.groupBy("name", "hash").agg(F.min("version").alias("version"))


# -- deployments: (environment, deployment_id, kind, at) -------------------------------------

def deployment_states(events: DataFrame) -> DataFrame:
    """(environment, deployment_id, state): failed / active / superseded / rolled_back.

    ``kind`` is deployed, rollback (the named deployment became active again) or failed. An
    active deployment is superseded by the next deployment, rolled back by the next rollback. The last event of a
    deployment decides, so one that failed first and went live later is not failed.
    """
    live = events.where(F.col("kind") != "failed")
    following = next_value(live, ["environment"], "at", ["deployment_id"], "kind", "next_kind", seconds=30 * 86_400)
    state = (F.when(F.col("next_kind").isNull(), "active").when(F.col("next_kind") == "rollback", "rolled_back")
             .otherwise("superseded"))
    failed = events.where(F.col("kind") == "failed").select("environment", "deployment_id", "at", F.lit("failed").alias("state"))
    return (following.select("environment", "deployment_id", "at", state.alias("state")).unionByName(failed)
            .groupBy("environment", "deployment_id").agg(F.max_by("state", F.struct("at", "state")).alias("state")))


def active_deployments(events: DataFrame) -> DataFrame:
    """(environment, deployment_id): the last one made active."""
    return (events.where(F.col("kind") != "failed").groupBy("environment")
            .agg(F.max_by("deployment_id", F.struct("at", "deployment_id")).alias("deployment_id")))


def rollback_targets(versions: DataFrame, environment: str, order: list[str], depth: int = 10) -> DataFrame:
    """All but the newest of the last ``depth`` rows per environment, with their rank from the newest."""
    newest = [quoted(c).desc() for c in order]
    kept = last_n(versions, [environment], newest, depth)
    rank = F.row_number().over(W.partitionBy(environment).orderBy(*newest)) - 1  # at most depth rows each
    return kept.withColumn("rank", rank).where("rank > 0")


def rollback_statistics(rollbacks: DataFrame) -> DataFrame:
    """(dimension, value, n, successful, success_rate): total, by reason and by environment."""
    cut = F.inline(F.array(*[
        F.struct(F.lit(d).alias("dimension"), (quoted(d) if d != "total" else F.lit("all")).cast("string").alias("value"))
        for d in ("total", "reason", "environment")]))
    return (rollbacks.select("success", cut).groupBy("dimension", "value")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("successful"))
            .withColumn("success_rate", F.col("successful") / F.col("n")))
