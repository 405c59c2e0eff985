"""Distribution drift between a reference and a current frame.

Both frames are tagged and unioned once; every method is a formula over one of three
small count tables: equal-width bins, category counts, or counts per distinct value.

The last of them (``value_counts``) gives the other two, adds up, and says all there is to say
about a column, so a reference can be stored in that form once and be tested against again
and again without being read (``DriftReference``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import (CATEGORICAL, NUMERIC, as_double, is_missing, kind_of, melt, quoted, stats_rows)
from tablewright.functions.lineage import cut_lineage
from tablewright.functions.pvalues import chi2_tail, kolmogorov_tail, ks_tail, normal_cdf
from tablewright.operators.histograms import bin_index
from tablewright.operators.running import RANGE, ranged_melt, running_totals

THRESHOLDS = {"psi": 0.2, "kl_divergence": 0.1, "js_divergence": 0.1, "ks_test": 0.05, "chi_square": 0.05}
P_VALUE_METHODS = ("ks_test", "chi_square")
FLOOR = 0.0001
EPS = 1e-8


def shared_columns(reference: DataFrame, current: DataFrame, kind: str | None = None) -> list[str]:
    """Columns both frames hold, in reference order (schema only)."""
    return [f.name for f in reference.schema.fields
            if f.name in current.columns and (kind is None or kind_of(f.dataType) == kind)]


def tagged(reference: DataFrame, current: DataFrame, cols: list[str]) -> DataFrame:
    """Union of both sides with is_ref = 1 or 0."""
    return (reference.select(*cols, F.lit(1).alias("is_ref"))
            .unionByName(current.select(*cols, F.lit(0).alias("is_ref"))))


def _sides() -> list[Column]:
    return [F.sum("is_ref").cast("bigint").alias("ref_n"),
            F.sum(1 - F.col("is_ref")).cast("bigint").alias("cur_n")]


def numeric_bins(reference: DataFrame, current: DataFrame, cols: list[str] | None = None, bins: int = 10,
                 own_range: bool = False) -> DataFrame:
    """(column, bin, ref_n, cur_n) on a complete grid; lo = hi is kept as a flat column.

    Bins span the joint range; with ``own_range`` each side is cut on its own range.
    """
    cols = cols or shared_columns(reference, current, NUMERIC)
    both = tagged(reference, current, cols)

    def span(d: DataFrame, c: str) -> list[Column]:
        v, ref = as_double(d, c), F.col("is_ref") == 1
        sides = [("ref", F.when(ref, v)), ("cur", F.when(~ref, v))]
        if own_range:
            return [f(x).alias(f"{s}_{n}") for s, x in sides for n, f in (("lo", F.min), ("hi", F.max))]
        return [F.min(v).alias("ref_lo"), F.max(v).alias("ref_hi"), F.min(v).alias("cur_lo"), F.max(v).alias("cur_hi")]

    spans = stats_rows(both, cols, span).where(F.col("ref_lo").isNotNull() & F.col("cur_lo").isNotNull())
    lo = F.when(F.col("is_ref") == 1, F.col("ref_lo")).otherwise(F.col("cur_lo"))
    hi = F.when(F.col("is_ref") == 1, F.col("ref_hi")).otherwise(F.col("cur_hi"))
    if own_range:  # the deployed rule truncates and clips instead of comparing with edges
        place = F.least(F.floor((F.col("value") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    else:
        place = bin_index(F.col("value"), lo, hi, bins)
    counted = (melt(both, cols, ["is_ref"]).join(F.broadcast(spans), "column")
               .select("column", "is_ref", F.when(hi == lo, 0).otherwise(place).alias("bin"))
               .groupBy("column", "bin").agg(*_sides()))
    grid = spans.select("column", ((F.col("ref_lo") == F.col("ref_hi")) | (F.col("cur_lo") == F.col("cur_hi")))
                        .alias("flat"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (grid.join(counted, ["column", "bin"], "left")
            .fillna({"ref_n": 0, "cur_n": 0}).select("column", "bin", "flat", "ref_n", "cur_n"))


def category_counts(reference: DataFrame, current: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, value, ref_n, cur_n): the full outer alignment of both count tables in one group-by."""
    cols = cols or shared_columns(reference, current, CATEGORICAL)
    both = tagged(reference, current, cols)
    return melt(both, cols, ["is_ref"], to="string").groupBy("column", "value").agg(*_sides())


def with_totals(counts: DataFrame) -> DataFrame:
    """Adds per-column totals of both sides and the number of cells."""
    totals = counts.groupBy("column").agg(F.sum("ref_n").alias("ref_total"), F.sum("cur_n").alias("cur_total"),
                                          F.count(F.lit(1)).alias("cells"))
    return counts.join(F.broadcast(totals), "column")  # one row per column


def _shares(kind: str, variant: str, method: str) -> tuple[Column, Column]:
    r, c = F.col("ref_n"), F.col("cur_n")
    rt, ct, k = F.col("ref_total"), F.col("cur_total"), F.col("cells")
    if kind == NUMERIC:
        if variant == "monitor":
            return (r + 1) / (rt + k), (c + 1) / (ct + k)
        if variant == "service":
            return (r + EPS) / (rt + EPS * k), (c + EPS) / (ct + EPS * k)
        if variant == "deployed":
            return F.greatest(F.try_divide(r, rt), F.lit(FLOOR)), F.greatest(F.try_divide(c, ct), F.lit(FLOOR))
    elif variant == "monitor":
        if method == "psi":
            return F.greatest(F.try_divide(r, rt), F.lit(FLOOR)), F.greatest(F.try_divide(c, ct), F.lit(FLOOR))
        return F.when(r == 0, FLOOR).otherwise(F.try_divide(r, rt)), F.when(c == 0, FLOOR).otherwise(F.try_divide(c, ct))
    elif variant == "service":
        return (r.cast("double"), c.cast("double")) if method == "psi" else (F.try_divide(r, rt), F.try_divide(c, ct))
    raise ValueError(f"no {variant} variant of {method} for {kind} columns")


def divergence(counts: DataFrame, method: str, kind: str, variant: str = "monitor") -> DataFrame:
    """(column, score) of psi / kl_divergence / js_divergence from a count table.

    variants: ``monitor`` (smoothed or floored shares), ``service`` (1e-8 added; categorical PSI
    on raw counts, not shares), ``deployed`` (shares clipped at 1e-4, numeric only).
    """
    p, q = F.col("p"), F.col("q")
    eps = EPS if variant == "service" else 0.0
    if method == "psi":
        term = (q - p) * F.ln((q + eps) / (p + eps))
    elif method == "kl_divergence":
        term = p * F.ln((p + eps) / (q + eps))
    elif method == "js_divergence":
        m = 0.5 * (p + q)
        term = 0.5 * p * F.ln(p / m) + 0.5 * q * F.ln(q / m)
    else:
        raise ValueError(f"unknown method {method}")
    ref_share, cur_share = _shares(kind, variant, method)
    flat = F.col("flat") if "flat" in counts.columns else F.lit(False)
    return (with_totals(counts)
            .select("column", flat.alias("flat"), ref_share.alias("p"), cur_share.alias("q"))
            .groupBy("column").agg(F.sum(F.when(F.col("flat"), 0.0).otherwise(term)).alias("score")))


def ks_two_sample(reference: DataFrame, current: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, score, p_value, n_ref, n_cur): exact statistic from counts per distinct value.

    Counts combine before the shuffle; the running totals use ranges of values, so no task
    ever holds a whole column.
    """
    cols = cols or shared_columns(reference, current, NUMERIC)
    both = tagged(reference, current, cols)
    return _ks(ranged_melt(both, cols, ["is_ref"]).groupBy("column", RANGE, "value").agg(*_sides()))


def _ks(counted: DataFrame) -> DataFrame:
    """The statistic from (column, range, value, ref_n, cur_n)."""
    totals = counted.groupBy("column").agg(F.sum("ref_n").alias("n_ref"), F.sum("cur_n").alias("n_cur"))
    running = running_totals(counted, "value", ["ref_n", "cur_n"], ["column"])
    gap = F.abs(F.col("cum_ref_n") / F.col("n_ref") - F.col("cum_cur_n") / F.col("n_cur"))
    return (running.join(F.broadcast(totals), "column").where((F.col("n_ref") > 0) & (F.col("n_cur") > 0))
            .groupBy("column", "n_ref", "n_cur").agg(F.max(gap).alias("score"))
            .withColumn("p_value", ks_tail(F.col("score"), F.col("n_ref"), F.col("n_cur"))))


def value_counts(df: DataFrame, numeric: list[str], texts: list[str]) -> DataFrame:
    """(column, value, text, n): how often each value occurs; one scan, combined before the shuffle."""
    cells = [F.struct(F.lit(c).alias("column"), as_double(df, c).alias("value"), F.lit(None).cast("string").alias("text")) for c in numeric]
    cells += [F.struct(F.lit(c).alias("column"), F.lit(None).cast("double").alias("value"),
                       F.when(~is_missing(df, c), quoted(c).cast("string")).alias("text")) for c in texts]
    long = df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull() | F.col("text").isNotNull())
    return long.groupBy("column", "value", "text").agg(F.count(F.lit(1)).alias("n"))


def aligned_counts(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(column, value, text, ref_n, cur_n) of two tables of value counts, or of several parts of either."""
    zero = F.lit(0).cast("bigint")
    both = reference.select("column", "value", "text", F.col("n").alias("ref_n"), zero.alias("cur_n")).unionByName(
        current.select("column", "value", "text", zero.alias("ref_n"), F.col("n").alias("cur_n")))
    return both.groupBy("column", "value", "text").agg(F.sum("ref_n").alias("ref_n"), F.sum("cur_n").alias("cur_n"))


def _bins_of_counts(numbers: DataFrame, bins: int = 10) -> DataFrame:
    """``numeric_bins`` from aligned counts of numbers."""
    spans = numbers.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    place = F.when(F.col("lo") == F.col("hi"), 0).otherwise(bin_index(F.col("value"), F.col("lo"), F.col("hi"), bins))
    counted = numbers.join(F.broadcast(spans), "column").groupBy("column", place.alias("bin")).agg(
        F.sum("ref_n").alias("ref_n"), F.sum("cur_n").alias("cur_n"))
    grid = spans.select("column", (F.col("lo") == F.col("hi")).alias("flat"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counted, ["column", "bin"], "left").fillna({"ref_n": 0, "cur_n": 0}).select("column", "bin", "flat", "ref_n", "cur_n")


def _ranged_counts(numbers: DataFrame, ranges: int = 64) -> DataFrame:
    """Distinct values with ranges of about equal depth per column (one row of cut points a column)."""
    probs = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = F.broadcast(numbers.groupBy("column").agg(F.percentile_approx("value", probs, F.lit(4 * ranges)).alias("cuts")))
    return numbers.join(cuts, "column").select("column", "value", "ref_n", "cur_n", F.size(F.filter("cuts", lambda c: c < F.col("value"))).alias(RANGE))


class DriftReference:
    """A reference kept as value counts in a folder; new parts may be added, every reader merges them."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def store(cls, reference: DataFrame, path: str, columns: list[str] | None = None) -> DriftReference:
        """Reads the reference once."""
        kept = [f for f in reference.schema.fields if columns is None or f.name in columns]
        numeric, texts = ([f.name for f in kept if kind_of(f.dataType) == k] for k in (NUMERIC, CATEGORICAL))
        out = cls(reference.sparkSession, path)
        kinds = [(c, NUMERIC) for c in numeric] + [(c, CATEGORICAL) for c in texts]
        reference.sparkSession.createDataFrame(kinds, "column string, kind string").coalesce(1).write.parquet(f"{out.path}/columns")
        value_counts(reference, numeric, texts).write.parquet(f"{out.path}/counts")
        return out

    def add(self, more: DataFrame) -> None:
        """Counts of further reference rows join those stored."""
        numeric, texts = self.columns()
        value_counts(more, numeric, texts).write.mode("append").parquet(f"{self.path}/counts")

    def columns(self) -> tuple[list[str], list[str]]:
        kinds = [(r["column"], r["kind"]) for r in self.spark.read.parquet(f"{self.path}/columns").collect()]
        return tuple(sorted(c for c, k in kinds if k == kind) for kind in (NUMERIC, CATEGORICAL))

    def detect(self, current: DataFrame, methods: list[str] | None = None, thresholds: dict[str, float] | None = None) -> DataFrame:
        """``detect_drift`` of the stored reference and these rows."""
        numeric, texts = ([c for c in side if c in current.columns] for side in self.columns())
        stored = self.spark.read.parquet(f"{self.path}/counts").where(F.col("column").isin([*numeric, *texts]))
        return _report(stored, value_counts(current, numeric, texts), numeric, texts, methods or ["psi", "ks_test"], thresholds)


def _report(reference: DataFrame, current: DataFrame, numeric: list[str], texts: list[str], methods: list[str],
            thresholds: dict[str, float] | None) -> DataFrame:
    """The drift report from value counts; they are aligned once for all methods."""
    counts = cut_lineage(aligned_counts(reference, current))
    numbers = counts.where(F.col("column").isin(numeric) & F.col("value").isNotNull()).drop("text")
    cats = counts.where(F.col("column").isin(texts)).select("column", F.col("text").alias("value"), "ref_n", "cur_n")
    sources = {"bins": _bins_of_counts(numbers) if numeric else None, "cats": cats if texts else None,
               "ks": (lambda: _ks(_ranged_counts(numbers))) if numeric else None, "values": numbers if numeric else None}
    return _judged(sources, methods, thresholds)


def chi_square(counts: DataFrame) -> DataFrame:
    """(column, score, p_value): goodness of fit of current to reference, +1 on every count."""
    r, c = F.col("ref_n") + 1, F.col("cur_n") + 1
    rt, ct = F.col("ref_total") + F.col("cells"), F.col("cur_total") + F.col("cells")
    expected = r * ct / rt
    return (with_totals(counts)
            .groupBy("column", "cells").agg(F.sum(F.pow(c - expected, 2) / expected).alias("score"))
            .withColumn("p_value", chi2_tail(F.col("score"), F.col("cells") - 1)).drop("cells"))


def _kept(reference: DataFrame, current: DataFrame, columns: list[str] | None, kind: str) -> list[str]:
    return [c for c in shared_columns(reference, current, kind) if columns is None or c in columns]


def detect_drift(reference: DataFrame, current: DataFrame, methods: list[str] | None = None,
                 columns: list[str] | None = None, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(column, method, score, p_value, threshold, drift_detected, error): long form, one row per test.

    Divergences drift at score ≥ threshold, tests at p < threshold. KS on a text column is
    reported as an error row, as a failed method, not as no drift.
    """
    methods = methods or ["psi", "ks_test"]
    numeric = _kept(reference, current, columns, NUMERIC)
    texts = _kept(reference, current, columns, CATEGORICAL)
    if set(methods) & set(P_VALUE_METHODS):  # tests look at single values: one table of them serves all methods
        return _report(value_counts(reference, numeric, texts), value_counts(current, numeric, texts), numeric, texts, methods, thresholds)
    return _judged({"bins": numeric_bins(reference, current, numeric) if numeric else None,
                    "cats": category_counts(reference, current, texts) if texts else None}, methods, thresholds)


def _judged(sources: dict, methods: list[str], thresholds: dict[str, float] | None) -> DataFrame:
    """The report of the methods from their count tables."""
    limits = {**THRESHOLDS, **(thresholds or {})}
    bins, cats = sources["bins"], sources["cats"]
    parts: list[DataFrame] = []

    def add(scored: DataFrame, method: str, error: str | None = None) -> None:
        parts.append(scored.select(
            "column", F.lit(method).alias("method"), F.col("score").cast("double").alias("score"),
            (F.col("p_value") if "p_value" in scored.columns else F.lit(None).cast("double")).alias("p_value"),
            F.lit(error).cast("string").alias("error")))

    for method in methods:
        if method in ("psi", "kl_divergence", "js_divergence"):
            for counts, kind in ((bins, NUMERIC), (cats, CATEGORICAL)):
                if counts is not None:
                    add(divergence(counts, method, kind), method)
        elif method == "ks_test":
            if bins is not None:
                add(sources["ks"](), method)
            if cats is not None:
                add(cats.select("column").distinct().withColumn("score", F.lit(None).cast("double")), method,
                    "KS test requires numeric data")
        elif method == "chi_square":
            if bins is not None:
                add(chi_square(sources["values"]), method)
            if cats is not None:
                add(chi_square(cats), method)
        else:
            raise ValueError(f"unknown drift method {method}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    limit = F.element_at(F.create_map(*[x for m, v in limits.items() for x in (F.lit(m), F.lit(float(v)))]), F.col("method"))
    hit = F.when(F.col("method").isin(*P_VALUE_METHODS), F.col("p_value") < F.col("threshold")).otherwise(
        F.col("score") >= F.col("threshold"))
    return (out.withColumn("threshold", limit).withColumn("drift_detected", F.coalesce(hit, F.lit(False))))


def column_verdicts(report: DataFrame) -> DataFrame:
    """(column, drift_detected): a column drifts if any of its methods says so."""
    return report.groupBy("column").agg(F.bool_or("drift_detected").alias("drift_detected"))


def overall_drift(report: DataFrame) -> DataFrame:
    """One row: verdict, mean score of the detected tests, drifted columns in name order."""
    hit = F.col("drift_detected")
    return report.agg(
        F.bool_or("drift_detected").alias("drift_detected"),
        F.coalesce(F.avg(F.when(hit, F.col("score"))), F.lit(0.0)).alias("overall_drift_score"),
        F.array_sort(F.collect_set(F.when(hit, F.col("column")))).alias("columns_with_drift"))  # ≤ schema width


def check_drift(reference: DataFrame, current: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(column, kind, score, sums_match, drift_detected): KS statistic for numbers, min(χ²/100, 1) on
    shares with 0.001 for an absent category otherwise; the χ² counts as 0 where the two sets of
    shares do not add up alike."""
    parts = []
    numeric = shared_columns(reference, current, NUMERIC)
    if numeric:
        parts.append(ks_two_sample(reference, current, numeric).select(
            "column", F.lit(NUMERIC).alias("kind"), "score", F.lit(None).cast("boolean").alias("sums_match")))
    texts = shared_columns(reference, current, CATEGORICAL)
    if texts:
        p = F.when(F.col("ref_n") == 0, 0.001).otherwise(F.col("ref_n") / F.col("ref_total"))
        q = F.when(F.col("cur_n") == 0, 0.001).otherwise(F.col("cur_n") / F.col("cur_total"))
        chi = (with_totals(category_counts(reference, current, texts)).select("column", p.alias("p"), q.alias("q"))
               .groupBy("column").agg(F.sum(F.pow(F.col("q") - F.col("p"), 2) / F.col("p")).alias("chi"),
                                      F.sum("p").alias("ps"), F.sum("q").alias("qs")))
        match = F.abs(F.col("ps") - F.col("qs")) / F.least("ps", "qs") <= 1.5e-8
        parts.append(chi.select("column", F.lit(CATEGORICAL).alias("kind"),
                                F.when(match, F.least(F.col("chi") / 100, F.lit(1.0))).otherwise(0.0).alias("score"),
                                match.alias("sums_match")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("score", F.round("score", 4)).withColumn("drift_detected", F.col("score") > threshold)


def drift_health(scores: DataFrame) -> DataFrame:
    """One row: max(0, 100 − 100 · largest score)."""
    return scores.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("max_drift")).select(
        "max_drift", F.round(F.greatest(F.lit(0.0), 100 - F.col("max_drift") * 100), 2).alias("health_score"))


def monitor_drift(reference: DataFrame, current: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(column, psi, kl_divergence, adwin_drift, drift_detected) with the service formulas."""
    parts = []
    numeric = shared_columns(reference, current, NUMERIC)
    texts = shared_columns(reference, current, CATEGORICAL)
    sources = [(numeric_bins(reference, current, numeric), NUMERIC)] if numeric else []
    if texts:
        sources.append((category_counts(reference, current, texts), CATEGORICAL))
    for counts, kind in sources:
        psi = divergence(counts, "psi", kind, "service").withColumnRenamed("score", "psi")
        kl = divergence(counts, "kl_divergence", kind, "service").withColumnRenamed("score", "kl_divergence")
        parts.append(psi.join(kl, "column"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    above = (F.abs("psi") > threshold) | (F.abs("kl_divergence") > threshold)
    return (out.withColumn("adwin_drift", above)
            .withColumn("drift_detected", (F.col("psi") > threshold) | (F.col("kl_divergence") > threshold)))


def baseline_check(baseline_numeric: DataFrame, baseline_shares: DataFrame, current: DataFrame,
                   thresholds: dict[str, float] | None = None) -> DataFrame:
    """Drift of ``current`` against stored statistics only.

    ``baseline_numeric`` is (column, mean, std), ``baseline_shares`` (column, value, share).
    Numbers are tested against the fitted normal law itself (one-sample KS and PSI over ten
    bins of the current range), which makes the result repeatable.
    """
    limits = {"psi": 0.2, "ks": 0.1, "chi2": 0.05, **(thresholds or {})}
    numeric = [f.name for f in current.schema.fields if kind_of(f.dataType) == NUMERIC]
    base = baseline_numeric.where(F.col("std") > 0).select("column", "mean", "std")
    parts = []
    if numeric:
        counted = (ranged_melt(current, numeric).groupBy("column", RANGE, "value").agg(F.count(F.lit(1)).alias("m")))
        totals = counted.groupBy("column").agg(F.sum("m").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        running = running_totals(counted, "value", ["m"], ["column"]).join(
            F.broadcast(totals.join(F.broadcast(base), "column")), "column")
        cdf = normal_cdf((F.col("value") - F.col("mean")) / F.col("std"))
        at, before = F.col("cum_m") / F.col("n"), (F.col("cum_m") - F.col("m")) / F.col("n")
        step = (F.col("hi") - F.col("lo")) / 10
        per_bin = (running.withColumn("d", F.greatest(F.abs(at - cdf), F.abs(before - cdf)))
                   .withColumn("bin", F.when(F.col("hi") == F.col("lo"), 0)
                               .otherwise(bin_index(F.col("value"), F.col("lo"), F.col("hi"), 10)))
                   .groupBy("column", "bin", "n", "lo", "hi", "mean", "std")
                   .agg(F.sum("m").alias("m"), F.max("d").alias("d")))
        keys = ["column", "n", "lo", "hi", "mean", "std"]
        ks = per_bin.groupBy(*keys).agg(F.max("d").alias("ks_statistic"))
        full = (ks.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(9))))
                .join(per_bin.select("column", "bin", "m"), ["column", "bin"], "left").fillna({"m": 0}))
        left, right = F.col("lo") + F.col("bin") * step, F.col("lo") + (F.col("bin") + 1) * step
        z1, z2 = (left - F.col("mean")) / F.col("std"), (right - F.col("mean")) / F.col("std")
        # tails belong to the outer bins
        p_low = F.when(F.col("bin") == 0, 0.0).otherwise(normal_cdf(z1))
        p_high = F.when(F.col("bin") == 9, 1.0).otherwise(normal_cdf(z2))
        e = F.greatest(p_high - p_low, F.lit(FLOOR))
        a = F.greatest(F.col("m") / F.col("n"), F.lit(FLOOR))
        num = (full.groupBy("column", "n", "ks_statistic").agg(F.sum((a - e) * F.ln(a / e)).alias("psi"))
               .withColumn("p_value", kolmogorov_tail(F.col("ks_statistic"), F.col("n"), F.lit(1e15))))
        parts.append(num.select(
            "column", F.lit(NUMERIC).alias("kind"), "psi", F.col("ks_statistic").alias("statistic"), "p_value",
            ((F.col("psi") > limits["psi"]) | (F.col("p_value") < limits["ks"])).alias("drift_detected")))
    texts = [f.name for f in current.schema.fields if kind_of(f.dataType) == CATEGORICAL]
    if texts:
        now = melt(current, texts, to="string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        total = now.groupBy("column").agg(F.sum("n").alias("total"))
        shares = now.join(F.broadcast(total), "column").select("column", "value", (F.col("n") / F.col("total")).alias("q"))
        both = (shares.join(baseline_shares.withColumnRenamed("share", "p"), ["column", "value"], "full_outer")
                .join(F.broadcast(total.select("column")), "column").fillna({"p": 0.001, "q": 0.001}))
        sums = both.groupBy("column").agg(F.sum("p").alias("ps"), F.sum("q").alias("qs"), F.count(F.lit(1)).alias("k"))
        p, q = F.col("p") / F.col("ps"), F.col("q") / F.col("qs")
        chi = (both.join(F.broadcast(sums), "column").groupBy("column", "k")
               .agg(F.sum(F.pow(q - p, 2) / p).alias("statistic"))
               .withColumn("p_value", chi2_tail(F.col("statistic"), F.col("k") - 1)))
        parts.append(chi.select("column", F.lit(CATEGORICAL).alias("kind"), F.lit(None).cast("double").alias("psi"),
                                "statistic", "p_value", (F.col("p_value") < limits["chi2"]).alias("drift_detected")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def drift_alerts(report: DataFrame, model_id: str, detected_at: Column) -> DataFrame:
    """Alert rows of the detected tests with LOW / MEDIUM / HIGH severity by score over threshold."""
    ratio = F.when(F.col("method").isin(*P_VALUE_METHODS), F.col("threshold") / F.greatest("p_value", F.lit(1e-12))
                   ).otherwise(F.col("score") / F.col("threshold"))
    severity = F.when(ratio >= 3, "HIGH").when(ratio >= 1.5, "MEDIUM").otherwise("LOW")
    return report.where("drift_detected").select(
        F.lit(model_id).alias("model_id"), F.col("method").alias("metric"), F.col("score").alias("value"),
        "threshold", severity.alias("severity"), "column", detected_at.alias("detected_at"))


def degradation(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(metric, baseline, current, change, change_pct, threshold_pct, degraded) for metrics in both.

    ``baseline`` and ``current`` are (metric, value). Scores fall, errors rise; the tolerated
    change is relative to the baseline.
    """
    # fixed values: tolerated relative change per metric, 0.1 for any other
    tolerated = {"accuracy": 0.05, "f1_score": 0.05, "precision": 0.05, "recall": 0.05,
                 "mse": 0.1, "rmse": 0.1, "mae": 0.1, "r2_score": 0.05}
    limit = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in tolerated.items() for x in (F.lit(k), F.lit(v))]),
                                        F.col("metric")), F.lit(0.1))
    falls = F.col("metric").isin("accuracy", "precision", "recall", "f1_score", "r2_score")
    b, c = F.col("baseline"), F.col("current")
    change = F.when(falls, b - c).otherwise(c - b)
    joined = (baseline.select("metric", F.col("value").alias("baseline"))
              .join(current.select("metric", F.col("value").alias("current")), "metric"))
    return joined.select(
        "metric", "baseline", "current", change.alias("change"),
        F.when(b != 0, change / b * 100).otherwise(0.0).alias("change_pct"), (limit * 100).alias("threshold_pct"),
        (change > b * limit).alias("degraded"))
