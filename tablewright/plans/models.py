"""Training, scoring and validation of models with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import quoted
from tablewright.operators.cleaning import Preprocessor, align_to_schema, label_mapping
from tablewright.operators.evaluation import classification_metrics, regression_metrics
from tablewright.operators.sampling import nested_fractions, train_test_split
from tablewright.plans.binned_trees import fit_binned

CLASSIFICATION, REGRESSION = "classification", "regression"
#: numbers (rows times features) that one task of a solver holds
CELLS = 1_000_000
# fixed values: the names models are asked for by
ALGORITHMS = {
    (CLASSIFICATION, "logistic"): lambda p: LogisticRegression(maxIter=p.get("max_iter", 100), regParam=p.get("reg_param", 0.0)),
    (CLASSIFICATION, "random_forest"): lambda p: RandomForestClassifier(
        numTrees=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 10), seed=p.get("seed", 42)),
    (CLASSIFICATION, "gradient_boosting"): lambda p: GBTClassifier(
        maxIter=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 6), stepSize=p.get("learning_rate", 0.1), seed=p.get("seed", 42)),
    (REGRESSION, "linear"): lambda p: LinearRegression(maxIter=p.get("max_iter", 100), regParam=p.get("reg_param", 0.0)),
    (REGRESSION, "random_forest"): lambda p: RandomForestRegressor(
        numTrees=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 10), seed=p.get("seed", 42)),
    (REGRESSION, "gradient_boosting"): lambda p: GBTRegressor(
        maxIter=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 6), stepSize=p.get("learning_rate", 0.1), seed=p.get("seed", 42)),
}


@dataclass
class TrainedModel:
    """A fitted model with everything scoring needs."""

    model: Model
    preprocessor: Preprocessor
    features: list[str]
    target: str
    problem_type: str
    algorithm: str
    classes: list[str] = field(default_factory=list)

    def prepare(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Feature vector beside the kept columns; absent features are filled, extra ones dropped."""
        keep = keep or []
        kept = [quoted(c).alias(f"__keep_{c}") for c in keep]
        wide = df.select(*[quoted(c) for c in df.columns], *kept)
        aligned = align_to_schema(wide, [*self.features, *[f"__keep_{c}" for c in keep]])
        vectors = self._assemble(self.preprocessor.transform(aligned))
        return vectors.select(*[F.col(f"__keep_{c}").alias(c) for c in keep], "features")

    def _assemble(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.features, outputCol="features", handleInvalid="keep").transform(df)

    def score(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Kept columns and ``prediction`` (and ``probability`` of a classifier): one narrow stage."""
        out = self.model.transform(self.prepare(df, keep))
        extra = ["probability"] if "probability" in out.columns else []
        return out.select(*(keep or []), "features", "prediction", *extra)

    def predict(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Adds label, confidence and the ten largest class probabilities, or the formatted number."""
        scored = self.score(df, keep)
        if self.problem_type == REGRESSION:
            return scored.select(*(keep or []), "prediction", F.format_string("%.4f", "prediction").alias("label"))
        names = F.array(*[F.lit(c) for c in self.classes])
        label = names[F.col("prediction").cast("int")]
        if "probability" not in scored.columns:
            return scored.select(*(keep or []), "prediction", label.alias("label"))
        p = vector_to_array("probability")
        ranked = F.array_sort(F.arrays_zip(p.alias("p"), names.alias("c")),
                              lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).otherwise(0))
        top = F.map_from_entries(F.transform(F.slice(ranked, 1, 10), lambda x: F.struct(x["c"], x["p"])))
        return scored.select(*(keep or []), "prediction", label.alias("label"), F.array_max(p).alias("confidence"),
                             top.alias("probabilities"))


def target_labels(df: DataFrame, target: str) -> list[str]:
    """Class names in code order; a classification target has few."""
    return [r["label"] for r in label_mapping(df, target).orderBy("code").collect()]


def encode_target(df: DataFrame, target: str, classes: list[str]) -> Column:
    text = F.coalesce(quoted(target).cast("string"), F.lit("nan"))
    return (F.array_position(F.array(*[F.lit(c) for c in classes]), text) - 1).cast("double")


def spread(df: DataFrame, features: int) -> DataFrame:
    """The rows dealt evenly over tasks of at most about ``CELLS`` numbers, where there are more of them than one task's.

    A solver keeps its rows in the partitions it is given and reads them whole in every pass, so a partition must
    not grow with the table (a small file may hold many rows, and one partition most of the rows).
    """
    parts = -(-df.count() * features // CELLS)
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism)) if parts > 1 else df


def train(df: DataFrame, target: str, problem_type: str, algorithm: str, features: list[str] | None = None,
          params: dict | None = None) -> TrainedModel:
    """Fits encoders, scaling, fills and the model.

    Boosting of more than two classes is one-vs-rest. The assembled training set is persisted
    for the iterations of the solver and spills to disk; that of boosting for numbers is counted by bins (``fit_binned``).
    """
    features = features or [c for c in df.columns if c != target]
    prep = Preprocessor(None).fit(df.select(*[quoted(c) for c in features]))
    classes = target_labels(df, target) if problem_type == CLASSIFICATION else []
    label = encode_target(df, target, classes) if classes else quoted(target).cast("double")
    labelled = df.select(*[quoted(c) for c in features], label.alias("__label")).where(F.col("__label").isNotNull())
    estimator = ALGORITHMS[problem_type, algorithm](params or {})
    out = TrainedModel(None, prep, features, target, problem_type, algorithm, classes)
    if isinstance(estimator, GBTRegressor):
        out.model = fit_binned(estimator, labelled, lambda rows: out._assemble(prep.transform(rows)).select(
            "features", F.col("__label").alias("label")), len(features))
        return out
    encoded = prep.transform(spread(labelled, len(features)))
    if algorithm == "gradient_boosting" and len(classes) > 2:
        estimator = OneVsRest(classifier=estimator)
    ready = out._assemble(encoded).select("features", F.col("__label").alias("label")).persist()
    try:
        out.model = estimator.fit(ready)
    finally:
        ready.unpersist()
    return out


def scored_table(model: TrainedModel, df: DataFrame, key: str) -> DataFrame:
    """(key, actual, pred) with class names, or numbers for a regression."""
    scored = model.predict(df.withColumn("__actual", quoted(model.target)), [key, "__actual"])
    actual, pred = F.col("__actual"), F.col("prediction")
    if model.problem_type == CLASSIFICATION:
        actual, pred = F.coalesce(actual.cast("string"), F.lit("nan")), F.col("label")
    return scored.select(quoted(key), actual.alias("actual"), pred.alias("pred"))


def evaluate(model: TrainedModel, df: DataFrame, key: str) -> DataFrame:
    scored = scored_table(model, df, key)
    return classification_metrics(scored) if model.problem_type == CLASSIFICATION else regression_metrics(scored)


def training_pipeline(df: DataFrame, key: str, target: str, problem_type: str, algorithm: str, test_fraction: float = 0.2,
                      params: dict | None = None, features: list[str] | None = None) -> tuple[TrainedModel, DataFrame]:
    """Validate the columns, split by key, train, evaluate: (model, metrics)."""
    missing = [c for c in [key, target, *(features or [])] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    features = features or [c for c in df.columns if c not in (key, target)]
    training, test = train_test_split(df, key, test_fraction)
    model = train(training, target, problem_type, algorithm, features, params)
    return model, evaluate(model, test, key)


def batch_inference(model: TrainedModel, df: DataFrame, keep: list[str] | None = None, dedupe: bool = False) -> DataFrame:
    """Predictions for all rows in one transform; partitions take the place of batches.

    With ``dedupe`` identical feature rows are scored once and joined back: worth it only
    where most rows repeat, since it costs a shuffle.
    """
    if not dedupe:
        return model.predict(df, keep)
    from tablewright.functions.text import row_key
    present = [c for c in model.features if c in df.columns]
    keyed = df.withColumn("__key", row_key(df, present))
    unique = keyed.groupBy("__key").agg(*[F.first(quoted(c)).alias(c) for c in present])
    scored = model.predict(unique, ["__key"])
    return keyed.select("__key", *[quoted(c) for c in keep or []]).join(scored, "__key").drop("__key")


def learning_curve(df: DataFrame, key: str, target: str, problem_type: str, algorithm: str,
                   fractions: list[float] | None = None, params: dict | None = None) -> DataFrame:
    """(fraction, side, score): accuracy or R² on train and validation for growing nested subsets."""
    features = [c for c in df.columns if c not in (key, target)]
    training, validation = train_test_split(df, key)
    metric = "accuracy" if problem_type == CLASSIFICATION else "r2_score"
    out = None
    for fraction, part in nested_fractions(training, key, fractions or [0.25, 0.5, 1.0]).items():
        model = train(part, target, problem_type, algorithm, features, params)
        for side, rows in (("train", part), ("validation", validation)):
            one = evaluate(model, rows, key).select(
                F.lit(fraction).alias("fraction"), F.lit(side).alias("side"), F.col(metric).alias("score"))
            out = one if out is None else out.unionByName(one)
    return out


# -- validation before a release -----------------------------------------------------------

def model_validation(scored: DataFrame, min_accuracy: float = 0.8, min_samples: int = 100,
                     second: str | None = None, importances: DataFrame | None = None, classifier: bool = True) -> DataFrame:
    """(check, status, value) rows from one aggregate over (actual, pred): PASSED, WARNING, FAILED, SKIPPED.

    ``second`` names a column with a repeated scoring; ``importances`` is (feature, importance).
    """
    numeric = F.expr("try_cast(pred AS DOUBLE)")
    again = F.col(second) if second else F.lit(None).cast("double")
    gap = F.abs(numeric - again) - (1e-8 + 1e-5 * F.abs(again))
    one = scored.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("actual") == F.col("pred")).cast("double")).alias("accuracy"),
        F.stddev_pop(numeric).alias("spread"), F.min("pred").alias("lo"), F.max("pred").alias("hi"), F.max(gap).alias("gap"))
    constant = F.coalesce(F.col("spread") < 1e-6, F.lit(False))
    single = F.lit(classifier) & (F.col("lo") == F.col("hi"))

    def row(name: str, status: Column, value: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), status.alias("status"), value.cast("double").alias("value"))

    performance = (F.when(F.col("n") < min_samples, "WARNING").when(F.col("accuracy") >= min_accuracy, "PASSED").otherwise("FAILED"))
    repeat = F.when(F.col("gap").isNull(), "SKIPPED").when(F.col("gap") <= 0, "PASSED").otherwise("WARNING")
    checks = one.select(F.inline(F.array(
        row("performance_check", performance, F.col("accuracy")),
        row("prediction_distribution_check", F.when(constant | single, "WARNING").otherwise("PASSED"), F.col("spread")),
        row("reproducibility_check", repeat, F.col("gap")))))
    if importances is None:
        extra = one.select(F.lit("feature_importance_check").alias("check"), F.lit("SKIPPED").alias("status"),
                           F.lit(None).cast("double").alias("value"))
    else:
        share = F.try_divide(F.max("importance"), F.sum("importance"))
        extra = importances.agg(share.alias("value")).select(
            F.lit("feature_importance_check").alias("check"), F.when(F.col("value") > 0.8, "WARNING").otherwise("PASSED").alias("status"), "value")
    return checks.unionByName(extra)


def overall_status(checks: DataFrame) -> DataFrame:
    """One row: FAILED if any check failed, else WARNING if any warned, else PASSED."""
    return checks.agg(F.when(F.count_if(F.col("status") == "FAILED") > 0, "FAILED")
                      .when(F.count_if(F.col("status") == "WARNING") > 0, "WARNING").otherwise("PASSED").alias("overall_status"))


def run_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, passed) of caller-supplied aggregate expressions, all in one aggregate."""
    return df.agg(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()])
                  .alias("r")).select(F.inline("r"))
