"""Imputation, encoding, scaling and checks against pandas rules."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions import text
from tablewright.operators import checks, cleaning
from tablewright.plans.profile import validate


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(25.0, "NYC", 1), (None, "LA", 2), (35.0, None, 3), (float("nan"), "LA", 4), (40.0, "NYC", 5)],
                                 "age double, city string, id long")


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_impute(people):
    assert column(cleaning.impute(people, ["age"], "mean"), "age") == [25.0, 100 / 3, 35.0, 100 / 3, 40.0]
    assert column(cleaning.impute(people, ["age", "gone"], "median"), "age") == [25.0, 35.0, 35.0, 35.0, 40.0]
    assert column(cleaning.impute(people, ["city"], "most_frequent"), "city") == ["NYC", "LA", "LA", "LA", "NYC"]
    with pytest.raises(ValueError):
        cleaning.impute(people, ["age"], "guess")


def test_one_hot_and_labels(people):
    hot = cleaning.one_hot(people, "city")
    assert hot.columns == ["age", "id", "city_LA", "city_NYC"] and column(hot, "city_LA") == [0, 1, 0, 1, 0]
    assert column(cleaning.label_encode(people, "city"), "city") == [1, 0, 2, 0, 1]
    mapping = cleaning.label_mapping(people.where("city = 'NYC'"), "city")
    assert column(cleaning.label_encode(people, "city", mapping=mapping), "city") == [0, -1, -1, -1, 0]


def test_label_codes_are_dense_and_sorted(spark):
    rng = np.random.default_rng(0)
    words = sorted({"user-" + str(x) for x in rng.integers(0, 5000, 4000)})
    df = spark.createDataFrame([(w,) for w in rng.permutation(words)], "w string").repartition(11)
    got = {r["label"]: r["code"] for r in cleaning.label_mapping(df, "w").collect()}
    assert got == {w: i for i, w in enumerate(words)}


def test_scaling(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, None, 5.0), (4, 4.0, 5.0)], "id long, x double, c double")
    x = pd.Series([1.0, 2.0, 4.0])
    std = column(cleaning.standard_scale(df, ["x", "c"]), "x")
    assert np.allclose([std[0], std[1], std[3]], (x - x.mean()) / x.std(ddof=0)) and std[2] is None
    assert column(cleaning.standard_scale(df, ["x", "c"]), "c") == [0.0] * 4
    assert column(cleaning.minmax_scale(df, ["x", "c"]), "c") == [0.0] * 4


def test_sanitize(spark):
    df = spark.createDataFrame([(1, float("inf"), "a"), (2, -5.0, "z"), (3, 50.0, None), (4, 3.0, "b")], "id long, x double, k string")
    out = cleaning.sanitize(df, {"x": (0, 10)}, {"k": ["a", "b"]})
    assert column(out, "x") == [3.0, 0.0, 10.0, 3.0] and column(out, "k") == ["a", "a", "a", "b"]


def test_unknown_step_is_passed_over(people):
    seen = []
    out = cleaning.run_steps(people, [{"type": "dance"}, "lowercase_strings"], seen.append)
    assert seen == ["dance"] and column(out, "city") == ["nyc", "la", None, "la", "nyc"]


def test_preprocessor_is_stable_on_new_data(people, spark):
    fitted = cleaning.Preprocessor().fit(people.drop("id"))
    new = fitted.transform(spark.createDataFrame([(30.0, "Paris", 9)], "age double, city string, id long")).first()
    assert new["city"] < 0 and abs(new["age"]) < 1.5


def test_records(spark):
    rules = [checks.FieldRule("n", checks.INTEGER, min_value=0, max_value=9), checks.FieldRule("ok", checks.BOOLEAN, nullable=True),
             checks.FieldRule("s", max_length=5, pattern="[a-z]+", allowed=["abc", "select"]), checks.FieldRule("gone", required=False)]
    df = spark.createDataFrame([("5", "Yes", "abc"), ("x", None, "abc"), ("12", "maybe", "toolong"), (None, "0", "SELECT")], "n string, ok string, s string")
    got = [sorted(f"{v['field']}:{v['code']}" for v in r["violations"]) for r in checks.validate_records(df, rules).collect()]
    assert got == [[], ["n:type"], ["n:above_maximum", "ok:type", "s:not_allowed", "s:too_long"],
                   ["n:null", "s:not_allowed", "s:pattern", "s:sql_injection", "s:too_long"]]
    good = checks.accepted(checks.validate_records(df, rules), rules).first()
    assert (good["n"], good["ok"], good["s"]) == (5, True, "abc")
    assert checks.rejected(checks.validate_records(df, rules, strict=True)).count() == 3


def test_injection_patterns(spark):
    rows = [("1 OR 1=1",), ("drop table x",), ("a; b",), ("<SCRIPT>x</script>",), ("JavaScript:void",), ("<img onload = 'x'>",), ("hello world",), ("selected",)]
    df = spark.createDataFrame(rows, "s string")
    got = [(r[0], r[1]) for r in df.select(text.sql_injection_flag(F.col("s")), text.xss_flag(F.col("s"))).collect()]
    assert got == [(True, False), (True, False), (True, False), (False, True), (False, True), (False, True), (False, False), (False, False)]


def test_html_escape(spark):
    out = spark.createDataFrame([("<a href=\"x\">Tom & 'J'</a>",)], "s string").select(text.html_escape(F.col("s"))).first()[0]
    assert out == "&lt;a href=&quot;x&quot;&gt;Tom &amp; &#x27;J&#x27;&lt;/a&gt;"


def test_md5_bucket(spark):
    import hashlib
    keys = [f"exp:{i}" for i in range(200)]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(text.md5_mod(F.col("k"))).collect()]
    assert got == [int(hashlib.md5(k.encode()).hexdigest(), 16) % 1000 for k in keys]


def test_client_ip_and_log_line(spark):
    df = spark.createDataFrame([("1.1.1.1, 2.2.2.2", "3.3.3.3", "h"), (None, "3.3.3.3", "h"), ("", None, "h")], "f string, r string, h string")
    assert [r[0] for r in df.select(text.client_ip(F.col("f"), F.col("r"), F.col("h"))).collect()] == ["1.1.1.1", "3.3.3.3", "h"]
    line = spark.range(1).select(text.log_line(F.lit("2024-01-01T10:00:00.123456"), F.lit("INFO"), F.lit("done"))).first()[0]
    assert line == "2024-01-01T10:00:00 [INFO] done"


def test_dates_are_detected(spark):
    df = spark.createDataFrame([("2024-01-01", "x", None), ("2024-02-03", "2024-01-01", None)], "d string, s string, n string")
    assert text.date_like_columns(df) == ["d"]


def test_validate(spark):
    df = spark.createDataFrame([(1, None, 7), (1, None, 7), (2, "x", 7)], "a int, b string, c int")
    got = {(r["check"], r["column"], r["severity"]) for r in validate(df, ["a", "z"]).collect()}
    assert got == {("missing_required_column", "z", "issue"), ("high_null_ratio", "b", "warning"), ("constant_column", "c", "warning"),
                   ("constant_column", "b", "warning"), ("duplicate_rows", None, "warning")}
