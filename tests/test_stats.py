from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from postweir.functions.stats import binomial_p_value, binomial_test
from postweir.operators import bots, evaluation, significance


def exact(x: int, n: int, p: Fraction, alternative: str) -> float:
    pmf = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
    if alternative == "greater":
        return float(sum(pmf[x:]))
    return float(min(1, sum(q for q in pmf if q <= pmf[x] * (1 + Fraction(1, 10**7)))))


@pytest.mark.parametrize("alternative", ["two-sided", "greater"])
def test_binomial_equals_exact_sums(alternative):
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 120)
        x, p = rng.randint(0, n), Fraction(rng.randint(1, 99), 100)
        assert binomial_p_value(x, n, float(p), alternative) == pytest.approx(exact(x, n, p, alternative), rel=1e-9)


def test_binomial_limits():
    assert binomial_p_value(0, 5, 0.0) == 1.0 and binomial_p_value(5, 5, 1.0, "greater") == 1.0
    assert binomial_p_value(1, 5, 0.0, "greater") == 0.0 and binomial_p_value(4, 5, 1.0) == 0.0
    # normal limit with large numbers: 4 standard deviations, two-sided
    n = 10**9
    assert binomial_p_value(n // 2 + 2 * math.isqrt(n), n, 0.5) == pytest.approx(math.erfc(4 / math.sqrt(2)), rel=1e-2)


def test_binomial_column(spark):
    df = spark.createDataFrame([(3, 10, 0.5), (0, 0, 0.5)], "x long, n long, p double")
    got = [r[0] for r in df.select(binomial_test(F.col("x"), F.col("n"), F.col("p"))).collect()]
    assert got[0] == pytest.approx(0.34375) and got[1] is None


def test_rows_without_group_count_for_the_overall_rate_only(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True), (None, False), (None, False)], "g string, ok boolean")
    rows = {r["grp"]: r for r in significance.group_significance(df, "g", "ok", "greater").collect()}
    assert set(rows) == {"a", "b"}
    assert rows["b"]["p_value"] == pytest.approx(0.4) and rows["a"]["fraction"] == 0.5
    assert not rows["b"]["is_sig"]


def report(spark, pairs, run="r"):
    df = spark.createDataFrame([(run, y, z) for y, z in pairs], "run string, label string, prediction string")
    return {(r["metric"], r["label"]): r["value"] for r in evaluation.classification_report(df).collect()}


def test_report_of_a_small_case(spark):
    got = report(spark, [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")])
    assert got[("accuracy", None)] == 0.5 == got[("f1_micro", None)]
    assert got[("precision", "b")] == pytest.approx(1 / 3) and got[("precision", "c")] == 0.0
    assert got[("recall_macro", None)] == pytest.approx((0.5 + 1 + 0) / 3)
    assert got[("f1_weighted", None)] == pytest.approx((2 * (2 / 3) + 0.5 + 0) / 4)
    # c=2, s=4, true (2,1,1), predicted (1,3,0)
    assert got[("matthews_corrcoef", None)] == pytest.approx((2 * 4 - 5) / math.sqrt((16 - 10) * (16 - 6)))
    assert got[("cohen_kappa", None)] == pytest.approx((0.5 - 5 / 16) / (1 - 5 / 16))
    assert ("f1_binary", None) not in got


def test_binary_metrics_need_the_positive_label(spark):
    assert report(spark, [("1", "1"), ("0", "1")])[("precision_binary", None)] == 0.5
    assert ("precision_binary", None) not in report(spark, [("x", "x"), ("y", "x")])
    assert ("precision_binary", None) not in report(spark, [("1", "1"), ("2", "1"), ("3", "3")])


def test_single_label(spark):
    got = report(spark, [("a", "a")])
    assert got[("matthews_corrcoef", None)] == 0.0 and math.isnan(got[("cohen_kappa", None)])


def test_bots(spark):
    schema = "user struct<id_str:string,screen_name:string>, cap struct<universal:double,english:double>, scores struct<universal:double,english:double>"
    df = spark.createDataFrame([((("1"), "s1"), (0.25, 0.1), (1.0, 2.0)), (("2", None), (0.26, 0.1), (1.0, 2.0)), (None, (0.9, 0.9), (1.0, 1.0)), (("3", "s3"), None, None)], schema)
    flat = bots.flatten_bots(df)
    assert {r["user_id"]: r["is_bot"] for r in flat.collect()} == {"1": False, "2": True, "3": False}
    annotated = spark.createDataFrame([("s1", "x"), (None, "y")], "username string, kind string")
    assert bots.join_annotations(flat, annotated).count() == 1
    assert bots.join_annotations(flat, annotated, null_safe=True).count() == 2
