"""Fits and test statistics against dense algebra, tables and Spark ML."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewright.functions.student import central_quantile, with_two_sided_p
from ratewright.operators.compare import spearman
from ratewright.operators.models import ols_fixed_effects


@pytest.mark.parametrize(
    "t,df,p",
    [
        # Two-sided tails of Student's t.
        (12.706204736, 1, 0.05),
        (2.228138852, 10, 0.05),
        (2.570581836, 5, 0.05),
        (1.959964042, 10_000_000, 0.05),
        (3.290526731, 10_000_000_000, 0.001),
        (0.0, 18, 1.0),
    ],
)
def test_tails(spark, t, df, p):
    assert tail(spark, t, df) == pytest.approx(p, rel=2e-6, abs=1e-12)


def tail(spark, t, df):
    return with_two_sided_p(spark.range(1), F.lit(t), F.lit(df).cast("bigint"), "p").collect()[0]["p"]


def test_far_tail(spark):
    assert tail(spark, -15.0, 10**9) == pytest.approx(math.erfc(15 / math.sqrt(2)), rel=1e-4)


def test_series_and_transformation_meet(spark):
    p = [tail(spark, 2.5, df) for df in (199, 200, 201, 202)]
    assert all(0 < a - b < 1e-5 for a, b in zip(p, p[1:]))


def test_no_degrees_of_freedom(spark):
    assert tail(spark, 2.5, 0) is None


def quantile(spark, df, confidence=0.95):
    return spark.range(1).select(central_quantile(confidence, F.lit(df))).collect()[0][0]


@pytest.mark.parametrize(
    "df,t",
    [
        # Two-sided 5 per cent points of Student's t.
        (1, 12.706204736),
        (2, 4.302652730),
        (3, 3.182446305),
        (5, 2.570581836),
        (10, 2.228138852),
        (30, 2.042272456),
        (100, 1.983971519),
        (10**6, 1.959966356),
    ],
)
def test_quantile(spark, df, t):
    assert quantile(spark, df) == pytest.approx(t, abs=2e-6)


@pytest.mark.parametrize("df", [1, 4, 200, 201])
def test_quantile_inverts_the_tail(spark, df):
    for confidence in (0.5, 0.99):
        assert tail(spark, quantile(spark, df, confidence), df) == pytest.approx(1 - confidence, rel=1e-6)


def test_no_quantile_without_degrees_of_freedom(spark):
    assert quantile(spark, 0) is None


def test_perfect_fit_has_no_negative_error(spark):
    rows = [("a", w, 0.1 + 0.7 * math.log(w)) for w in range(1, 40)]
    df = spark.createDataFrame(rows, "g string, w long, y double")
    fit = ols_fixed_effects(df, "y", F.log("w"), "g").collect()[0]
    assert fit["std_error"] == pytest.approx(0, abs=1e-6)
    assert fit["slope"] == pytest.approx(0.7)


@pytest.fixture(scope="module")
def points(spark):
    dice = np.random.default_rng(11)
    n = 900
    group = dice.choice(["a", "b", "c", "d"], n, p=[0.7, 0.1, 0.1, 0.1])
    workers = dice.integers(1, 500, n)
    y = dice.exponential(3, n) - 0.4 * np.log(workers) + (group == "a") * 2
    rows = [(str(g), int(w), float(v)) for g, w, v in zip(group, workers, y)]
    return spark.createDataFrame(rows, "g string, w long, y double").cache(), group, workers, y


def test_slope_equals_dummy_regression(points):
    df, group, workers, y = points
    names = sorted(set(group))
    x = np.column_stack([np.log(workers), *[(group == n).astype(float) for n in names]])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    residual = y - x @ beta
    dof = len(y) - x.shape[1]
    error = math.sqrt(residual @ residual / dof * np.linalg.inv(x.T @ x)[0, 0])
    r2 = 1 - residual @ residual / ((y - y.mean()) @ (y - y.mean()))
    fit = ols_fixed_effects(df, "y", F.log("w"), "g").collect()[0]
    assert (fit["n"], fit["n_groups"]) == (900, 4)
    assert [fit["slope"], fit["std_error"], fit["r_squared"]] == pytest.approx([beta[0], error, r2], rel=1e-9)
    assert fit["ci_high"] - fit["ci_low"] == pytest.approx(2 * 1.96262 * error, rel=1e-4)
    assert fit["change_per_doubling"] == pytest.approx(beta[0] * math.log(2))


def test_slope_equals_spark_ml(points):
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import LinearRegression

    df = points[0].withColumn("x", F.log("w"))
    shaped = RFormula(formula="y ~ x + g", stringIndexerOrderType="alphabetDesc").fit(df).transform(df)
    ml = LinearRegression(solver="normal").fit(shaped)
    fit = ols_fixed_effects(df, "y", F.col("x"), "g").collect()[0]
    assert fit["slope"] == pytest.approx(ml.coefficients[0], rel=1e-8)
    assert fit["std_error"] == pytest.approx(ml.summary.coefficientStandardErrors[0], rel=1e-8)
    assert fit["r_squared"] == pytest.approx(ml.summary.r2, rel=1e-8)


def test_spearman_shares_tied_ranks(spark):
    df = spark.createDataFrame([(1, 2), (2, 2), (2, 1), (4, 5), (5, 4)], "a int, b int")
    a, b = [1, 2.5, 2.5, 4, 5], [2.5, 2.5, 1, 5, 4]
    got = spearman(df, "a", "b").collect()[0]
    assert got["rho"] == pytest.approx(np.corrcoef(a, b)[0, 1]) and got["n"] == 5


def test_spearman_of_equal_rankings(spark):
    df = spark.range(1, 7).select(F.col("id").alias("a"), F.col("id").alias("b"))
    got = spearman(df, "a", "b").collect()[0]
    assert got["rho"] == pytest.approx(1.0) and got["p_value"] == pytest.approx(0.0, abs=1e-12)
