"""The count model against dense algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewright.operators.count_model import count_model

COLUMNS = "g string, x double, h double, y long"


def dense(rows, theta=None):
    """Maximum likelihood with a dummy a group, by Newton's method on all unknowns at once; with
    the negative binomial, the size's score is set to zero by bisection around it."""
    names = sorted({r[0] for r in rows})
    x = np.array([[*(float(r[0] == n) for n in names), r[1]] for r in rows])
    h, y = np.array([r[2] for r in rows]), np.array([float(r[3]) for r in rows])
    beta = np.zeros(x.shape[1])
    beta[:-1] = np.log(y.sum() / h.sum())
    for _ in range(200):
        mu = h * np.exp(x @ beta)
        spread = 1.0 if theta is None else 1 + mu / theta
        info = (x * (mu / spread)[:, None]).T @ x
        step = np.linalg.solve(info, x.T @ ((y - mu) / spread))
        beta += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-13:
            break
    return beta[-1], np.sqrt(np.linalg.inv(info)[-1, -1]), mu, y


def size_score(theta, rows):
    *_, mu, y = dense(rows, theta)
    rising = np.array([sum(1 / (theta + j) for j in range(int(n))) for n in y])
    return float(np.sum(rising + np.log(theta / (theta + mu)) + 1 - (y + theta) / (mu + theta)))


@pytest.fixture(scope="module")
def crowded():
    rng = np.random.default_rng(11)
    rows = []
    for g, base in (("a", -3.0), ("b", -2.0), ("c", -4.0)):
        x, h = rng.normal(3, 1.2, 150), rng.uniform(5, 60, 150)
        mu = h * np.exp(base + 0.4 * x)
        rows += [(g, *map(float, t[:2]), int(t[2])) for t in zip(x, h, rng.negative_binomial(2.0, 2.0 / (2.0 + mu)))]
    return rows


def fitted(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    return {r["model"]: r for r in count_model(df, "y", F.col("x"), "h", "g").collect()}


def test_equals_dense_algebra(spark, crowded):
    unused = [("d", 1.0, 5.0, 0), ("d", 2.0, 5.0, 0), ("a", None, 5.0, 1), ("a", 1.0, 0.0, 1), (None, 1.0, 1.0, 1),
              ("a", 1.0, 5.0, None), ("a", float("-inf"), 5.0, 2), ("a", float("nan"), 5.0, 2)]
    found = fitted(spark, crowded + unused)
    slope, error, mu, y = dense(crowded)
    r = found["poisson"]
    assert (r["n"], r["n_groups"], r["dispersion"]) == (450, 3, 0.0)
    assert r["slope"] == pytest.approx(slope, abs=1e-9) and r["std_error"] == pytest.approx(error, rel=1e-8)
    assert r["pearson_per_df"] == pytest.approx(((y - mu) ** 2 / mu).sum() / (450 - 4), rel=1e-8)

    low, high = 0.1, 50.0
    for _ in range(60):
        middle = (low * high) ** 0.5
        low, high = (middle, high) if size_score(middle, crowded) > 0 else (low, middle)
    slope, error, mu, y = dense(crowded, low)
    r = found["negative binomial"]
    assert r["dispersion"] == pytest.approx(1 / low, rel=1e-7) and r["largest_score"] <= 1e-8
    assert r["slope"] == pytest.approx(slope, abs=1e-8) and r["std_error"] == pytest.approx(error, rel=1e-7)
    assert r["rate_ratio_per_doubling"] == pytest.approx(2**slope, rel=1e-8)
    assert r["ci_high"] - r["ci_low"] == pytest.approx(2 * 1.959963984540054 * error, rel=1e-7)


def test_even_counts_have_no_dispersion(spark):
    found = fitted(spark, [("a", float(i % 5), 10.0, 10 + i % 2) for i in range(60)])
    assert found["negative binomial"]["dispersion"] == 0.0
    assert found["negative binomial"]["slope"] == found["poisson"]["slope"]


@pytest.mark.parametrize("rows", [[], [("a", 1.0, 2.0, 0)], [("a", 3.0, 2.0, 5), ("b", 4.0, 2.0, 7)]])
def test_nothing_to_fit(spark, rows):
    found = fitted(spark, rows)
    assert found["poisson"]["slope"] is None and found["negative binomial"]["slope"] is None
