"""Counts with an exposure: Poisson and negative-binomial regression with a constant per group.

log E(y) = log(exposure) + constant of the group + slope * x. The data are read as sums: a
Newton step takes one aggregate, and the driver sees one row of it. Constants of groups are never
gathered; they stay a table with a row a group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.session import Steps

#: A score counts as zero below this share of the sum of its absolute terms.
TOLERANCE = 1e-10
STEPS = 100

#: The least variation of x within groups, as a share of its mean square, that allows a slope.
LEAST_VARIATION = 1e-12

SCHEMA = (
    "model string, n long, n_groups long, slope double, std_error double, ci_low double, ci_high double,"
    " rate_ratio_per_doubling double, dispersion double, pearson_per_df double, largest_score double"
)


def usable(df: DataFrame, y: str, x: Column, exposure: str, group: str) -> DataFrame:
    """Rows ``y, x, h, g`` a model can use: nothing NULL, x finite, exposure above 0, y at least 0."""
    rows = df.select(
        F.col(y).cast("double").alias("y"),
        x.cast("double").alias("x"),
        F.col(exposure).cast("double").alias("h"),
        F.col(group).alias("g"),
    ).dropna()
    return rows.filter((F.col("h") > 0) & (F.col("y") >= 0) & (F.abs("x") < F.lit(math.inf)))


def _poisson_sums(rows: DataFrame, slope: float) -> DataFrame:
    """Per group with cases: rows, cases, and weighted sums of x with weights h * exp(slope * x)."""
    weight = F.col("h") * F.exp(F.col("x") * slope)
    return (
        rows.groupBy("g")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("y").alias("cases"),
            F.sum(F.col("x") * F.col("y")).alias("xy"),
            F.sum(F.abs(F.col("x") * F.col("y"))).alias("size"),
            F.sum(weight).alias("s0"),
            F.sum(weight * F.col("x")).alias("s1"),
            F.sum(weight * F.col("x") * F.col("x")).alias("s2"),
        )
        .filter("cases > 0")
    )


@dataclass
class Fit:
    """Where the steps have come to."""

    slope: float
    information: float  # of the slope, the groups' constants taken out
    score: float  # the largest score as a share of its terms
    groups: DataFrame  # g, constant
    n: int
    n_groups: int


def fit_poisson(rows: DataFrame, steps: Steps) -> Fit | None:
    """Newton's steps for the slope. A group's constant has a closed form, log(cases / s0), so it
    is put in place and the slope is the only unknown. A group without cases says nothing about the slope and
    is left out. None if no group has both cases and different x."""
    slope = 0.0
    mean = F.col("s1") / F.col("s0")
    for _ in range(STEPS):
        sums = steps.land(_poisson_sums(rows, slope))
        r = sums.agg(
            F.sum(F.col("xy") - F.col("cases") * mean).alias("score"),
            F.sum(F.col("cases") * (F.col("s2") / F.col("s0") - mean * mean)).alias("information"),
            F.sum(F.col("cases") * F.col("s2") / F.col("s0")).alias("square"),
            F.sum("size").alias("size"),
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("groups"),
        ).first()
        if r["information"] is None or r["information"] <= LEAST_VARIATION * r["square"]:
            return None
        score = abs(r["score"]) / max(r["size"], 1.0)
        if score <= TOLERANCE:
            break
        slope += max(-1.0, min(1.0, r["score"] / r["information"]))
    groups = sums.select("g", F.log(F.col("cases") / F.col("s0")).alias("constant"))
    return Fit(slope, r["information"], score, groups, r["n"], r["groups"])


def _shifted(z: Column) -> Column:
    return z + 10.0


def _digamma(z: Column) -> Column:
    """For z > 0: the recurrence up by ten, then the asymptotic series, right to 12 digits."""
    t = _shifted(z)
    r = 1.0 / (t * t)
    series = F.log(t) - 0.5 / t - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    for k in range(10):
        series = series - 1.0 / (z + float(k))
    return series


def _trigamma(z: Column) -> Column:
    t = _shifted(z)
    r = 1.0 / (t * t)
    series = 1.0 / t + r / 2.0 + r / t * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))
    for k in range(10):
        series = series + 1.0 / ((z + float(k)) * (z + float(k)))
    return series


def _expected(rows: DataFrame, groups: DataFrame, slope: float) -> DataFrame:
    """Rows of the groups, with ``mu``. The table of groups joins by the optimizer's choice."""
    mu = F.col("h") * F.exp(F.col("constant") + F.col("x") * slope)
    return rows.join(groups, "g").withColumn("mu", mu)


def _excess(rows: DataFrame, fit: Fit) -> tuple[float, float]:
    """Pearson's statistic per degree of freedom, and the start for the size of the negative
    binomial; infinite if the counts vary no more than Poisson's."""
    off = (F.col("y") - F.col("mu")) * (F.col("y") - F.col("mu"))
    r = (
        _expected(rows, fit.groups, fit.slope)
        .agg(
            F.sum(off / F.col("mu")).alias("pearson"),
            F.sum(F.col("mu") * F.col("mu")).alias("square"),
            F.sum(off - F.col("y")).alias("excess"),
        )
        .first()
    )
    return r["pearson"], r["square"] / r["excess"] if r["excess"] > 0 else math.inf


def fit_negative_binomial(rows: DataFrame, start: Fit, size: float, steps: Steps) -> tuple[Fit, float, float]:
    """Maximum likelihood of slope, constants and size (variance mu + mu^2 / size).

    A step is one aggregate by group: scores and information of the constants and the slope, whose
    matrix is an arrow, so the slope's step needs sums over groups only; and the size's score with
    its derivative, stepped on the log scale. Steps use the expected information until the scores
    are small, then the observed one, which converges faster. The error is from the expected one.
    Returns the fit, the size and Pearson's statistic.
    """
    fit, near = start, False
    y, mu, x = F.col("y"), F.col("mu"), F.col("x")
    for _ in range(STEPS):
        th = F.lit(size)
        spread = 1.0 + mu / th
        off, weight = (y - mu) / spread, mu / spread
        seen = weight * (1.0 + y / th) / spread if near else weight
        size_score = _digamma(y + th) - _digamma(th) + F.log(th) + 1.0 - F.log(th + mu) - (y + th) / (mu + th)
        slack = (y + th) / ((mu + th) * (mu + th)) - 2.0 / (mu + th)
        size_curve = _trigamma(y + th) - _trigamma(th) + 1.0 / th + slack
        sums = (
            _expected(rows, fit.groups, fit.slope)
            .groupBy("g", "constant")
            .agg(
                F.sum(off).alias("u"),
                F.sum(seen).alias("i"),
                F.sum(seen * x).alias("ix"),
                F.sum(off * x).alias("ux"),
                F.sum(seen * x * x).alias("ixx"),
                F.sum(weight).alias("e"),
                F.sum(weight * x).alias("ex"),
                F.sum(weight * x * x).alias("exx"),
                F.sum(F.abs(off)).alias("terms"),
                F.sum(F.abs(off * x)).alias("terms_x"),
                F.sum(size_score).alias("us"),
                F.sum(F.abs(size_score)).alias("terms_s"),
                F.sum(size_curve).alias("cs"),
                F.sum((y - mu) * (y - mu) / (mu * spread)).alias("pearson"),
            )
        )
        sums = steps.land(sums)
        r = sums.agg(
            F.sum(F.col("ux") - F.col("ix") * F.col("u") / F.col("i")).alias("score"),
            F.sum(F.col("ixx") - F.col("ix") * F.col("ix") / F.col("i")).alias("observed"),
            F.sum(F.col("exx") - F.col("ex") * F.col("ex") / F.col("e")).alias("information"),
            F.max(F.abs("u") / F.greatest("terms", F.lit(1.0))).alias("off_group"),
            F.abs(F.sum("ux")).alias("off_slope"),
            F.sum("terms_x").alias("terms_x"),
            F.sum("us").alias("us"),
            F.sum("terms_s").alias("terms_s"),
            F.sum("cs").alias("cs"),
            F.sum("pearson").alias("pearson"),
        ).first()
        score = max(
            r["off_group"], r["off_slope"] / max(r["terms_x"], 1.0), abs(r["us"]) / max(r["terms_s"], 1.0)
        )
        near = score < 1e-2
        step = r["score"] / r["observed"]
        fit = Fit(fit.slope, r["information"], score, fit.groups, fit.n, fit.n_groups)
        if score <= TOLERANCE:
            break
        onward = (F.col("constant") + (F.col("u") - F.col("ix") * step) / F.col("i")).alias("constant")
        fit.groups, fit.slope = sums.select("g", onward), fit.slope + step
        first, second = size * r["us"], size * r["us"] + size * size * r["cs"]
        change = -first / second if second < 0 else math.copysign(0.5, first)
        size *= math.exp(max(-1.0, min(1.0, change)))
    return fit, size, r["pearson"]


def count_model(
    df: DataFrame, y: str, x: Column, exposure: str, group: str, confidence: float = 0.95
) -> DataFrame:
    """One row a model, ``poisson`` and ``negative binomial``: the slope on x with its error and
    interval, the factor on the rate when x grows by ln 2, the dispersion (variance = mu +
    dispersion * mu^2), Pearson's statistic per degree of freedom, and the largest score left as a
    share of its terms.

    The fits run when the query is built. Rows with a NULL, an exposure not above 0 or an x that
    is not finite, and groups without cases are left out. Where counts vary no more than
    Poisson's, the second row repeats the first with dispersion 0. Without a group that has cases
    and different x, the figures are NULL.
    """
    spark = df.sparkSession
    rows = usable(df, y, x, exposure, group)
    z = NormalDist().inv_cdf(0.5 + confidence / 2.0)

    def row(model: str, fit: Fit, dispersion: float, pearson: float) -> tuple:
        error = 1.0 / math.sqrt(fit.information)
        free = fit.n - fit.n_groups - 1
        return (
            model, fit.n, fit.n_groups, fit.slope, error, fit.slope - z * error, fit.slope + z * error,
            2.0**fit.slope, dispersion, pearson / free if free > 0 else None, fit.score,
        )

    steps = Steps(spark, "count-model")
    poisson = fit_poisson(rows, steps)
    if poisson is None:
        return spark.createDataFrame([(m, *[None] * 10) for m in ("poisson", "negative binomial")], SCHEMA)
    pearson, size = _excess(rows, poisson)
    out = [row("poisson", poisson, 0.0, pearson)]
    if math.isinf(size):
        out.append(row("negative binomial", poisson, 0.0, pearson))
    else:
        fit, size, left = fit_negative_binomial(rows, poisson, size, steps)
        out.append(row("negative binomial", fit, 1.0 / size, left))
    steps.close()
    return spark.createDataFrame(out, SCHEMA)
