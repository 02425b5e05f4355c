"""Student's t in column expressions, for test statistics on one-row results.

Intermediate values are columns of their own, so that none is written out twice in the plan.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SERIES_LIMIT = 200  # degrees of freedom up to which the finite series is used
_TERMS = 80
_HALVINGS = 60  # of the angle between 0 and a right one: below the last digit of a double


def _series(start: Column, count: Column, factor) -> Column:
    """start + start*f(1) + start*f(1)*f(2) + ... over ``count`` further terms."""
    none = F.array().cast("array<int>")
    steps = F.when(count >= 1, F.sequence(F.lit(1), count.cast("int"))).otherwise(none)

    def extend(acc, j):
        term = acc["term"] * factor(j.cast("double"))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    first = F.struct(start.alias("term"), start.alias("total"))
    return F.aggregate(steps, first, extend, lambda acc: acc["total"])


def _finite_series(cosine: Column, even: Column, dof: Column) -> Column:
    """The sum in P(|T| <= t) for whole degrees of freedom, with cos(atan(t / sqrt(dof)))."""

    def ratio(j: Column) -> Column:
        odd_step = 2.0 * j / (2.0 * j + 1.0)
        return F.when(even, (2.0 * j - 1.0) / (2.0 * j)).otherwise(odd_step) * cosine * cosine

    start = F.when(even, F.lit(1.0)).otherwise(cosine)
    return _series(start, F.floor(F.when(even, dof - 2).otherwise(dof - 3) / 2), ratio)


def _within(angle: Column, sine: Column, total: Column, even: Column, dof: Column) -> Column:
    """P(|T| <= t) from the sum of the finite series."""
    return F.when(even, sine * total).otherwise(
        (2.0 / math.pi) * (angle + F.when(dof == 1, F.lit(0.0)).otherwise(sine * total))
    )


def with_two_sided_p(table: DataFrame, t: Column, df: Column, name: str) -> DataFrame:
    """Add P(|T| >= |t|) for whole degrees of freedom; NULL where t is NULL or df is below 1.

    The finite series up to 200 degrees of freedom, beyond them Hill's transformation to
    a normal deviate (Algorithm 395, CACM 1970).
    """
    size, dof, y, z = F.col("_t"), F.col("_df"), F.col("_y"), F.col("_z")
    cosine, even = F.col("_cos"), F.col("_even")

    tail = F.lit(1.0) - _within(F.col("_angle"), F.col("_sin"), F.col("_sum"), even, dof)
    a = dof - 0.5
    scale = 48.0 * a * a
    correction = (((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100.0 + scale)
    deviate = ((correction + y + 3.0) / scale + 1.0) * F.sqrt(y)

    near = F.lit(1.0) - 2.0 * F.col("_density") * _series(
        z, F.lit(_TERMS), lambda k: z * z / (2.0 * k + 1.0)
    )
    fraction = F.aggregate(
        F.sequence(F.lit(_TERMS), F.lit(1)), z, lambda v, k: z + k.cast("double") / v
    )
    normal = F.when(z < 3.0, near).otherwise(2.0 * F.col("_density") / fraction)
    exact = dof <= _SERIES_LIMIT
    return (
        table.withColumns({"_t": F.abs(t).cast("double"), "_df": F.when(df >= 1, df.cast("double"))})
        .withColumns({"_angle": F.atan(size / F.sqrt(dof)), "_y": a * F.log1p(size * size / dof)})
        .withColumns(
            {
                "_sin": F.sin("_angle"),
                "_cos": F.cos("_angle"),
                "_even": F.pmod(dof, F.lit(2.0)) == 0,
                "_z": deviate,
            }
        )
        .withColumns(
            {
                "_sum": F.when(exact, _finite_series(cosine, even, dof)),
                "_density": F.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi),
            }
        )
        .withColumn(
            name,
            F.when(dof.isNotNull() & size.isNotNull(), F.when(exact, F.greatest(F.lit(0.0), tail)).otherwise(normal)),
        )
        .select(*table.columns, name)
    )


def central_quantile(confidence: float, df: Column) -> Column:
    """t with P(|T| <= t) = confidence, for whole degrees of freedom; NULL below 1.

    Up to 200 degrees of freedom the finite series is inverted by halving the range of
    atan(t / sqrt(df)); beyond them the expansion in 1/df is right to nine digits.
    """
    n = F.when(df >= 1, df.cast("double"))
    even = F.pmod(n, F.lit(2.0)) == 0

    def halve(ends: Column, _) -> Column:
        angle = (ends["low"] + ends["high"]) / 2.0
        below = _within(angle, F.sin(angle), _finite_series(F.cos(angle), even, n), even, n) < confidence
        return F.struct(
            F.when(below, angle).otherwise(ends["low"]).alias("low"),
            F.when(below, ends["high"]).otherwise(angle).alias("high"),
        )

    widest = F.struct(F.lit(0.0).alias("low"), F.lit(math.pi / 2).alias("high"))
    angle = F.aggregate(F.sequence(F.lit(1), F.lit(_HALVINGS)), widest, halve, lambda ends: ends["low"])

    z = NormalDist().inv_cdf(0.5 + confidence / 2.0)
    first = (z**3 + z) / 4.0
    second = (5 * z**5 + 16 * z**3 + 3 * z) / 96.0
    third = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384.0
    expansion = F.lit(z) + first / n + second / (n * n) + third / (n * n * n)
    return F.when(n <= _SERIES_LIMIT, F.tan(angle) * F.sqrt(n)).otherwise(expansion)
