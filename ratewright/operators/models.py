"""Least squares with one slope and a constant per group, and the table of model figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.functions.frames import rows_from
from ratewright.functions.ratios import percent
from ratewright.functions.student import central_quantile, with_two_sided_p


def regression_input(clean: DataFrame, columns: list[str]) -> DataFrame:
    return clean.select(*columns)


def ols_fixed_effects(
    df: DataFrame, y: str, x: Column, group: str, confidence: float = 0.95
) -> DataFrame:
    """One row: the slope of ``y ~ x + C(group)`` with its error, interval and p, and R².

    A constant per group is the same as taking deviations from group means, so sums of
    squares and products within groups are all the fit needs: no dummy columns, one pass,
    and a partial aggregate per task however large a group is. R² is about the mean of
    all rows. Rows with a NULL in y, x or the group are left out.
    """
    rows = df.select(F.col(y).cast("double").alias("y"), x.cast("double").alias("x"), F.col(group).alias("g"))
    within = (
        rows.dropna()
        .groupBy("g")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("y").alias("mean_y"),
            F.regr_sxx("y", "x").alias("sxx"),
            F.regr_sxy("y", "x").alias("sxy"),
            F.regr_syy("y", "x").alias("syy"),
        )
    )
    n = F.sum("n")
    between = F.sum(F.col("n") * F.col("mean_y") * F.col("mean_y")) - F.sum(
        F.col("n") * F.col("mean_y")
    ) * F.sum(F.col("n") * F.col("mean_y")) / n
    fit = within.agg(
        n.alias("n"),
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("sxx").alias("sxx"),
        F.sum("sxy").alias("sxy"),
        F.sum("syy").alias("syy"),
        between.alias("between"),
    )
    # a perfect fit may come out a last digit below 0
    sse = F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"))
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    measured = fit.select(
        "n",
        "n_groups",
        (F.col("n") - F.col("n_groups") - 1).alias("df"),
        slope.alias("slope"),
        F.when(F.col("sxx") > 0, sse).alias("sse"),
        "sxx",
        (F.col("syy") + F.col("between")).alias("total"),
    ).withColumn(
        "std_error",
        F.when(F.col("df") > 0, F.sqrt(F.col("sse") / F.col("df") / F.col("sxx"))),
    )
    t = F.when(F.col("std_error") > 0, F.col("slope") / F.col("std_error"))
    half = F.col("half_width")
    return with_two_sided_p(
        measured.withColumn("half_width", central_quantile(confidence, F.col("df")) * F.col("std_error")),
        t,
        F.col("df"),
        "p_value",
    ).select(
        "n",
        "n_groups",
        "slope",
        "std_error",
        (F.col("slope") - half).alias("ci_low"),
        (F.col("slope") + half).alias("ci_high"),
        "p_value",
        (1.0 - F.try_divide(F.col("sse"), F.col("total"))).alias("r_squared"),
        (F.col("slope") * math.log(2.0)).alias("change_per_doubling"),
    )


def doubling_share(fit: DataFrame, overall: DataFrame) -> DataFrame:
    """The change per doubling as a share of the overall rate."""
    return fit.crossJoin(F.broadcast(overall.select("trir"))).select(
        "change_per_doubling",
        F.col("trir").alias("overall_trir"),
        percent(F.col("change_per_doubling"), F.col("trir")).alias("pct_of_overall"),
    )


def model_stats(rank_agreement: DataFrame, fit: DataFrame, gradient: DataFrame) -> DataFrame:
    """Long table of the model figures: statistic, value, detail. Inputs are one-row frames
    from ``spearman``, ``ols_fixed_effects`` and ``gradient_summary``."""
    row = (
        rank_agreement.select("rho", F.col("p_value").alias("rho_p"), F.col("n").alias("rho_n"))
        .crossJoin(F.broadcast(fit))
        .crossJoin(F.broadcast(gradient))
    )
    of_groups = F.format_string("of %d sectors", F.col("n_groups_shown"))
    # Statistic names and the wording of their details.
    figures = [
        (
            "spearman_rho_rate_vs_count_rankings",
            F.col("rho"),
            F.format_string("p=%.6g; n=%d sectors", "rho_p", "rho_n"),
        ),
        (
            "ols_log_employees_coefficient",
            F.col("slope"),
            F.format_string("95%% CI [%.4f, %.4f]; p=%.3g", "ci_low", "ci_high", "p_value"),
        ),
        ("ols_log_employees_ci_low", F.col("ci_low"), F.lit("95% lower bound")),
        ("ols_log_employees_ci_high", F.col("ci_high"), F.lit("95% upper bound")),
        (
            "ols_trir_change_per_doubling",
            F.col("change_per_doubling"),
            F.lit("coefficient x ln(2), TRIR points per doubling of employees"),
        ),
        ("ols_r_squared", F.col("r_squared"), F.lit("share of variance explained")),
        ("ols_n", F.col("n"), F.lit("clean establishments")),
        ("sectors_u20_above_250plus", F.col("n_falls"), of_groups),
        ("sectors_monotonic_across_4_bands", F.col("n_monotonic"), of_groups),
    ]
    shown = row.select("*", gradient["n_groups"].alias("n_groups_shown"))
    return rows_from(
        shown,
        [
            {"statistic": F.lit(name), "value": value.cast("double"), "detail": detail}
            for name, value, detail in figures
        ],
    )
