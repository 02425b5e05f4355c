"""Does composition explain a rate? Splits, mixes, and indirect standardisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ratewright.functions.ratios import RATE_SCALE, percent, scaled
from ratewright.functions.values import legend
from ratewright.operators.rates import EXPOSURE_COLUMNS, rate, sums
from ratewright.roles import Limits, Roles


def with_ownership(clean: DataFrame, r: Roles, lim: Limits) -> DataFrame:
    return clean.withColumn(
        "ownership", legend(F.col(r.owner), lim.owner_labels, lim.owner_unknown)
    )


def ownership_split(clean: DataFrame, r: Roles, lim: Limits) -> DataFrame:
    """Sums, rate and share of exposure per ownership, for all rows and for one group alone.

    The scopes overlap. Rows are summed once per (ownership, in the group or not); only
    those few sums are counted into both scopes.
    """
    additive = [*EXPOSURE_COLUMNS]
    parts = (
        with_ownership(clean, r, lim)
        .groupBy("ownership", F.col(r.group).eqNullSafe(lim.scope_group).alias("in_group"))
        .agg(*sums(r))
    )
    scopes = F.when(
        F.col("in_group"), F.array(F.lit(lim.scope_all_label), F.lit(lim.scope_group))
    ).otherwise(F.array(F.lit(lim.scope_all_label)))
    split = (
        parts.withColumn("scope", F.explode(scopes))
        .groupBy("scope", "ownership")
        .agg(*[F.sum(c).alias(c) for c in additive])
    )
    scope_hours = F.sum("total_hours").over(W.partitionBy("scope"))
    return split.select(
        "scope",
        "ownership",
        *additive,
        rate().alias("trir"),
        percent(F.col("total_hours"), scope_hours, 2).alias("pct_of_scope_hours"),
    ).orderBy("scope", "ownership")


def subset_share_and_rate(
    split: DataFrame, scope: str, subset: Sequence[str], rest: str, overall: DataFrame
) -> DataFrame:
    """One row: the subset's share of exposure, added up from the published shares, and the
    rate of the rest beside the overall rate."""
    in_subset, is_rest = F.col("ownership").isin(list(subset)), F.col("ownership") == rest
    measured = split.filter(F.col("scope") == scope).agg(
        F.round(F.sum(F.when(in_subset, F.col("pct_of_scope_hours"))), 2).alias("subset_pct_of_hours"),
        F.max(F.when(is_rest, F.col("n_establishments"))).alias("rest_n"),
        F.max(F.when(is_rest, F.col("total_hours"))).alias("rest_hours"),
        F.max(F.when(is_rest, F.col("trir"))).alias("rest_trir"),
    )
    return measured.crossJoin(F.broadcast(overall.select(F.col("trir").alias("overall_trir"))))


def external_benchmark(overall: DataFrame, published: float) -> DataFrame:
    """One row: the overall rate against a published one."""
    ours, given = F.col("trir"), F.lit(float(published))
    return overall.select(
        "trir",
        given.alias("published_rate"),
        (ours / given).alias("ratio"),
        (ours - given).alias("difference"),
    )


def mix_table(
    clean: DataFrame, by: str, r: Roles, target: str, target_as: str = "me", whole_as: str = "nat"
) -> DataFrame:
    """Per group: the target region's exposure and share, the whole's share, the difference in
    points (rounded once), and both rates. Groups the target lacks stay, with no rate.

    Target and whole come from one aggregate, by conditional sums.
    """
    here = F.col(r.region) == target
    groups = clean.groupBy(by).agg(
        F.count_if(here).alias("n"),
        F.sum(F.when(here, F.col(r.exposure))).alias("hours_or_none"),
        F.sum(F.when(here, F.col("recordable_cases"))).alias("cases"),
        F.sum(r.exposure).alias("whole_hours"),
        F.sum("recordable_cases").alias("whole_cases"),
    ).withColumn("hours", F.coalesce("hours_or_none", F.lit(0)))
    every = W.partitionBy()  # one row per group
    share = percent(F.col("hours"), F.sum("hours").over(every))
    whole_share = percent(F.col("whole_hours"), F.sum("whole_hours").over(every))
    return groups.select(
        by,
        F.col("n").alias(f"{target_as}_n_establishments"),
        F.col("hours").alias(f"{target_as}_hours"),
        F.round(share, 2).alias(f"{target_as}_pct_of_hours"),
        F.round(whole_share, 2).alias(f"{whole_as}_pct_of_hours"),
        F.round(share - whole_share, 2).alias("pct_point_diff"),
        scaled(F.col("cases"), F.col("hours_or_none"), RATE_SCALE).alias(f"{target_as}_trir"),
        scaled(F.col("whole_cases"), F.col("whole_hours"), RATE_SCALE).alias(f"{whole_as}_trir"),
    ).orderBy(F.col(f"{target_as}_pct_of_hours").desc_nulls_last(), by)


def target_and_whole_rate(clean: DataFrame, r: Roles, target: str) -> DataFrame:
    """One row, from one pass: the target region's rate and the rate of all rows."""
    here = F.col(r.region) == target
    cases, exposure = F.col("recordable_cases"), F.col(r.exposure)
    return clean.agg(
        scaled(F.sum(F.when(here, cases)), F.sum(F.when(here, exposure)), RATE_SCALE).alias(
            "actual_trir"
        ),
        scaled(F.sum(cases), F.sum(exposure), RATE_SCALE).alias("whole_trir"),
    )


def indirect_standardisation(
    mix: DataFrame, rates: DataFrame, target_as: str = "me", whole_as: str = "nat"
) -> DataFrame:
    """One row: the rate the target would have if each of its groups ran at the whole's rate,
    and how much of its gap to the whole that explains. ``rates`` as from
    ``target_and_whole_rate``.
    """
    hours, group_rate = F.col(f"{target_as}_hours"), F.col(f"{whole_as}_trir")
    expected = (
        mix.filter(group_rate.isNotNull())
        .agg(F.sum(hours * group_rate).alias("weighted"), F.sum(hours).alias("hours"))
        .select(F.try_divide(F.col("weighted"), F.col("hours").cast("double")).alias("expected_trir"))
    )
    gap = F.col("actual_trir") - F.col("whole_trir")
    return expected.crossJoin(F.broadcast(rates)).select(
        "actual_trir",
        "whole_trir",
        "expected_trir",
        gap.alias("gap"),
        percent(F.col("expected_trir") - F.col("whole_trir"), gap).alias("pct_of_gap_explained"),
    )


def target_top3_ratio(
    mix: DataFrame, by: str, k: int = 3, target_as: str = "me", whole_as: str = "nat"
) -> DataFrame:
    """The target's ``k`` largest groups by exposure, its rate there over the whole's."""
    target, whole = F.col(f"{target_as}_trir"), F.col(f"{whole_as}_trir")
    return (
        mix.orderBy(F.col(f"{target_as}_hours").desc(), by)
        .limit(k)
        .select(
            by,
            f"{target_as}_pct_of_hours",
            f"{whole_as}_pct_of_hours",
            "pct_point_diff",
            target.alias(f"{target_as}_trir"),
            whole.alias(f"{whole_as}_trir"),
            F.round(F.try_divide(target, whole), 2).alias("ratio"),
        )
    )
