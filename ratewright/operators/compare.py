"""How two rankings differ, and how far a result hangs on the method or on one row.

Apart from ``averaging_counterfactual`` and ``largest_row_sensitivity``, which aggregate
rows, these take tables with one row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ratewright.functions.frames import rank_descending
from ratewright.functions.ratios import RATE_SCALE, percent, scaled
from ratewright.functions.student import with_two_sided_p
from ratewright.roles import Roles


def _positions(ranked: DataFrame, by: str, rank: str, k: int) -> DataFrame:
    """The first ``k`` groups of a ranking, at positions 1..k whether or not ranks tie."""
    return (
        ranked.orderBy(rank, by)
        .limit(k)
        .withColumn("position", F.row_number().over(W.orderBy(rank, by)).cast("bigint"))
    )


def top5_side_by_side(ranked: DataFrame, by: str, k: int = 5) -> DataFrame:
    """Position, name and value under each ranking."""
    rate = _positions(ranked, by, "rank_by_rate", k).select(
        "position", F.col(by).alias("by_rate"), F.round("trir", 3).alias("trir")
    )
    count = _positions(ranked, by, "rank_by_count", k).select(
        "position", F.col(by).alias("by_count"), F.col("total_cases").alias("cases")
    )
    return rate.join(count, "position").orderBy("position")


def topk_set_changes(ranked: DataFrame, by: str, k: int = 5) -> DataFrame:
    """Groups in either top ``k``, marked ``count only``, ``rate only`` or ``both``."""
    rate = _positions(ranked, by, "rank_by_rate", k).select(by, F.lit(True).alias("_rate"))
    count = _positions(ranked, by, "rank_by_count", k).select(by, F.lit(True).alias("_count"))
    status = (
        F.when(F.col("_rate").isNull(), "count only")
        .when(F.col("_count").isNull(), "rate only")
        .otherwise("both")
    )
    listed = rate.join(count, by, "full").select(by, status.alias("status"))
    return listed.join(
        ranked.select(by, "rank_by_rate", "rank_by_count", "trir", "total_cases"), by
    ).orderBy("status", "rank_by_count")


def largest_moves(table: DataFrame, by: str, moved: Column, name: str, k: int) -> DataFrame:
    """The ``k`` groups that move furthest, in either direction."""
    return (
        table.withColumn(name, moved).orderBy(F.abs(name).desc_nulls_last(), by).limit(k)
    )


def rank_moves(ranked: DataFrame, by: str, k: int = 6) -> DataFrame:
    """Places a group falls (positive) when ranked by rate instead of count."""
    moved = F.col("rank_by_rate") - F.col("rank_by_count")
    return largest_moves(ranked, by, moved, "places_moved", k).select(
        by, "rank_by_count", "rank_by_rate", "places_moved", "total_cases", "trir"
    )


def _shared_rank(column: str) -> Column:
    """Rank with ties sharing the mean of the places they take."""
    ahead = F.rank().over(W.orderBy(column))
    tied = F.count(F.lit(1)).over(W.partitionBy(column))
    return ahead + (tied - 1) / 2.0


def spearman(ranked: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rank correlation of two columns over groups, n, and the two-sided p."""
    n, rho = F.col("n"), F.col("rho")
    perfect = F.abs(rho) >= 1.0
    t = F.when(~perfect, rho * F.sqrt((n - 2) / ((1.0 - rho) * (1.0 + rho))))
    correlated = (
        ranked.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        .select(_shared_rank(a).alias("a"), _shared_rank(b).alias("b"))
        .agg(F.corr("a", "b").alias("rho"), F.count(F.lit(1)).alias("n"))
    )
    tested = with_two_sided_p(correlated, F.when(n > 2, t), n - 2, "p")
    return tested.select(
        "rho", F.when(perfect & (n > 2), F.lit(0.0)).otherwise(F.col("p")).alias("p_value"), "n"
    )


def averaging_counterfactual(clean: DataFrame, r: Roles, total_label: str) -> DataFrame:
    """Ratio of sums against the mean of row rates, per group and for the whole table.

    Rows are read once: the whole-table row is added up from the group rows, whose number
    and sum of rates are additive. Its ranks are NULL.
    """
    groups = clean.groupBy(r.group).agg(
        F.count(F.lit(1)).alias("n_establishments"),
        F.sum(r.exposure).alias("total_hours"),
        F.sum("recordable_cases").alias("total_cases"),
        F.sum("trir").alias("rates"),
        F.count("trir").alias("n_rates"),
    )
    whole = groups.agg(
        F.lit(total_label).alias(r.group),
        *[F.sum(c).alias(c) for c in groups.columns if c != r.group],
    )
    right = scaled(F.col("total_cases"), F.col("total_hours"), RATE_SCALE)
    wrong = F.try_divide(F.col("rates"), F.col("n_rates").cast("double"))

    def rated(df: DataFrame) -> DataFrame:
        return df.select(
            r.group,
            "n_establishments",
            "total_hours",
            "total_cases",
            right.alias("trir_sum_then_divide"),
            wrong.alias("trir_average_of_rates"),
            (wrong - right).alias("overstatement"),
        )

    ranks = {
        "rank_sum_then_divide": rank_descending(F.col("trir_sum_then_divide")),
        "rank_average_of_rates": rank_descending(F.col("trir_average_of_rates")),
    }
    nothing = F.lit(None).cast("bigint")
    both = rated(groups).withColumns(ranks).unionByName(
        rated(whole).withColumns({name: nothing for name in ranks})
    )
    moved = F.col("rank_average_of_rates") - F.col("rank_sum_then_divide")
    return both.withColumn("places_moved_under_averaging", moved).orderBy(
        F.col("rank_sum_then_divide").asc_nulls_last(), r.group
    )


def averaging_summary(counterfactual: DataFrame, by: str, total_label: str) -> DataFrame:
    """One row: both whole-table rates, by how much averaging overstates, and how many groups
    change rank."""
    total = F.col(by) == total_label
    only = lambda c: F.max(F.when(total, F.col(c)))
    moved = ~total & (F.col("places_moved_under_averaging") != 0)
    return counterfactual.agg(
        only("trir_sum_then_divide").alias("trir_sum_then_divide"),
        only("trir_average_of_rates").alias("trir_average_of_rates"),
        only("overstatement").alias("overstatement"),
        F.count_if(moved).alias("n_moved"),
        F.count_if(~total).alias("n_groups"),
    ).withColumn(
        "overstatement_pct", percent(F.col("overstatement"), F.col("trir_sum_then_divide"))
    )


def averaging_moves(counterfactual: DataFrame, by: str, total_label: str, k: int = 5) -> DataFrame:
    """The ``k`` groups whose rank changes most under averaging."""
    moved = "places_moved_under_averaging"
    return largest_moves(
        counterfactual.filter(F.col(by) != total_label), by, F.col(moved), moved, k
    ).select(
        by, "n_establishments", "trir_sum_then_divide", "trir_average_of_rates",
        "rank_sum_then_divide", "rank_average_of_rates", moved,
    )


def largest_row_sensitivity(clean: DataFrame, r: Roles) -> DataFrame:
    """Per group: its row of most exposure, that row's share, and the rate without it.

    One aggregate finds the sums and the row; of rows with equal exposure the one with more
    cases, then more workers, counts as the largest.
    """
    row = F.struct(r.exposure, "recordable_cases", r.workers)
    groups = clean.groupBy(r.group).agg(
        F.count(F.lit(1)).alias("n_establishments"),
        F.sum(r.exposure).alias("hours_sum"),
        F.sum("recordable_cases").alias("cases_sum"),
        F.max(row).alias("top"),
    )
    top_hours, top_cases = F.col(f"top.{r.exposure}"), F.col("top.recordable_cases")
    rate = scaled(F.col("cases_sum"), F.col("hours_sum"), RATE_SCALE)
    without = scaled(
        F.col("cases_sum") - top_cases, F.col("hours_sum") - top_hours, RATE_SCALE
    )
    share = percent(top_hours, F.col("hours_sum"), 2)
    return groups.select(
        r.group,
        "n_establishments",
        F.col(f"top.{r.workers}").alias("largest_row_employees"),
        top_hours.alias("largest_row_hours"),
        top_cases.alias("largest_row_cases"),
        share.alias("largest_row_pct_of_sector_hours"),
        rate.alias("trir"),
        without.alias("trir_excluding_largest_row"),
        (without - rate).alias("change_if_excluded"),
    ).orderBy(F.col("largest_row_pct_of_sector_hours").desc_nulls_last(), r.group)


def concentration_count(sensitivity: DataFrame, percent_of_hours: float = 1.0) -> DataFrame:
    """One row: groups whose largest row holds at least this share, of how many groups."""
    return sensitivity.agg(
        F.count_if(F.col("largest_row_pct_of_sector_hours") >= percent_of_hours).alias("n_over"),
        F.count(F.lit(1)).alias("n_groups"),
    )


def deaths_rank_moves(rates: DataFrame, by: str, min_deaths: int = 10, k: int = 6) -> DataFrame:
    """Among groups with enough deaths, places a group ranks worse on deaths than on cases."""
    moved = F.col("rank_by_trir") - F.col("rank_by_death_rate")
    return largest_moves(
        rates.filter(F.col("deaths") >= min_deaths), by, moved, "places_moved", k
    ).select(
        by, "deaths", "rank_by_trir", "rank_by_death_rate", "places_moved", "trir",
        "deaths_per_100m_hours",
    )
