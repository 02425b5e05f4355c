"""Rates as ratios of sums: cases summed, exposure summed, divided once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.functions.frames import rank_descending, small_sample_note
from ratewright.functions.ratios import DEATH_SCALE, RATE_SCALE, percent, scaled, sum_cases
from ratewright.roles import Limits, Roles


def rate() -> Column:
    """The rate from columns that are sums already."""
    return scaled(F.col("total_cases"), F.col("total_hours"), RATE_SCALE)


def severe_rate() -> Column:
    return scaled(F.col("severe_cases"), F.col("total_hours"), RATE_SCALE)


def sums(r: Roles) -> list[Column]:
    """The additive measures every rate is made from."""
    return [
        F.count(F.lit(1)).alias("n_establishments"),
        F.sum(r.workers).alias("employees"),
        F.sum(r.exposure).alias("total_hours"),
        F.sum("recordable_cases").alias("total_cases"),
        F.sum(r.deaths).alias("deaths"),
        F.sum(sum_cases(*r.severe_cases)).alias("severe_cases"),
    ]


EXPOSURE_COLUMNS = ["n_establishments", "employees", "total_hours", "total_cases", "deaths"]


def overall_rates(clean: DataFrame, r: Roles) -> DataFrame:
    """One row for the whole table, with the rows that report no case."""
    without = F.count_if(F.col("recordable_cases") == 0).alias("n_zero_case_establishments")
    return clean.agg(*sums(r), without).select(
        *EXPOSURE_COLUMNS,
        rate().alias("trir"),
        severe_rate().alias("dart"),
        "n_zero_case_establishments",
        percent(F.col("n_zero_case_establishments"), F.col("n_establishments"), 2).alias(
            "pct_zero_case"
        ),
    )


def rate_by_group(
    clean: DataFrame,
    by: Sequence[str],
    r: Roles,
    min_n: int = 30,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Sums and both rates per group. Groups under ``min_n`` rows are marked, never dropped."""
    passed = [c for c in clean.groupBy(*by).agg(*extra).columns if c not in by] if extra else []
    return (
        clean.groupBy(*by)
        .agg(*sums(r), *extra)
        .select(
            *by,
            *EXPOSURE_COLUMNS,
            rate().alias("trir"),
            severe_rate().alias("dart"),
            *passed,
            small_sample_note(F.col("n_establishments"), min_n).alias("note"),
        )
    )


def sector_two_rankings(clean: DataFrame, r: Roles, min_n: int = 30) -> DataFrame:
    """Groups ranked by rate and by count of cases; both ranks come from one table of groups."""
    return rate_by_group(clean, [r.group], r, min_n).select(
        r.group,
        *EXPOSURE_COLUMNS,
        "trir",
        "dart",
        rank_descending(F.col("trir")).alias("rank_by_rate"),
        rank_descending(F.col("total_cases")).alias("rank_by_count"),
        "note",
    )


def size_band_rates(clean: DataFrame, r: Roles, lim: Limits, min_n: int = 30) -> DataFrame:
    """Rates per derived band, with the rows on the legacy code and how often the other rows'
    reported code agrees with the band."""
    code, order = F.col(r.size_code), F.col("size_order")
    band_code = F.element_at(F.array(*[F.lit(b.code) for b in lim.bands]), order.cast("int"))
    coded = code != lim.legacy_code
    per_band = rate_by_group(
        clean,
        ["size_band", "size_order"],
        r,
        min_n,
        extra=[
            F.count_if(code == lim.legacy_code).alias("n_legacy_size_code"),
            F.count_if(coded & (code == band_code)).alias("n_agree"),
            F.count_if(coded).alias("n_coded"),
        ],
    )
    return per_band.select(
        "size_band",
        "size_order",
        *EXPOSURE_COLUMNS,
        "trir",
        "dart",
        "n_legacy_size_code",
        percent(F.col("n_agree"), F.col("n_coded"), 2).alias("pct_agree_with_osha_size"),
        "note",
    ).orderBy("size_order")


def state_rates(clean: DataFrame, r: Roles, min_n: int = 30) -> DataFrame:
    """Rates per region, ranked over all regions, small ones included."""
    return rate_by_group(clean, [r.region], r, min_n).select(
        r.region,
        *EXPOSURE_COLUMNS,
        "trir",
        "dart",
        rank_descending(F.col("trir")).alias("rank_by_rate"),
        "note",
    )


def state_top10(rates: DataFrame, region: str, min_n: int = 30, k: int = 10) -> DataFrame:
    """The ``k`` highest rates among groups large enough; their rank over all groups stays."""
    return (
        rates.filter(F.col("n_establishments") >= min_n)
        .orderBy(F.col("trir").desc_nulls_last(), region)
        .limit(k)
    )


def insufficient_groups(rates: DataFrame, by: str, min_n: int = 30) -> DataFrame:
    """The groups too small to rank."""
    return rates.filter(F.col("n_establishments") < min_n).select(
        by, "n_establishments", "total_hours", "total_cases", "trir", "note"
    )


def deaths_rates(clean: DataFrame, r: Roles, min_n: int = 30, min_deaths: int = 10) -> DataFrame:
    """Deaths per 100 million hours beside the case rate, with both ranks. Few rows are noted
    first, then few deaths."""
    thin = f"fewer than {min_deaths} deaths - too thin to rank"
    return (
        clean.groupBy(r.group)
        .agg(*sums(r))
        .withColumns(
            {
                "deaths_per_100m_hours": scaled(F.col("deaths"), F.col("total_hours"), DEATH_SCALE),
                "trir": rate(),
            }
        )
        .select(
            r.group,
            "n_establishments",
            "deaths",
            "total_hours",
            "total_cases",
            "deaths_per_100m_hours",
            "trir",
            rank_descending(F.col("trir")).alias("rank_by_trir"),
            rank_descending(F.col("deaths_per_100m_hours")).alias("rank_by_death_rate"),
            F.when(F.col("n_establishments") < min_n, "insufficient n")
            .when(F.col("deaths") < min_deaths, thin)
            .otherwise("")
            .alias("note"),
        )
    )
