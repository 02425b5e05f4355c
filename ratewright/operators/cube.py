"""The additive cube and what is read off it, the row export, and the chart feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ratewright.functions.ratios import RATE_SCALE, scaled, sum_cases
from ratewright.operators.rates import rate
from ratewright.roles import Roles

CUBE_SUMS = ["n_establishments", "total_hours", "total_cases", "deaths", "dart_cases"]


def clean_export(clean: DataFrame, allowed: Sequence[str], withheld: Sequence[str] = ()) -> DataFrame:
    """Row-level export of the listed columns. Naming a withheld column is an error."""
    named = set(allowed) & set(withheld)
    if named:
        raise ValueError(f"columns that must not be published: {sorted(named)}")
    return clean.select(*allowed)


def pivot_source(clean: DataFrame, by: Sequence[str], r: Roles) -> DataFrame:
    """Sums per combination of ``by``; no rates, so that sums of cells stay right."""
    return clean.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_establishments"),
        F.sum(r.exposure).alias("total_hours"),
        F.sum("recordable_cases").alias("total_cases"),
        F.sum(r.deaths).alias("deaths"),
        F.sum(sum_cases(*r.severe_cases)).alias("dart_cases"),
    )


def rollup_from_cube(cube: DataFrame, by: Sequence[str]) -> DataFrame:
    """Coarser sums and rates from the cube alone."""
    return (
        cube.groupBy(*by)
        .agg(*[F.sum(c).alias(c) for c in CUBE_SUMS])
        .select(
            *by,
            *CUBE_SUMS,
            rate().alias("trir"),
            scaled(F.col("dart_cases"), F.col("total_hours"), RATE_SCALE).alias("dart"),
        )
    )


def sector_size_rates(cube: DataFrame, group: str) -> DataFrame:
    """Rate per group and band, 2 decimals."""
    return rollup_from_cube(cube, [group, "size_band", "size_order"]).select(
        group,
        "size_band",
        "size_order",
        "n_establishments",
        "total_hours",
        "total_cases",
        F.round("trir", 2).alias("trir"),
    )


def rate_pivot(
    cube: DataFrame,
    group: str,
    bands: Sequence[str],
    keep: Column | None = None,
    places: int | None = None,
) -> DataFrame:
    """Groups by bands, bands in the given order; a cell is a ratio of sums. ``keep`` slices the
    cube first."""
    chosen = cube if keep is None else cube.filter(keep)
    rate = scaled(F.sum("total_cases"), F.sum("total_hours"), RATE_SCALE)
    cell = rate if places is None else F.round(rate, places)
    return chosen.groupBy(group).pivot("size_band", list(bands)).agg(cell).select(group, *_quoted(bands))


def published_pivot(table: DataFrame, group: str, bands: Sequence[str]) -> DataFrame:
    """Groups by bands of a published table that holds one rate per cell."""
    cells = table.groupBy(group).pivot("size_band", list(bands)).agg(F.avg("trir"))
    return cells.select(group, *_quoted(bands))


def _quoted(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def gradient_shape(pivot: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Per group of a pivot of rounded rates: the fall from first to last band, and whether the
    rate never rises on the way. A missing band makes either test false."""
    cells = _quoted(bands)
    level = F.lit(True)
    for a, b in zip(cells, cells[1:]):
        level = level & F.coalesce(a >= b, F.lit(False))
    first, last = cells[0], cells[-1]
    return pivot.select(
        "*",
        F.round(first - last, 2).alias("fall_first_to_last"),
        F.coalesce(first > last, F.lit(False)).alias("falls"),
        F.coalesce(first <= last, F.lit(False)).alias("rises_or_level"),
        level.alias("monotonic"),
    )


def gradient_summary(shape: DataFrame, group: str) -> DataFrame:
    """One row: groups that fall, that fall at every band, that do not fall, and the names of
    those that rise or stay level."""
    named = F.collect_list(F.when(F.col("rises_or_level"), F.col(group)))
    return shape.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if("falls").alias("n_falls"),
        F.count_if("monotonic").alias("n_monotonic"),
        F.count_if(~F.col("falls")).alias("n_other_way"),
        F.array_join(F.sort_array(named), ", ").alias("other_way"),
    )


def chart_feeds(ranked: DataFrame, bands: DataFrame, top: DataFrame, group: str, region: str) -> DataFrame:
    """What the four charts draw, in order: feed, position, label, n, value, rank on the other
    measure. Groups marked ``insufficient n`` are left out of the first two."""
    enough = ranked.filter(~F.col("note").eqNullSafe("insufficient n"))
    by_rate, by_count = F.col("rank_by_rate"), F.col("rank_by_count")
    none = F.lit(None).cast("bigint")

    def feed(df: DataFrame, name: str, label: str, value: str, other: Column, *order: Column):
        return df.select(
            F.lit(name).alias("feed"),
            F.row_number().over(W.orderBy(*order)).cast("bigint").alias("position"),
            F.col(label).alias("label"),
            "n_establishments",
            F.col(value).cast("double").alias("value"),
            other.alias("other_rank"),
        )

    return (
        feed(enough, "groups by rate", group, "trir", by_count, by_rate, F.col(group))
        .unionByName(
            feed(enough, "groups by count", group, "total_cases", by_rate, by_count, F.col(group))
        )
        .unionByName(feed(bands, "size bands", "size_band", "trir", none, F.col("size_order")))
        .unionByName(feed(top, "top regions", region, "trir", none, F.col("trir").desc(), F.col(region)))
    )


