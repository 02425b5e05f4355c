"""Cells that roll up where sums do not: distinct units and quantiles, as mergeable sketches.

A distinct count or a median of a coarse group cannot be had from those of its cells. A cell keeps
a sketch of its units and one of its values instead; merging cells' sketches gives that of the
group, with the same bound on the error as if its rows had been read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12
QUANTILE_K = 400


def distinct_error(lg_k: int = LG_K) -> float:
    """Relative standard error of the distinct count."""
    return 1.04 / math.sqrt(2.0**lg_k)


def rank_error(k: int = QUANTILE_K) -> float:
    """Share of the rows that a quantile's rank is off by at most, 99 times in a hundred."""
    return 2.446 / k**0.9433


def sketch_cells(
    rows: DataFrame, by: Sequence[str], unit: str, value: str, lg_k: int = LG_K, k: int = QUANTILE_K
) -> DataFrame:
    """One row a combination of ``by``: ``n_establishments, units, spread``, the last two being
    sketches of the distinct units and of the whole-number values; NULLs are in neither. A sketch
    is a few kilobytes whatever the cell holds, and partial ones are merged in the shuffle."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_establishments"),
        F.hll_sketch_agg(F.col(unit), lg_k).alias("units"),
        F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), k).alias("spread"),
    )


def rolled_up(cells: DataFrame, by: Sequence[str], quantiles: dict[str, float]) -> DataFrame:
    """Coarser groups from the cells alone: ``by``, rows, ``n_units`` and the named quantiles. Without
    ``by``, one row for everything. A group whose values are all NULL has NULL quantiles."""
    merged = cells.groupBy(*by).agg(
        F.sum("n_establishments").alias("n_establishments"),
        F.hll_union_agg("units").alias("units"),
        F.kll_merge_agg_bigint("spread").alias("spread"),
    )
    some = F.kll_sketch_get_n_bigint("spread") > 0

    def quantile(p: float) -> Column:
        return F.when(some, F.kll_sketch_get_quantile_bigint("spread", F.lit(float(p))))

    return merged.select(
        *by,
        "n_establishments",
        F.hll_sketch_estimate("units").alias("n_units"),
        *[quantile(p).alias(name) for name, p in quantiles.items()],
    )


def sketch_accuracy(
    rows: DataFrame, cells: DataFrame, by: str, unit: str, value: str, quantiles: dict[str, float], slack: float = 3.0
) -> DataFrame:
    """Per group: exact rows and units, and whether each estimate lies within ``slack`` times its
    error. A quantile is right if the rows below it and those up to it enclose its share."""
    estimates = rolled_up(cells, [by], quantiles).withColumnsRenamed(
        {"n_units": "_units", "n_establishments": "_rows", **{q: f"_{q}" for q in quantiles}, by: "_by"}
    )
    exact = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(unit).alias("n_units"))
    held = rows.filter(F.col(value).isNotNull()).join(estimates, F.col(by).eqNullSafe(F.col("_by")))
    sides = held.groupBy(by).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(value) < F.col(f"_{q}")).alias(f"_below_{q}") for q in quantiles],
        *[F.count_if(F.col(value) <= F.col(f"_{q}")).alias(f"_upto_{q}") for q in quantiles],
    ).withColumnRenamed(by, "_of")
    off = slack * rank_error()

    def inside(q: str, p: float) -> Column:
        low, high = (F.col(f"_{side}_{q}") / F.col("_n") for side in ("below", "upto"))
        return F.coalesce((low - off <= p) & (high + off >= p), F.lit(True)).alias(f"{q}_within")

    return (
        exact.join(estimates.select("_by", "_units"), F.col(by).eqNullSafe(F.col("_by")))
        .join(sides, F.col(by).eqNullSafe(F.col("_of")), "left")
        .select(
            by,
            "n_rows",
            "n_units",
            (F.abs(F.col("_units") - F.col("n_units")) <= F.ceil(slack * distinct_error() * F.col("n_units"))).alias("units_within"),
            *[inside(q, p) for q, p in quantiles.items()],
        )
    )
