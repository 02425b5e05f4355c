"""Late filings folded into results that stand, without staging everything again.

What stands is one row a unit and period, its latest filing, and the additive cube over those of
them that no rule drops. A batch touches the units it names only: their old rows' contribution is
taken out of the cube and that of the rows that are now the latest is put in.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.functions.values import as_filed_time
from ratewright.operators import rules
from ratewright.operators.cube import CUBE_SUMS, pivot_source
from ratewright.roles import Limits, Roles


def _order(r: Roles) -> list[Column]:
    return [as_filed_time(F.col(r.filed)), *[F.col(t) for t in r.ties]]


def latest(rows: DataFrame, r: Roles) -> DataFrame:
    """The latest filing of each unit and period, in the columns of ``rows``.

    The greatest row of a key is an aggregate with a partial result in each task, so a unit of very
    many filings, or all rows without a unit, are no burden. NULL loses, as in the ranking.
    """
    keys = [r.unit, r.period]
    rest = [c for c in rows.columns if c not in keys]
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_order(r))])
    best = rows.groupBy(*keys).agg(F.max(F.struct(place.alias("place"), *rest)).alias("best"))
    return best.select(*[c if c in keys else F.col(f"best.`{c}`").alias(c) for c in rows.columns])


def _same_key(one: DataFrame, other: DataFrame, r: Roles) -> Column:
    return one[r.unit].eqNullSafe(other[r.unit]) & one[r.period].eqNullSafe(other[r.period])


def contributions(winners: DataFrame, r: Roles, lim: Limits, lookup: DataFrame) -> DataFrame:
    """The clean ones of latest filings, with rates and band; other columns stay."""
    named = rules.prefix_lookup(rules.with_measures(winners, r), r.code, lim.prefix_length, lookup)
    ranked = named.withColumn("submission_rank", F.lit(1).cast("bigint"))
    return rules.clean(rules.first_fail(ranked, rules.staging_rules(r, lim)), r, lim)


def standing_cube(winners: DataFrame, r: Roles, lim: Limits, lookup: DataFrame, by: Sequence[str]) -> DataFrame:
    return pivot_source(contributions(winners, r, lim, lookup), by, r)


@dataclass(frozen=True)
class Folded:
    winners: DataFrame
    cube: DataFrame


def fold(
    winners: DataFrame, cube: DataFrame, batch: DataFrame, r: Roles, lim: Limits, lookup: DataFrame, by: Sequence[str]
) -> Folded:
    """``winners`` and ``cube`` as if the batch's rows had been there from the start.

    Both are read once; only rows of units the batch names are staged. A filing older than the one
    that stands changes nothing; one that is newer may move a unit to another cell, or out of the
    cube if a rule drops it, or into it. Cells that lose their last row go.
    """
    newest = latest(batch.select(*winners.columns), r)
    named = newest.select(r.unit, r.period)
    old = winners.join(named, _same_key(winners, named, r), "left_semi")
    now = latest(old.unionByName(newest), r)
    signed = old.withColumn("sign", F.lit(-1)).unionByName(now.withColumn("sign", F.lit(1)))
    moved = contributions(signed, r, lim, lookup)
    sums = {
        "n_establishments": F.lit(1),
        "total_hours": F.col(r.exposure),
        "total_cases": F.col("recordable_cases"),
        "deaths": F.col(r.deaths),
        "dart_cases": rules.sum_cases(*r.severe_cases),
    }
    delta = moved.groupBy(*by).agg(*[F.sum(F.col("sign") * v).alias(name) for name, v in sums.items()])
    folded = (
        cube.select(*by, *CUBE_SUMS)
        .unionByName(delta)
        .groupBy(*by)
        .agg(*[F.sum(c).alias(c) for c in CUBE_SUMS])
        .filter("n_establishments > 0")
    )
    untouched = winners.join(named, _same_key(winners, named, r), "left_anti")
    return Folded(untouched.unionByName(now), folded)
