"""All roll-ups of the additive cube, each from its smallest parent."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.functions.ratios import RATE_SCALE, scaled
from ratewright.operators.cube import CUBE_SUMS
from ratewright.operators.rates import rate
from ratewright.session import land


def grouping_number(kept: Sequence[str], dimensions: Sequence[str]) -> int:
    """One bit a dimension, the first the highest; 1 where it is rolled up."""
    return sum(1 << i for i, d in enumerate(reversed(dimensions)) if d not in kept)


def cube_lattice(cube: DataFrame, dimensions: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row a cell of every subset of the dimensions: their columns, NULL where rolled up,
    ``grouping_id``, sums and rates.

    A dimension is one or more columns that go together. The rows' table is not read: every
    roll-up is added up from the smallest landed one that has its dimensions and one more, so a
    coarse one costs what its parent holds. ``grouping_id`` tells a rolled-up NULL from a group
    that is NULL. A cube without cells gives no rows, not even a total.
    """
    names = list(dimensions)
    columns = [c for d in names for c in dimensions[d]]
    tables: dict[tuple[str, ...], DataFrame] = {tuple(names): land(cube.select(*columns, *CUBE_SUMS), "lattice")}
    sizes = {tuple(names): tables[tuple(names)].count()}
    for width in range(len(names) - 1, -1, -1):
        for kept in combinations(names, width):
            parents = [p for p in tables if len(p) == width + 1 and set(kept) < set(p)]
            parent = min(parents, key=lambda p: (sizes[p], p))
            by = [c for d in kept for c in dimensions[d]]
            sums = [F.sum(c).alias(c) for c in CUBE_SUMS]
            found = tables[parent].groupBy(*by).agg(*sums).filter("n_establishments > 0")
            tables[kept] = land(found, "lattice")
            sizes[kept] = tables[kept].count()
    whole = None
    for kept, table in tables.items():
        held = {c for d in kept for c in dimensions[d]}
        shown = [F.col(c) if c in held else F.lit(None).cast(cube.schema[c].dataType).alias(c) for c in columns]
        number = F.lit(grouping_number(kept, names)).cast("bigint").alias("grouping_id")
        level = table.select(*shown, number, *CUBE_SUMS)
        whole = level if whole is None else whole.unionByName(level)
    return whole.select(
        "*", rate().alias("trir"), scaled(F.col("dart_cases"), F.col("total_hours"), RATE_SCALE).alias("dart")
    )
