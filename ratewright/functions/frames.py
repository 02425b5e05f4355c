"""Small DataFrame shapes used by many operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rows_from(one_row: DataFrame, rows: Iterable[Mapping[str, Column]]) -> DataFrame:
    """Turn one wide aggregate row into several narrow ones.

    The measures are computed in a single pass over the data; only the finished
    row is fanned out.
    """
    records = F.array(*[F.struct(*[c.alias(n) for n, c in row.items()]) for row in rows])
    return one_row.select(F.inline(records))


def with_total(groups: DataFrame, measure: str, name: str) -> DataFrame:
    """Attach the grand total of ``measure`` to every row by a one-row cross join."""
    total = groups.agg(F.sum(measure).alias(name))
    return groups.crossJoin(F.broadcast(total))


def rank_descending(value: Column) -> Column:
    """RANK over a table of groups; NULL ranks last. For aggregated rows only."""
    return F.rank().over(W.orderBy(value.desc_nulls_last())).cast("bigint")


def small_sample_note(count: Column, minimum: int) -> Column:
    return F.when(count < minimum, "insufficient n").otherwise("")
