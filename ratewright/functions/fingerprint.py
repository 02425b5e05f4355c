"""Fingerprints of bags of rows that add up.

A row's values give two independent 63-bit hashes; a bag's fingerprint is its row count and the
sums of the hashes' parts. Equal bags have equal fingerprints whatever their order, and the
fingerprints of two parts add up to that of their union, so that one scan a table proves which
rows it holds. That two different bags agree by chance is as likely as 126 equal coin tosses.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS, _BITS = 3, 21  # a sum of 21-bit parts holds 2**42 rows
_SEEDS = (17, 4099)


@dataclass(frozen=True)
class Bag:
    """The rows for which ``where`` is true, seen through ``columns``."""

    columns: Sequence[str]
    where: Column | None = None


def _hash_parts(columns: Sequence[str], types: Mapping[str, str]) -> list[Column]:
    """Every value with its NULL mark: a hash alone skips NULLs, so they could change places."""
    values = [v for c in columns for v in (F.col(c).cast(types[c]), F.col(c).isNull())]
    mask = (1 << _BITS) - 1
    return [
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), *values), i * _BITS).bitwiseAND(F.lit(mask).cast("long"))
        for seed in _SEEDS
        for i in range(_PARTS)
    ]


def fingerprints(df: DataFrame, bags: Mapping[str, Bag], types: Mapping[str, str] | None = None) -> DataFrame:
    """One row with a struct ``n, sums`` a bag, all from one scan. ``types`` gives the types in which
    values are compared; without it they are the table's own."""
    types = types or dict(df.dtypes)
    measures = []
    for name, bag in bags.items():
        inside = F.lit(True) if bag.where is None else F.coalesce(bag.where, F.lit(False))
        sums = [F.coalesce(F.sum(F.when(inside, p)), F.lit(0)) for p in _hash_parts(bag.columns, types)]
        measures.append(F.struct(F.count_if(inside).alias("n"), F.array(*sums).alias("sums")).alias(name))
    return df.agg(*measures)


def union_of(*bags: Column) -> Column:
    """The fingerprint of several bags put together."""
    total = bags[0]
    for bag in bags[1:]:
        total = F.struct(
            (total["n"] + bag["n"]).alias("n"),
            F.zip_with(total["sums"], bag["sums"], lambda a, b: a + b).alias("sums"),
        )
    return total


def same_bags(tables: Sequence[DataFrame], checks: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """One row a check: how many rows either side has, and whether they are the same rows.

    ``tables`` are one-row frames of ``fingerprints``; a check names two of their columns, or
    unions of them.
    """
    row = tables[0]
    for other in tables[1:]:
        row = row.crossJoin(F.broadcast(other))
    records = [
        F.struct(
            F.lit(name).alias("check_name"),
            part["n"].alias("n_part"),
            whole["n"].alias("n_whole"),
            ((part["n"] == whole["n"]) & (part["sums"] == whole["sums"])).alias("same_rows"),
        )
        for name, (part, whole) in checks.items()
    ]
    return row.select(F.inline(F.array(*records)))
