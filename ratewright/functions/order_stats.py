"""Exact quantiles from a sketch and a bracket.

A first scan keeps a mergeable quantile sketch a column. Its rank error is bounded, so it gives two
values between which the sought ranks must lie. A second scan counts what lies below the lower one
and groups and sorts only what lies between them: a few ten-thousandths of the rows. Where even
that is more than one task should sort, further scans narrow the bracket first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegralType

#: The sketch's ranks are off by at most a share 1 / ACCURACY of the rows.
ACCURACY = 10_000

#: Rows a bracket may be expected to hold before it is narrowed by another scan.
MOST_ROWS = 4_000_000

#: Half-widths of the brackets asked of the first scan, as shares of the rows; the narrowest is
#: taken that exceeds the sketch's error and one row.
WIDTHS = [2 / ACCURACY, 1e-3, 1e-2, 0.1, 1.0]

_GRID = 256


def number_type(df: DataFrame, columns: Sequence[str]) -> str:
    """``bigint`` if all the columns hold whole numbers, else ``double``."""
    return "bigint" if all(isinstance(df.schema[c].dataType, IntegralType) for c in columns) else "double"


@dataclass
class Target:
    """A quantile sought, the 0-based ranks it lies between, and values that enclose them."""

    column: str
    p: float
    rows: int
    low: object
    high: object
    expected: float  # rows in the bracket

    @property
    def position(self) -> float:
        return (self.rows - 1) * self.p

    @property
    def ranks(self) -> tuple[int, int]:
        return math.floor(self.position), math.ceil(self.position)


def sketches(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> list[Column]:
    """Measures of the first scan, to be put into any aggregate over ``df``; ``targets`` reads them."""
    kind = number_type(df, columns)
    shares = [share for p in probabilities for share in _asked(p)]
    return [
        measure
        for c in columns
        for measure in (
            F.count(c).alias(f"{c}:rows"),
            F.percentile_approx(F.col(c).cast(kind), shares, ACCURACY).alias(f"{c}:sketch"),
        )
    ]


def _asked(p: float) -> list[float]:
    return [share for w in WIDTHS for share in (max(0.0, p - w), min(1.0, p + w))]


def targets(found: Row, columns: Sequence[str], probabilities: Sequence[float]) -> list[Target]:
    """The brackets that the first scan's row gives. A column without values has none."""
    out = []
    for c in columns:
        rows, values = found[f"{c}:rows"], found[f"{c}:sketch"]
        if not rows:
            continue
        k = next(i for i, w in enumerate(WIDTHS) if w * rows >= 2 or w == WIDTHS[-1])
        for i, p in enumerate(probabilities):
            low, high = values[2 * (i * len(WIDTHS) + k) :][:2]
            out.append(Target(c, float(p), rows, low, high, min(1.0, 2 * WIDTHS[k]) * rows))
    return out


def _literal(value: object, kind: str) -> Column:
    return F.lit(value).cast(kind)


def narrowed(df: DataFrame, kind: str, sought: Sequence[Target], most: int) -> list[Target]:
    """One more scan for brackets of too many rows: exact counts and a sketch inside each."""
    wide = [t for t in sought if t.expected > most and t.low != t.high]
    if not wide:
        return list(sought)
    measures = []
    for i, t in enumerate(wide):
        v = F.col(t.column).cast(kind)
        low, high = _literal(t.low, kind), _literal(t.high, kind)
        inside = F.when((v >= low) & (v <= high), v)
        measures += [
            F.count_if(v < low).alias(f"below{i}"),
            F.count(inside).alias(f"inside{i}"),
            F.percentile_approx(inside, [k / _GRID for k in range(_GRID + 1)], ACCURACY).alias(f"grid{i}"),
        ]
    row = df.agg(*measures).first()
    better = {}
    for i, t in enumerate(wide):
        below, inside, grid = row[f"below{i}"], row[f"inside{i}"], row[f"grid{i}"]
        first, last = ((rank - below) / max(inside, 1) for rank in t.ranks)
        k, m = max(0, math.floor(first * _GRID) - 1), min(_GRID, math.ceil(last * _GRID) + 1)
        low, high = grid[k], grid[m]
        still = (low, high) == (t.low, t.high)  # a few values that very many rows share
        better[id(t)] = Target(t.column, t.p, t.rows, low, high, 0.0 if still else inside * (m - k) / _GRID)
    return narrowed(df, kind, [better.get(id(t), t) for t in sought], most)


def bracketed(df: DataFrame, kind: str, sought: Sequence[Target]) -> DataFrame:
    """The second scan: ``i, low, high``, the values at both ranks of each target.

    Values below a bracket become one NULL that is counted; those above it are left out.
    """
    pairs = []
    for i, t in enumerate(sought):
        v = F.col(t.column).cast(kind)
        pair = F.struct(F.lit(i).alias("i"), F.when(v >= _literal(t.low, kind), v).alias("value"))
        pairs.append(F.when(v <= _literal(t.high, kind), pair))
    kept = F.filter(F.array(*pairs), lambda pair: pair.isNotNull())
    counted = df.select(F.inline(kept)).groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("i").orderBy(F.col("value").asc_nulls_first()))
    rank = {side: F.array(*[F.lit(t.ranks[side]).cast("bigint") for t in sought])[F.col("i")] for side in (0, 1)}

    def at(side: int) -> Column:
        holds = (rank[side] < F.col("upto")) & (rank[side] >= F.col("upto") - F.col("n"))
        return F.max(F.when(holds, F.col("value")))

    placed = counted.withColumn("upto", upto).filter("value IS NOT NULL")
    return placed.groupBy("i").agg(at(0).alias("low"), at(1).alias("high"))


def selected(df: DataFrame, columns: Sequence[str], sought: Sequence[Target], most: int = MOST_ROWS) -> dict:
    """(column, p) -> linearly interpolated quantile. The driver gets two numbers a quantile."""
    kind = number_type(df, columns)
    sought = narrowed(df, kind, sought, most)
    rows = {r["i"]: r for r in bracketed(df, kind, sought).collect()} if sought else {}
    out = {}
    for i, t in enumerate(sought):
        r = rows.get(i)
        if r is None or r["low"] is None or r["high"] is None:
            raise ArithmeticError(f"the sketch of {t.column} broke its bound at {t.p}")
        fraction = t.position - math.floor(t.position)
        out[t.column, t.p] = float(r["low"] + (r["high"] - r["low"]) * fraction if fraction else r["low"])
    return out


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], most: int = MOST_ROWS
) -> dict[tuple[str, float], float]:
    """Linearly interpolated quantiles of numeric columns, NULLs left out: (column, p) -> value.

    Two scans, at most three exchanges, both run when this is called.
    """
    found = df.agg(*sketches(df, columns, probabilities)).first()
    return selected(df, columns, targets(found, columns, probabilities), most)
