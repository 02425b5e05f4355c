"""Tag every row with the first rule it fails; keep, count and show accordingly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ratewright.functions.fingerprint import Bag, fingerprints, same_bags, union_of
from ratewright.functions.frames import rows_from
from ratewright.functions.ranking import FLOOR, SLICES, numbered_in_group
from ratewright.functions.ratios import RATE_SCALE, scaled, sum_cases, where_positive
from ratewright.functions.values import as_filed_time, banded, in_range
from ratewright.roles import Limits, Roles

KEPT_STEP = 99
KEPT_LABEL = "clean rows kept"


def latest_submission(
    df: DataFrame,
    keys: Sequence[str],
    filed: str,
    ties: Sequence[str],
    name: str = "submission_rank",
    slices: int = SLICES,
    floor: int = FLOOR,
) -> DataFrame:
    """Add the rank of each row within its key, 1 being the latest filing; unparsable filing
    times rank last, and ``ties`` decide among equals, greatest first."""
    order = [as_filed_time(F.col(filed)), *[F.col(t) for t in ties]]
    return numbered_in_group(df, keys, order, name, slices=slices, floor=floor)


def prefix_lookup(
    df: DataFrame, code: str, length: int, lookup: DataFrame, name: str = "sector"
) -> DataFrame:
    """Add the name the code's prefix stands for, NULL where unknown. Many prefixes may share
    a name. The lookup has one row per prefix of ``length`` characters; its size decides how it
    is joined."""
    key, value = lookup.columns
    listed = lookup.select(F.col(key).cast("string").alias("_prefix"), F.col(value).alias(name))
    prefix = F.substring(F.col(code).cast("string"), 1, length)
    return df.join(listed, prefix == F.col("_prefix"), "left").drop("_prefix")


def with_measures(df: DataFrame, r: Roles) -> DataFrame:
    return df.withColumns(
        {
            "recordable_cases": sum_cases(*r.cases),
            "hours_per_employee": where_positive(F.col(r.exposure), F.col(r.workers)),
        }
    )


def outside_period(r: Roles, lim: Limits) -> Column:
    inside = in_range(F.col(r.period), lim.period_from, lim.period_to)
    return F.col(r.period).isNull() | ~inside


def well_formed_code(r: Roles, lim: Limits) -> Column:
    return F.col(r.code).cast("string").rlike(lim.code_pattern)


def bad_counts(r: Roles) -> Column:
    failed = F.lit(False)
    for c in (r.deaths, *r.cases):
        failed = failed | F.col(c).isNull() | (F.col(c) < 0)
    return failed


def staging_rules(r: Roles, lim: Limits, name: str = "sector") -> list[Column]:
    """The eight rules, in the order in which they claim a row."""
    per_worker = F.col("hours_per_employee")
    return [
        outside_period(r, lim),
        F.col("submission_rank") > 1,
        F.col(r.exposure).isNull() | (F.col(r.exposure) < lim.min_exposure),
        F.col(r.workers).isNull() | (F.col(r.workers) == 0),
        F.col(r.code).isNull() | ~well_formed_code(r, lim) | F.col(name).isNull(),
        bad_counts(r),
        F.col("recordable_cases") > F.col(r.workers),
        (per_worker < lim.min_ratio) | (per_worker > lim.max_ratio),
    ]


def first_fail(df: DataFrame, rules: Sequence[Column], name: str = "drop_step") -> DataFrame:
    """Add the number of the first rule that fires, NULL where none does. A rule that is NULL
    does not fire."""
    step = None
    for number, rule in enumerate(rules, start=1):
        step = F.when(rule, number) if step is None else step.when(rule, number)
    return df.withColumn(name, step.cast("bigint"))


def stage(
    raw: DataFrame,
    r: Roles,
    lim: Limits,
    lookup: DataFrame,
    slices: int = SLICES,
    floor: int = FLOOR,
) -> DataFrame:
    """Every raw row, with measures, submission rank, looked-up name and ``drop_step``."""
    ranked = latest_submission(raw, [r.unit, r.period], r.filed, r.ties, slices=slices, floor=floor)
    named = prefix_lookup(with_measures(ranked, r), r.code, lim.prefix_length, lookup)
    return first_fail(named, staging_rules(r, lim))


def size_band(r: Roles, lim: Limits) -> tuple[Column, Column]:
    """Band label and band order of the average number of workers."""
    edges = [b.below for b in lim.bands[:-1]]
    labels = [b.label for b in lim.bands]
    orders = list(range(1, len(lim.bands) + 1))
    workers = F.col(r.workers)
    return banded(workers, edges, labels), banded(workers, edges, orders).cast("bigint")


def clean(staged: DataFrame, r: Roles, lim: Limits) -> DataFrame:
    """Rows no rule claims, with rates and band. Rows without cases stay: their exposure
    belongs in every denominator."""
    label, order = size_band(r, lim)
    exposure = F.col(r.exposure)
    return (
        staged.filter(F.col("drop_step").isNull())
        .withColumns(
            {
                "trir": scaled(F.col("recordable_cases"), exposure, RATE_SCALE),
                "dart": scaled(sum_cases(*r.severe_cases), exposure, RATE_SCALE),
                "size_band": label,
                "size_order": order,
            }
        )
    )


def waterfall(staged: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Rows dropped per rule, 0 included, and the rows kept; together all rows. One pass."""
    steps = [(i, text) for i, text in enumerate(rules, start=1)]
    counted = staged.agg(
        *[F.count_if(F.col("drop_step") == i).alias(f"s{i}") for i, _ in steps],
        F.count_if(F.col("drop_step").isNull()).alias(f"s{KEPT_STEP}"),
    )
    return rows_from(
        counted,
        [
            {
                "step": F.lit(i).cast("bigint"),
                "rule": F.lit(text),
                "rows_dropped": F.col(f"s{i}"),
            }
            for i, text in [*steps, (KEPT_STEP, KEPT_LABEL)]
        ],
    ).orderBy("step")


def reconcile(parts: Mapping[str, tuple[DataFrame, DataFrame]], strict: bool = False) -> DataFrame:
    """One row per named pair of one-row, one-column frames: both values and whether they are
    equal. ``strict`` makes an unequal pair raise when the result is computed."""
    rows = None
    for name, (part, whole) in parts.items():
        row = part.toDF("part").crossJoin(F.broadcast(whole.toDF("whole"))).select(
            F.lit(name).alias("check_name"),
            F.col("part").cast("bigint").alias("part"),
            F.col("whole").cast("bigint").alias("whole"),
        )
        rows = row if rows is None else rows.unionByName(row)
    matched = rows.withColumn("matches", F.col("part").eqNullSafe(F.col("whole")))
    if not strict:
        return matched
    message = F.concat_ws(" ", F.lit("does not reconcile:"), "check_name", "part", "whole")
    return matched.withColumn(
        "matches", F.when(F.col("matches"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    )


def reconcile_rows(
    raw: DataFrame,
    staged: DataFrame,
    clean: DataFrame,
    exported: DataFrame,
    cube: DataFrame,
    published_cube: DataFrame,
) -> DataFrame:
    """Row for row: staged is raw, kept and dropped are raw, clean is what staging kept, the export
    read back is clean, the cube read back is the cube. Each table is read once; a row changed,
    lost, doubled or swapped for another is found though counts and sums agree.
    """
    given, kept = raw.columns, F.col("drop_step").isNull()
    tables = [
        fingerprints(raw, {"raw": Bag(given)}),
        fingerprints(
            staged,
            {
                "staged": Bag(given),
                "kept": Bag(given, kept),
                "dropped": Bag(given, ~kept),
                "kept_staged": Bag(staged.columns, kept),
            },
        ),
        fingerprints(clean, {"clean": Bag(staged.columns), "to_export": Bag(exported.columns)}),
        fingerprints(exported, {"exported": Bag(exported.columns)}, dict(clean.dtypes)),
        fingerprints(cube, {"cube": Bag(cube.columns)}),
        fingerprints(published_cube, {"published": Bag(cube.columns)}, dict(cube.dtypes)),
    ]
    c = F.col
    return same_bags(
        tables,
        {
            "staged rows are raw rows": (c("staged"), c("raw")),
            "kept and dropped rows are raw rows": (union_of(c("kept"), c("dropped")), c("raw")),
            "clean rows are kept rows": (c("clean"), c("kept_staged")),
            "exported rows are clean rows": (c("exported"), c("to_export")),
            "published cells are the cube": (c("published"), c("cube")),
        },
    )


def _step_keys(r: Roles) -> dict[int, Column]:
    """Per rule, what makes a dropped row extreme; the smallest comes first, NULL before all."""
    return {
        1: F.col(r.period).cast("double"),
        2: -F.col("submission_rank").cast("double"),
        3: F.col(r.exposure).cast("double"),
        4: F.col(r.workers).cast("double"),
        6: F.col(r.cases[0]).cast("double"),
        7: (F.col(r.workers) - F.col("recordable_cases")).cast("double"),
        8: -F.col("hours_per_employee"),
    }


def examples_per_step(staged: DataFrame, r: Roles, keep: Sequence[str], k: int = 2) -> DataFrame:
    """The ``k`` most extreme dropped rows of each step, each step by its own measure.

    The bound on the row number is applied to every partition before the shuffle, so a
    step that holds most rows sends only ``k`` per partition.
    """
    number = None
    for step, key in _step_keys(r).items():
        hit = F.col("drop_step") == step
        number = F.when(hit, key) if number is None else number.when(hit, key)
    text = F.when(F.col("drop_step") == 5, F.col(r.code).cast("string"))
    order = W.partitionBy("drop_step").orderBy(
        number.asc_nulls_first(),
        text.asc_nulls_first(),
        *[F.col(c).asc_nulls_first() for c in (r.unit, *r.ties)],
    )
    return (
        staged.filter(F.col("drop_step").isNotNull())
        .withColumn("example", F.row_number().over(order))
        .filter(F.col("example") <= k)
        .select("drop_step", F.col("example").cast("bigint").alias("example"), *keep)
    )


def post_clean_ranges(staged: DataFrame, r: Roles, lim: Limits) -> DataFrame:
    """One row: the ranges left after cleaning, and how the last rule's drops split into rows
    below and above its limits."""
    kept = F.col("drop_step").isNull()
    rate = scaled(F.col("recordable_cases"), F.col(r.exposure), RATE_SCALE)

    def span(column: Column, name: str, places: tuple[int, int] | None = None) -> list[Column]:
        low, high = F.min(F.when(kept, column)), F.max(F.when(kept, column))
        if places:
            low, high = F.round(low, places[0]), F.round(high, places[1])
        return [low.alias(f"min_{name}"), high.alias(f"max_{name}")]

    last = F.col("drop_step") == 8
    return staged.agg(
        *span(F.col(r.workers), "emp"),
        *span(F.col(r.exposure), "hours"),
        *span(F.col("hours_per_employee"), "hrs_per_emp", (2, 2)),
        *span(rate, "trir", (4, 2)),
        F.count_if(last & (F.col("hours_per_employee") < lim.min_ratio)).alias("n_ratio_low"),
        F.count_if(last & (F.col("hours_per_employee") > lim.max_ratio)).alias("n_ratio_high"),
    )
