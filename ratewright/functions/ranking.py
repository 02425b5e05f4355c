"""Row numbers within groups that stay cheap when one group holds much of the table.

A plain window sends each group to one task. Here a group that is too large is first
cut into slices along the sort order; rows are numbered inside a slice and shifted by
the number of rows in the slices before it. The numbers are the same either way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SLICES = 32_768
FLOOR = 1_000_000
#: Key hashes by which rows are counted before any group is looked at.
BUCKETS = 16_384

_JUMPS = [512, 256, 128, 64, 32, 16, 8, 4, 2, 1]


def large_groups(
    df: DataFrame,
    keys: Sequence[str],
    slices: int = SLICES,
    floor: int = FLOOR,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Groups above ``floor`` rows that hold over ``2 / slices`` of the table.

    At most ``slices / 2`` groups can be that large, whatever the data, so the result
    is always small enough to broadcast. Columns: the keys and ``_step``, the rows
    between two cuts. ``sizes`` may give the keys' ``_rows`` where they are counted already;
    keys of one row need not be among them.
    """
    if sizes is None:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        whole = sizes.agg(F.sum("_rows").alias("_whole"))
    else:
        whole = df.agg(F.count(F.lit(1)).alias("_whole"))
    share = F.col("_rows").cast("double") * slices
    step = F.greatest(F.floor(F.col("_whole") / slices), F.lit(max(1, floor // 8)))
    return (
        sizes.crossJoin(F.broadcast(whole))
        .filter((F.col("_rows") > floor) & (share > 2.0 * F.col("_whole")))
        .select(*keys, step.alias("_step"))
    )


def _may_be_large(df: DataFrame, keys: Sequence[str], floor: int) -> bool:
    """Whether any group can hold more than ``floor`` rows. Rows are counted by a hash of their
    key, which moves a fixed number of counts a task and not a row a key."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")
    counted = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_rows"))
    return not counted.filter(F.col("_rows") > floor).isEmpty()


def _prefixed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_k_{k}" for k in keys})


def _matches(keys: Sequence[str]) -> Column:
    """NULL keys form a group of their own, so they must match too."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return condition


def _greater(entries: Column, position: Column) -> Column:
    """How many entries of a descending array are greater, by binary search."""

    def ahead(passed: Column, jump: Column) -> Column:
        further = F.try_element_at(entries, passed + jump) > position
        return F.when(further, passed + jump).otherwise(passed)

    return F.aggregate(F.array(*[F.lit(j) for j in _JUMPS]), F.lit(0), ahead)


def in_slices(df: DataFrame, keys: Sequence[str], position: str, steps: DataFrame) -> DataFrame:
    """Add ``_slice``: 0 for the greatest positions of a group, then 1, and so on.

    ``steps`` names the groups to cut (keys and ``_step``, about how many rows apart); rows
    of other groups are in slice 0 with ``_cut`` false. A position is a cut when its hash
    says so, one in ``_step``. That depends on values alone, so a task that runs again
    finds the same slices. All cuts of all groups are about rows / step, a fixed number.
    """
    cuts = (
        df.select(*keys, position)
        .join(F.broadcast(_prefixed(steps, keys)), _matches(keys))
        .filter(F.pmod(F.xxhash64(position), F.col("_step")) == 0)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set(position), asc=False).alias("_cuts"))
    )
    # Chunks of about the square root of the cuts. A row finds its chunk by the chunks' ends,
    # then its place in that chunk, so no row ever carries all cuts of its group.
    last = F.ceil(F.size("_cuts") / F.col("_width")).cast("int") - 1
    chunked = cuts.withColumn("_width", F.ceil(F.sqrt(F.size("_cuts"))).cast("int")).select(
        *keys,
        "_width",
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.slice("_cuts", i * F.col("_width") + 1, F.col("_width")),
        ).alias("_chunks"),
    )
    ends = chunked.select(
        *keys, "_width", F.transform("_chunks", lambda chunk: F.element_at(chunk, -1)).alias("_ends")
    )
    inner = chunked.select(*keys, F.posexplode("_chunks").alias("_passed", "_inner"))
    at, both = F.col(position), [*keys, "_passed"]
    within = F.coalesce(F.when(F.col("_inner").isNotNull(), _greater(F.col("_inner"), at)), F.lit(0))
    return (
        df.join(F.broadcast(_prefixed(ends, keys)), _matches(keys), "left")
        .withColumn("_cut", F.col("_width").isNotNull())
        .withColumn("_passed", F.when(F.col("_cut"), _greater(F.col("_ends"), at)))
        .select(*df.columns, "_cut", "_width", "_passed")
        .join(F.broadcast(_prefixed(inner, both)), _matches(both), "left")
        .withColumn(
            "_slice",
            F.when(F.col("_cut"), F.col("_passed") * F.col("_width") + within).otherwise(0),
        )
        .select(*df.columns, "_cut", "_slice")
    )


def numbered_in_group(
    df: DataFrame,
    keys: Sequence[str],
    newest_first: Sequence[Column],
    name: str,
    slices: int = SLICES,
    floor: int = FLOOR,
) -> DataFrame:
    """Add ``name``: 1 for the greatest row of its group under ``newest_first``, then 2, ...

    NULL sorts last. Give enough columns for a total order. Where no group can be large, rows are
    moved once, with nothing beside their columns but the values of ``newest_first``.
    """
    if not _may_be_large(df, keys, floor):
        whole = W.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in newest_first])
        return df.withColumn(name, F.row_number().over(whole).cast("bigint"))
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(newest_first)])
    sliced = in_slices(df.withColumn("_at", at), keys, "_at", large_groups(df, keys, slices, floor))

    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sliced.filter("_cut")
        .groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    )
    inside = W.partitionBy(*keys, "_slice").orderBy(
        *[F.col(f"_at.o{i}").desc_nulls_last() for i in range(len(newest_first))]
    )
    placed = sliced.withColumn("_place", F.row_number().over(inside).cast("bigint"))
    every = [*keys, "_slice"]
    return placed.join(F.broadcast(_prefixed(offsets, every)), _matches(every), "left").select(
        *df.columns, (F.col("_place") + F.coalesce("_ahead", F.lit(0))).alias(name)
    )


def rows_having_key(
    df: DataFrame,
    keys: Sequence[str],
    wanted: DataFrame,
    slices: int = SLICES,
    floor: int = FLOOR,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Rows whose keys are in ``wanted``; rows with a NULL key never match. ``sizes`` as in
    ``large_groups``.

    Rows of large groups are matched against the few large keys where they lie; only
    the rest is shuffled.
    """
    large = large_groups(df, keys, slices, floor, sizes).select(*keys).dropna()
    heavy = df.join(
        F.broadcast(large.join(wanted, list(keys), "left_semi")), list(keys), "left_semi"
    )
    light = df.join(F.broadcast(large), list(keys), "left_anti").join(
        wanted, list(keys), "left_semi"
    )
    return heavy.unionByName(light)
