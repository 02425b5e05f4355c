"""Independent data-quality checks and the tables that explain their counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.functions.frames import rows_from, with_total
from ratewright.functions.ranking import rows_having_key
from ratewright.functions.ratios import percent
from ratewright.functions.values import as_filed_time
from ratewright.session import land


@dataclass(frozen=True)
class Check:
    """``fails`` is true for a failing row; NULL does not count. A check with ``unique``
    instead counts the rows beyond the first of each value."""

    number: int
    description: str
    fails: Column | None = None
    unique: str | None = None


def dq_audit(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per check. A row of the table may fail several; all are counted in one pass.

    Distinct values are counted by a pass of their own over that column, so that the
    shuffle they need carries nothing else.
    """
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(c.fails).alias(f"c{c.number}") for c in checks if c.unique is None],
    )
    for c in checks:
        if c.unique is not None:
            distinct = df.agg(F.countDistinct(F.col(c.unique)).alias("_distinct"))
            counted = (
                counted.crossJoin(F.broadcast(distinct))
                .withColumn(f"c{c.number}", F.col("rows") - F.col("_distinct"))
                .drop("_distinct")
            )
    return rows_from(
        counted,
        [
            {
                "check_no": F.lit(c.number).cast("bigint"),
                "description": F.lit(c.description),
                "rows_failing": F.col(f"c{c.number}"),
                "pct_of_raw": percent(F.col(f"c{c.number}"), F.col("rows"), 3),
            }
            for c in checks
        ],
    ).orderBy("check_no")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on more than one row; NULL keys count as one key."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .filter(F.col("n_rows") > 1)
        .orderBy(F.col("n_rows").desc(), *[F.col(k).asc_nulls_last() for k in keys])
    )


def duplicate_drilldown(df: DataFrame, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Every row of the duplicated keys. As with IN, a NULL key matches nothing. Keys are counted once,
    when this is called; the counts of the repeated ones also tell which are large."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    repeated = land(counted.filter(F.col("_rows") > 1), "repeated-keys")
    rows = df.select(*dict.fromkeys([*keys, *keep]))
    return rows_having_key(rows, keys, repeated.select(*keys), sizes=repeated)


def ratio_bands(
    df: DataFrame, numerator: str, denominator: str, edges: Sequence[float], labels: Sequence[str]
) -> DataFrame:
    """Rows per band of a ratio. The last edge belongs to the band below it, and rows without
    a ratio are a band, so the bands tile the table."""
    n, d = F.col(numerator), F.col(denominator)
    ratio = F.try_divide(n.cast("double"), d.cast("double"))
    band = F.when(n.isNull() | d.isNull() | (d == 0), "(not computable)")
    for edge, label in zip(edges[:-1], labels):
        band = band.when(ratio < edge, label)
    band = band.when(ratio <= edges[-1], labels[len(edges) - 1]).otherwise(labels[len(edges)])
    counts = df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n_rows"))
    return (
        with_total(counts, "n_rows", "rows")
        .select("band", "n_rows", percent(F.col("n_rows"), F.col("rows"), 3).alias("pct_of_raw"))
        .orderBy("band")
    )


def code_agreement(
    df: DataFrame, code: str, implied: Column, legacy: int, legacy_covers: Sequence[int]
) -> DataFrame:
    """Per reported code: rows that agree with the code implied by a measure, and rows that do
    not. The legacy code agrees with either band it spans; a NULL code disagrees."""
    agrees = (F.col(code) == F.col("_implied")) | (
        (F.col(code) == legacy) & F.col("_implied").isin(list(legacy_covers))
    )
    return (
        df.select(code, implied.alias("_implied"))
        .groupBy(F.coalesce(F.col(code).cast("string"), F.lit("(NULL)")).alias("size_code"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(agrees).alias("n_agree"),
            F.count_if(~agrees | F.col(code).isNull()).alias("n_disagree"),
        )
        .orderBy(F.col("n_disagree").desc(), "size_code")
    )


def code_confusion(df: DataFrame, code: str, implied: Column, k: int = 12) -> DataFrame:
    """The ``k`` commonest pairs of reported code and implied band."""
    return (
        df.groupBy(
            F.coalesce(F.col(code).cast("string"), F.lit("(NULL)")).alias("reported_size"),
            implied.alias("implied_band"),
        )
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy(F.col("n_rows").desc(), "reported_size", "implied_band")
        .limit(k)
    )


def _invalid_codes(df: DataFrame, code: str, well_formed: Column, known: str) -> DataFrame:
    reason = (
        F.when(F.col(code).isNull(), "NULL code")
        .when(~well_formed, "malformed")
        .when(F.col(known).isNull(), "not in lookup")
    )
    return df.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def invalid_code_reasons(df: DataFrame, code: str, well_formed: Column, known: str) -> DataFrame:
    """Why codes fail, with the range of failing codes. ``known`` holds the looked-up name."""
    return (
        _invalid_codes(df, code, well_formed, known)
        .groupBy("reason")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min(code).alias("min_code"),
            F.max(code).alias("max_code"),
        )
        .orderBy(F.col("n_rows").desc(), "reason")
    )


def invalid_code_values(
    df: DataFrame, code: str, well_formed: Column, known: str, k: int = 20
) -> DataFrame:
    """The ``k`` commonest failing codes, NULL left out."""
    return (
        _invalid_codes(df, code, well_formed, known)
        .filter(F.col(code).isNotNull())
        .groupBy(code)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy(F.col("n_rows").desc(), code)
        .limit(k)
    )


def parse_coverage(df: DataFrame, column: str, parsed: Column | None = None) -> DataFrame:
    """One row: how many texts parse as a time, how many do not, and the range of those that do."""
    value = as_filed_time(F.col(column)) if parsed is None else parsed
    rows = df.select(F.col(column).alias("txt"), value.alias("parsed")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("txt").isNull()).alias("n_null"),
        F.count_if(F.col("txt").isNotNull() & F.col("parsed").isNull()).alias("n_fail"),
        F.count("parsed").alias("n_ok"),
        F.min("parsed").alias("earliest"),
        F.max("parsed").alias("latest"),
    )
    return rows.select(
        "n_rows", "n_null", "n_fail", "n_ok",
        percent(F.col("n_ok"), F.col("n_rows"), 3).alias("pct_ok"),
        "earliest", "latest",
    )


def commonest_parses(
    df: DataFrame, column: str, k: int = 8, parsed: Column | None = None
) -> DataFrame:
    """The ``k`` commonest texts and what each parses to."""
    value = as_filed_time(F.col(column)) if parsed is None else parsed
    return (
        df.groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col(column).asc_nulls_last())
        .limit(k)
        .select(column, value.alias("cast_result"), "n")
    )
