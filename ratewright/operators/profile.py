"""What a raw table holds. Nothing here drops or alters a row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewright.functions.frames import rows_from, with_total
from ratewright.functions.order_stats import number_type, selected, sketches, targets
from ratewright.functions.ratios import percent
from ratewright.functions.values import is_blank, legend, reads_as_integer


def null_profile(df: DataFrame) -> DataFrame:
    """Per column: type, NULLs, blank texts, and their shares of all rows. One pass."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    measures = [F.count(F.lit(1)).alias("rows")]
    for f in df.schema.fields:
        measures.append(F.count_if(F.col(f.name).isNull()).alias(f"{f.name}:null"))
        if f.name in texts:
            measures.append(F.count_if(is_blank(F.col(f.name))).alias(f"{f.name}:blank"))

    def row(f: T.StructField) -> dict[str, Column]:
        n_null = F.col(f"`{f.name}:null`")
        n_blank = F.col(f"`{f.name}:blank`") if f.name in texts else F.lit(0).cast("bigint")
        return {
            "column_name": F.lit(f.name),
            "data_type": F.lit(f.dataType.simpleString()),
            "n_null": n_null,
            "pct_null": percent(n_null, F.col("rows"), 3),
            "n_blank": n_blank,
            "pct_null_or_blank": percent(n_null + n_blank, F.col("rows"), 3),
        }

    return rows_from(df.agg(*measures), [row(f) for f in df.schema.fields]).orderBy(
        F.col("pct_null_or_blank").desc_nulls_last(), "column_name"
    )


def value_counts(
    df: DataFrame, column: str, meanings: Mapping[object, str] | None = None, places: int = 3
) -> DataFrame:
    """Rows per value, NULL being a value, with the share of all rows and a legend text."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return (
        with_total(counts, "n", "rows")
        .select(
            "value",
            "n",
            percent(F.col("n"), F.col("rows"), places).alias("pct_of_raw"),
            legend(F.col("value"), meanings or {}, "").alias("meaning"),
        )
        .orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    )


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column, in the listed order: range, exact median, zeros, negatives, NULLs.

    Two scans, run when this is called; the driver gets a few numbers a column.
    """
    kind, measures = number_type(df, columns), sketches(df, columns, [0.5])
    for c in columns:
        measures += [
            F.min(c).cast(kind).alias(f"{c}:min"),
            F.max(c).cast(kind).alias(f"{c}:max"),
            F.count_if(F.col(c) == 0).alias(f"{c}:zero"),
            F.count_if(F.col(c) < 0).alias(f"{c}:negative"),
            F.count_if(F.col(c).isNull()).alias(f"{c}:null"),
        ]
    found = df.agg(*measures).first()
    medians = selected(df, columns, targets(found, columns, [0.5]))
    rows = [
        (i, c, found[f"{c}:min"], medians.get((c, 0.5)), *(found[f"{c}:{m}"] for m in ("max", "zero", "negative", "null")))
        for i, c in enumerate(columns, start=1)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        f"column_order bigint, column_name string, min_value {kind}, median_value double, max_value {kind},"
        " n_zero bigint, n_negative bigint, n_null bigint",
    )


def extreme_rows(
    df: DataFrame,
    by: str,
    k: int,
    ratio: tuple[str, str],
    keep: Sequence[str],
    ties: Sequence[Column] = (),
) -> DataFrame:
    """The ``k`` rows with the largest ``by``, with the ratio of two columns (1 decimal)."""
    numerator, denominator = ratio
    value = F.try_divide(F.col(numerator).cast("double"), F.col(denominator).cast("double"))
    return (
        df.orderBy(F.col(by).desc_nulls_last(), *ties)
        .limit(k)
        .select(*keep, F.round(value, 1).alias("hours_per_employee"))
    )


def quantiles(df: DataFrame, column: str, probabilities: Mapping[str, float]) -> DataFrame:
    """One row: exact interpolated quantiles under the given names, and the maximum. Two scans, run
    when this is called."""
    kind, shares = number_type(df, [column]), list(probabilities.values())
    found = df.agg(*sketches(df, [column], shares), F.max(column).cast(kind).alias("max_value")).first()
    values = selected(df, [column], targets(found, [column], shares))
    names = ", ".join(f"`{name}` double" for name in probabilities)
    row = (*(values.get((column, float(p))) for p in shares), found["max_value"])
    return df.sparkSession.createDataFrame([row], f"{names}, max_value {kind}")


def uncastable_values(df: DataFrame, column: str) -> DataFrame:
    """Text that does not cast to a whole number: each value with its count, and the count over all."""
    bad = (
        df.filter(F.col(column).isNotNull() & ~reads_as_integer(F.col(column)))
        .groupBy(F.col(column).alias("raw_value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return with_total(bad, "n", "n_total").orderBy(F.col("n").desc(), "raw_value")


def nonmatching_values(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Distinct texts that fail a pattern, with length and count."""
    return (
        df.filter(F.col(column).isNotNull() & ~F.col(column).rlike(pattern))
        .groupBy(F.col(column).alias("raw_value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("raw_value", F.length("raw_value").cast("bigint").alias("len"), "n")
        .orderBy(F.col("n").desc(), "raw_value")
    )


def torn_kind(key: str, payload: Sequence[str]) -> Column:
    """``left`` where the key is set and the payload is gone, ``right`` where the key is gone."""
    gone = F.lit(True)
    for c in payload:
        gone = gone & F.col(c).isNull()
    return F.when(F.col(key).isNull(), "right").when(gone, "left")


def torn_rows(df: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    """The rows of records split across lines, marked by which half they are."""
    return df.withColumn("half", torn_kind(key, payload)).filter(F.col("half").isNotNull())


def torn_records(df: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    """Rows per condition: key missing, each payload column missing, and either half."""
    half = torn_kind(key, payload)
    conditions = {f"{key} IS NULL": F.col(key).isNull()}
    conditions |= {f"{c} IS NULL": F.col(c).isNull() for c in payload}
    conditions |= {"left half": half == "left", "either half": half.isNotNull()}
    counted = df.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(conditions.values())])
    return rows_from(
        counted,
        [{"condition": F.lit(name), "n_rows": F.col(f"c{i}")} for i, name in enumerate(conditions)],
    )
