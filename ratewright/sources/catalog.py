"""Columns and types of a table, and whether they are the ones agreed on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DESCRIBED = "ordinal bigint, column_name string, data_type string, nullable boolean"


def describe(df: DataFrame) -> DataFrame:
    rows = [
        (i, f.name, f.dataType.simpleString(), f.nullable)
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return df.sparkSession.createDataFrame(rows, _DESCRIBED)


def schema_check(df: DataFrame, contract: T.StructType) -> DataFrame:
    """One row per column of either side: ``ok``, ``missing``, ``extra``, ``moved`` or ``retyped``,
    with the number of values the column holds."""
    found = {f.name: (i, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, 1)}
    agreed = {f.name: (i, f.dataType.simpleString()) for i, f in enumerate(contract.fields, 1)}

    def verdict(name: str) -> str:
        if name not in found:
            return "missing"
        if name not in agreed:
            return "extra"
        if found[name][1] != agreed[name][1]:
            return "retyped"
        return "ok" if found[name][0] == agreed[name][0] else "moved"

    names = [*agreed, *[n for n in found if n not in agreed]]
    filled = df.agg(*[F.count(F.col(n)).alias(n) for n in found])

    def row(name: str):
        expected, actual = agreed.get(name, (None, None)), found.get(name, (None, None))
        return F.struct(
            F.lit(name).alias("column_name"),
            F.lit(expected[0]).cast("bigint").alias("expected_ordinal"),
            F.lit(actual[0]).cast("bigint").alias("ordinal"),
            F.lit(expected[1]).cast("string").alias("expected_type"),
            F.lit(actual[1]).cast("string").alias("data_type"),
            F.lit(verdict(name)).alias("verdict"),
            (F.col(name) if name in found else F.lit(None).cast("bigint")).alias("n_values"),
        )

    return filled.select(F.inline(F.array(*[row(n) for n in names])))


def load_check(loaded: DataFrame, expected_rows: DataFrame) -> DataFrame:
    """One row: rows loaded, rows expected (a one-row, one-column frame), equal or not."""
    (expected,) = expected_rows.columns
    n = loaded.agg(F.count(F.lit(1)).alias("rows_loaded"))
    return n.crossJoin(
        F.broadcast(expected_rows.select(F.col(expected).cast("bigint").alias("rows_expected")))
    ).withColumn("matches", F.col("rows_loaded") == F.col("rows_expected"))
