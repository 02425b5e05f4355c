"""Readers and writers of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Quotes are doubled inside quoted fields, so a quote escapes a quote.
_DIALECT = {"header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, quoted_newlines: bool = False
) -> DataFrame:
    """CSV under a declared schema; a record that does not parse raises.

    ``quoted_newlines`` reads each file in one task, so keep it for files that need it:
    ``records.record_structure`` tells.
    """
    return (
        spark.read.options(**_DIALECT)
        .option("mode", "FAILFAST")
        .option("enforceSchema", "false")
        .option("multiLine", str(quoted_newlines).lower())
        .schema(schema)
        .csv(path)
    )


def infer_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with types inferred from every record, not from the first few thousand."""
    return (
        spark.read.options(**_DIALECT)
        .option("mode", "FAILFAST")
        .option("inferSchema", "true")
        .option("samplingRatio", "1.0")
        .csv(path)
    )


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """Many files, one per partition; a compressed one is read by one task."""
    df.write.mode("overwrite").options(**_DIALECT).option("compression", compression).csv(path)


def write_result(df: DataFrame, path: str, order: Sequence) -> None:
    """One sorted CSV file. Only for result tables, which have one row per group."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").options(**_DIALECT).csv(path)


def write_export(
    df: DataFrame, path: str, order: Sequence[str], spread_by: Sequence[str], compression: str = "none"
) -> None:
    """Row-level export as many sorted files.

    ``spread_by`` (say, the row's identifier) breaks ties in the range split, so one
    large combination of the ``order`` columns does not end up in a single file.
    """
    keys = [*order, *spread_by]
    write_csv(df.repartitionByRange(*keys).sortWithinPartitions(*keys), path, compression)


def inspection_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a seeded hash of their key: the same rows every time."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    return (
        df.withColumn("_draw", F.md5(text))
        .orderBy("_draw", *[F.col(k).asc_nulls_first() for k in key])
        .limit(n)
        .drop("_draw")
    )
