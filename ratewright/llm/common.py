"""Helpers the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.session import new_shared_path

#: A table is broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 100_000

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def land(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    spark = df.sparkSession
    path = new_shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint_folder(spark: SparkSession) -> None:
    """Make sure that ``checkpoint()`` has the shared folder the session names."""
    new_shared_path(spark, "probe")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character left. Most texts have no letter on which
    the fast ``lower`` could differ."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())
    )


def text_key(text: Column) -> Column:
    """Tells rows with one doc_id and different texts apart."""
    return F.xxhash64(text)


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """Texts as UTF-8, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def pieces(batches: Iterable[pa.RecordBatch], most_bytes: int, column: str) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each hold ``most_bytes`` or are one text."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        total, start = 0, 0
        lengths = pc.binary_length(batch.column(at)).to_pylist()
        for i, n in enumerate(lengths):
            if total and total + (n or 0) > most_bytes:
                yield batch.slice(start, i - start)
                total, start = 0, i
            total += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def fresh(label: str) -> str:
    """A column name that no caller's table has."""
    return f"__{label}_{uuid.uuid4().hex[:12]}"
