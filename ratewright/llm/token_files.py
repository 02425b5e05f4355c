"""Token files: Parquet with one list of ids a document, cut for selective reads.

A folder holds ``data`` and ``manifest``. ``data`` is in ascending order of doc_id: rows
``doc_id, part, place, n_tokens, ids``, where ``part`` numbers the range of doc_ids a task wrote
and ``place`` counts the ids of that part before the row. Ids are dictionary-encoded, and delta
where a row group has too many different ones; the other columns are delta-encoded. Row groups
and pages have set sizes, and every column has a page index, so that a filter on doc_id or place
reads only the pages it needs, and a read without ``ids`` reads no token. ``manifest`` holds one
row a part, with ``base``, the ids of all parts before it; it is written last, so a folder
without it is not complete.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ratewright.llm.byte_bpe import loaded
from ratewright.llm.common import pieces, small, text_key

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 1000
#: Bytes of text of which each different word is encoded once.
BATCH_BYTES = 8 << 20


def encode(docs: DataFrame, vocabulary: str, end: int | None, files: int | None = None) -> DataFrame:
    """``doc_id, part, place, n_tokens, ids`` in ascending order of doc_id, nulls first.

    Rows of one doc_id are ordered by a hash of the text, then as the input lies. The range
    partitions are cut through equal doc_ids, so one that very many rows share spreads too.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        bpe = loaded(shared.value, True)
        for batch in pieces(batches, BATCH_BYTES, "text"):
            ends, ids = bpe.encode_all(batch.column(1), end)
            counts = np.diff(ends, prepend=0)
            rows = len(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(rows, part, np.int32)),
                    pa.array(place + ends - counts),
                    pa.array(counts),
                    pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), ids),
                ],
                names=["doc_id", "part", "place", "n_tokens", "ids"],
            )
            place += int(ends[-1]) if rows else 0

    order = [F.col("doc_id").asc_nulls_first(), "tie", "row"]
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("tie")).withColumn(
        "row", F.monotonically_increasing_id()
    )
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        dealt.sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(run, f"doc_id {kind}, part int, place long, n_tokens long, ids array<int>")
    )


def write(
    docs: DataFrame,
    vocabulary: str,
    path: str,
    end: int | None = 0,
    files: int | None = None,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Encode every text by the vocabulary file and write the token files to ``path``.

    ``end`` is appended to every document, none if None. A null text counts as empty; null and
    repeated doc_ids keep a row each; other columns are ignored; an empty table gives an empty
    data folder and an empty manifest. Special strings in a text become their ids.
    """
    data = f"{path}/data"
    (
        encode(docs, vocabulary, end, files)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(PAGE_BYTES))
        .option("parquet.page.row.count.limit", str(page_rows))
        .parquet(data)
    )
    parts = (
        docs.sparkSession.read.parquet(data)
        .groupBy("part")
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.sum("n_tokens").alias("n_tokens"),
            F.min("doc_id").alias("first_doc"),
            F.max("doc_id").alias("last_doc"),
        )
    )
    # One row a written partition, whatever the number of documents.
    before = F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts.withColumn("base", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``part, n_docs, n_tokens, first_doc, last_doc, base``."""
    return spark.read.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: ``start`` counts the ids of all documents before.

    A column not asked for is not read; a filter on doc_id reaches the page index.
    """
    base = small(manifest(spark, path).select("part", "base"))
    return spark.read.parquet(f"{path}/data").join(base, "part").select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids"
    )


def read_span(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """``doc_id, start, ids`` of the ids at places ``first`` to ``last`` (not included).

    Only parts that overlap the span are read, of them only pages of documents that can, and each
    document's list is cut to the span.
    """
    whole = manifest(spark, path)
    held = whole.filter((F.col("base") < last) & (F.col("base") + F.col("n_tokens") > first))
    ends = held.agg(F.min("part"), F.max("part")).first()
    if ends[0] is None:
        return read(spark, path).select("doc_id", "start", "ids").limit(0)
    base = small(held.select("part", "base"))
    inside = spark.read.parquet(f"{path}/data").filter(F.col("part").between(*ends)).join(base, "part")
    start = F.col("base") + F.col("place")
    low, high = F.greatest(start, F.lit(first)), F.least(start + F.col("n_tokens"), F.lit(last))
    return (
        inside.filter((start < last) & (start + F.col("n_tokens") > first))
        .select(
            "doc_id",
            low.alias("start"),
            F.slice("ids", (low - start + 1).cast("int"), (high - low).cast("int")).alias("ids"),
        )
    )


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` as the files say when read back; the crc32 is of the
    ids as little-endian unsigned 32-bit integers, and ``n_tokens`` counts the ids read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ends = ids.offsets.to_numpy()
            flat = ids.values.to_numpy().astype("<u4", copy=False)
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
                names=["doc_id", "part", "place", "n_tokens", "ids_crc32"],
            )

    data = spark.read.parquet(f"{path}/data").select("doc_id", "part", "place", "ids")
    kind = data.schema["doc_id"].dataType.simpleString()
    found = data.mapInArrow(run, f"doc_id {kind}, part int, place long, n_tokens long, ids_crc32 long")
    base = small(manifest(spark, path).select("part", "base"))
    return found.join(base, "part").select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )
