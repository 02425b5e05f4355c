"""Packing: optimal length buckets, then batches of a token budget.

A text is cut into pieces of at most ``max_length`` words. The histogram of piece lengths has
at most ``max_length`` entries; dynamic programming over it finds the bucket boundaries that
pad least. Inside a bucket, pieces in a shuffled but fixed order fill batches whose padded
size stays within the budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ratewright.llm.common import land, small

MAX_LENGTH = 2048
BUCKETS = 8
BUDGET = 16_384
#: Rows that are numbered in one task.
SLICE_ROWS = 50_000


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t\n\x0B\f\r]+")))


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least padding in all; of equally
    good ones that with the smaller boundaries, the last compared first."""
    if not lengths:
        return []
    order = np.argsort(lengths)
    x, c = np.array(lengths, np.int64)[order], np.array(counts, np.int64)[order]
    n, k = len(x), min(buckets, len(x))
    some, mass = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    chosen = []
    for _ in range(k):
        now, back = np.full(n + 1, np.iinfo(np.int64).max // 4), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + x[j - 1] * (some[j] - some[:j]) - (mass[j] - mass[:j])
            back[j] = int(np.argmin(cost))
            now[j] = cost[back[j]]
        chosen.append(back)
        best = now
    ends, j = [], n
    for back in reversed(chosen):
        ends.append(int(x[j - 1]))
        j = back[j]
    return ends[::-1]


def pack(
    docs: DataFrame, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET
) -> DataFrame:
    """``doc_id, piece, n_words, bucket_length, batch`` for every piece of every text.

    Pieces of one text are numbered from 0. A null, empty or blank text is one piece of no
    words, in the bucket that fits it. ``batch`` counts from 0 inside a bucket; a batch holds
    ``budget // bucket_length`` pieces (at least one), the last may hold fewer. Pieces are
    ordered by the MD5 of document and piece, then document (null first), then piece. Equal
    rows (one doc_id and word count) are interchangeable, each is numbered. An empty table
    gives no rows. Other columns of ``docs`` are ignored.
    """
    words = land(docs.select("doc_id", word_count(F.col("text")).cast("long").alias("words")), "lengths")
    last = F.greatest(F.lit(0), F.ceil(F.col("words") / max_length) - 1)
    cut = words.select("doc_id", "words", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("piece")).select(
        "doc_id",
        "piece",
        F.least(F.lit(max_length).cast("long"), F.col("words") - F.col("piece") * max_length).alias("n_words"),
    )
    histogram = cut.groupBy("n_words").count().collect()  # at most max_length + 1 rows
    ends = boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    total = sum(r[1] for r in histogram)
    spark = docs.sparkSession
    if not ends:
        return cut.select("doc_id", "piece", "n_words", F.lit(0).cast("long").alias("bucket_length"), F.lit(0).cast("long").alias("batch"))

    fits = F.lit(ends[-1])
    for end in reversed(ends[:-1]):
        fits = F.when(F.col("n_words") <= end, end).otherwise(fits)
    # so many hexadecimal digits of the order's MD5 that a slice stays small at any size
    digits = max(1, int(np.ceil(np.log(max(total, 1) / SLICE_ROWS) / np.log(16))) if total > SLICE_ROWS else 1)
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("#"), F.col("piece").cast("string")))
    placed = cut.withColumn("bucket_length", fits.cast("long")).withColumn("digest", digest).withColumn(
        "slice", F.substring("digest", 1, digits)
    )
    # pieces of one document and number are equal in the order; a hot doc_id is spread by nothing
    # else, so they are counted and numbered as a run
    runs = placed.groupBy("bucket_length", "slice", "digest", "doc_id", "piece", "n_words").count()
    sizes = runs.groupBy("bucket_length", "slice").agg(F.sum("count").alias("held"))
    before = sizes.select(
        "bucket_length",
        "slice",
        (F.sum("held").over(W.partitionBy("bucket_length").orderBy("slice")) - F.col("held")).alias("before"),
    )
    inside = W.partitionBy("bucket_length", "slice").orderBy("digest", F.asc_nulls_first("doc_id"), "piece", "n_words")
    numbered = (
        runs.withColumn("first", F.sum("count").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("count"))
        .join(small(before), ["bucket_length", "slice"])
        .withColumn("first", F.col("first") + F.col("before"))
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    )
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_length"))))
    return numbered.select(
        "doc_id",
        "piece",
        "n_words",
        "bucket_length",
        F.floor((F.col("first") + F.col("i")) / per_batch).cast("long").alias("batch"),
    )
