"""Ranks with ties over tables of any size, without a window over the whole table.

Equal values are counted first. The distinct values are dealt to partitions by range, and each
partition's rows are added up; a value's rank is the rows of the partitions before, the rows before
it in its own, and half of its ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ratewright.session import land


def value_ranks(values: DataFrame, column: str, count: str) -> DataFrame:
    """``column, rank`` of every distinct value of ``values`` (``column, count``): 1 for the
    smallest, ties sharing the mean of the places they take. NULL values are left out."""
    distinct = values.filter(F.col(column).isNotNull()).groupBy(column).agg(F.sum(count).alias("n"))
    # Landed, as a second look at a range partitioning may cut elsewhere.
    dealt = land(
        distinct.repartitionByRange(column).select(column, "n", F.spark_partition_id().alias("part")), "ranges"
    )
    # One row a partition.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = dealt.groupBy("part").agg(F.sum("n").alias("rows"))
    offsets = parts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("ahead"))
    upto = F.sum("n").over(W.partitionBy("part").orderBy(column))
    rank = F.col("ahead") + F.col("upto") - (F.col("n") - 1) / 2.0
    return dealt.withColumn("upto", upto).join(offsets, "part").select(column, rank.alias("rank"))


def rank_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ``rho`` between two columns over rows that have both, and ``n``.

    Rows of equal pairs are counted first, so a value that very many rows share is one row a
    partner value when ranks are joined on. Ranks are centred on their mean, which is known.
    """
    pairs = land(
        df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(F.col(a).alias("a"), F.col(b).alias("b"))
        .agg(F.count(F.lit(1)).alias("n")),
        "pairs",
    )
    ranks = {c: value_ranks(pairs.select(c, "n"), c, "n").withColumnRenamed("rank", f"rank_{c}") for c in ("a", "b")}
    rows = pairs.agg(F.sum("n").alias("rows"))
    x, y = (F.col(f"rank_{c}") - (F.col("rows") + 1) / 2.0 for c in ("a", "b"))
    n = F.col("n")
    sums = (
        pairs.join(ranks["a"], "a")
        .join(ranks["b"], "b")
        .crossJoin(F.broadcast(rows))
        .agg(
            F.sum(n * x * y).alias("xy"),
            F.sum(n * x * x).alias("xx"),
            F.sum(n * y * y).alias("yy"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        )
    )
    return sums.select(F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")).alias("rho"), "n")
