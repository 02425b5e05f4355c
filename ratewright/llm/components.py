"""Connected components by rounds of joins, each cut by a checkpoint in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import checkpoint_folder


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every end of ``edges`` (columns ``a, b``), the component being its
    smallest node.

    Each round links all larger neighbours of a node to the smallest (large star), then all
    smaller ones (small star), until nothing changes; the number of rounds grows with the
    logarithm of the longest path. Partial sums precede every shuffle and a node's neighbours
    are never gathered, so a node of very many links is no burden. Null ends are ignored.
    """
    checkpoint_folder(edges.sparkSession)
    now = (
        edges.where("a <> b")
        .select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a"))
        .distinct()
        .checkpoint()
    )
    before = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(lowest.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        now = small.checkpoint()
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
