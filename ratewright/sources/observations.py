"""Observation table from the order tables: one row per order line, in the roles of the raw fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIXES = [("1", "first"), ("2", "first"), ("3", "third"), ("4", "fourth")]


def prefix_lookup_table(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(PREFIXES, "sector_code string, sector string"))


def _true(condition: Column) -> Column:
    """NULL as false."""
    return F.coalesce(condition, F.lit(False))


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Inner joins on the parents' keys. Join strategy is left to the optimizer, which knows
    the sizes; only the fixed prefix list is broadcast by hand."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    customers = table("customer").join(
        table("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    orders = table("orders").join(
        customers.select("c_custkey", "c_mktsegment", "n_name"),
        F.col("o_custkey") == F.col("c_custkey"),
    )
    quantity = F.col("quantity")
    tens = F.floor(quantity / 10).cast("bigint")
    size = F.col("p_size").cast("bigint")
    # what a line's taxes, flags and dates come down to, so that joins move no more than that
    narrow = table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        "l_shipdate",
        _true((F.col("l_tax") == 0) & (F.col("l_discount") == 0)).alias("priced"),
        _true(F.col("l_linestatus") == "O").alias("open"),
        _true(F.col("l_returnflag") == "A").alias("accepted"),
        _true((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.095)).alias("died"),
    )
    lines = narrow.join(
        orders.select(
            "o_orderkey",
            F.year("o_orderdate").cast("bigint").alias("period"),
            "o_orderpriority",
            F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("owner_code"),
            "n_name",
        ),
        F.col("l_orderkey") == F.col("o_orderkey"),
    ).join(table("part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit_id"),
        "period",
        F.date_format("l_shipdate", "M/d/yyyy").alias("filed_txt"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supp_id"),
        "price",
        "quantity",
        F.col("p_brand").alias("grp"),
        F.col("n_name").alias("region_grp"),
        "owner_code",
        F.col("o_orderpriority").alias("code"),
        F.when(size == 2, 0).when(size == 1, F.lit(None)).otherwise(size).cast("bigint").alias("workers"),
        F.when(F.col("priced"), F.lit(None)).otherwise(F.round("price")).cast("bigint").alias("exposure"),
        (F.col("l_linenumber") - 1).cast("bigint").alias("c1"),
        F.when(F.col("open"), tens).otherwise(0).cast("bigint").alias("c2"),
        F.when(F.col("accepted"), F.when(quantity <= 5, F.lit(-1)).otherwise(0))
        .otherwise(tens).cast("bigint").alias("c3"),
        F.when(F.col("died"), 1).otherwise(0).cast("bigint").alias("deaths"),
        F.when(F.pmod("l_suppkey", F.lit(10)) == 0, 2)
        .when(F.pmod("l_partkey", F.lit(7)) == 0, 3)
        .when(size < 10, 1).when(size < 25, 21).when(size < 40, 22).otherwise(3)
        .cast("bigint").alias("size_code"),
        F.when(F.pmod("l_partkey", F.lit(11)) == 0, 2).otherwise(1).cast("bigint").alias("none_flag"),
    )


OBSERVATION_SCHEMA = T.StructType(
    [
        T.StructField("unit_id", T.LongType()),
        T.StructField("period", T.LongType()),
        T.StructField("filed_txt", T.StringType()),
        T.StructField("part_id", T.LongType()),
        T.StructField("supp_id", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("quantity", T.LongType()),
        T.StructField("grp", T.StringType()),
        T.StructField("region_grp", T.StringType()),
        T.StructField("owner_code", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("workers", T.LongType()),
        T.StructField("exposure", T.LongType()),
        T.StructField("c1", T.LongType()),
        T.StructField("c2", T.LongType()),
        T.StructField("c3", T.LongType()),
        T.StructField("deaths", T.LongType()),
        T.StructField("size_code", T.LongType()),
        T.StructField("none_flag", T.LongType()),
    ]
)
