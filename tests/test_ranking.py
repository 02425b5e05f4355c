"""Numbering, key matching and quantiles under heavy skew, against plain definitions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ratewright.functions.order_stats import bracketed, exact_quantiles, sketches, targets
from ratewright.functions.ranking import large_groups, numbered_in_group, rows_having_key


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under NULL, a sixth under one key; few distinct times, unique ids."""
    dice = random.Random(5)

    def key(i):
        return None if i % 3 == 0 else "hot" if i % 6 == 1 else f"k{i % 400}"

    rows = [(key(i), 1, dice.choice([None, 1, 2, 3]), i) for i in range(12_000)]
    return spark.createDataFrame(rows, "k string, period int, t int, id long").repartition(6).cache()


def test_large_groups_are_few(skewed):
    large = large_groups(skewed, ["k", "period"], slices=16, floor=100)
    assert {r["k"] for r in large.collect()} == {None, "hot"}


@pytest.mark.parametrize("slices,floor", [(16, 100), (400, 50), (12_000, 8), (32_768, 1_000_000)])
def test_numbers_equal_a_plain_window(skewed, slices, floor):
    order = W.partitionBy("k", "period").orderBy(F.col("t").desc_nulls_last(), F.col("id").desc())
    plain = skewed.withColumn("n", F.row_number().over(order)).select("id", "n")
    cut = numbered_in_group(
        skewed, ["k", "period"], [F.col("t"), F.col("id")], "n", slices=slices, floor=floor
    ).select("id", F.col("n").cast("int").alias("n"))
    assert cut.exceptAll(plain).count() == 0 and cut.count() == plain.count()


def test_key_matching_equals_a_semi_join(skewed):
    wanted = skewed.groupBy("k").count().filter("count > 1").select("k")
    plain = skewed.join(wanted, "k", "left_semi")
    split = rows_having_key(skewed, ["k"], wanted, slices=16, floor=100)
    assert split.exceptAll(plain).count() == 0 and split.count() == plain.count()
    counted = skewed.groupBy("k").agg(F.count("*").alias("_rows")).filter("_rows > 1")
    again = rows_having_key(skewed, ["k"], wanted, slices=16, floor=100, sizes=counted)
    assert again.exceptAll(plain).count() == 0 and again.count() == plain.count()


@pytest.mark.parametrize("most", [30, 4_000_000])
def test_quantiles(spark, most):
    """With small brackets, further scans narrow them first."""
    dice = np.random.default_rng(3)
    heavy = [7] * 30_000
    wide = [int(x) for x in dice.integers(-(10**12), 10**12, 60_000)]
    part = [float(x) for x in dice.normal(0, 1, 90_000)]
    rows = [(a, b, c) for a, b, c in zip(heavy + wide, wide + heavy, part)] + [(None, None, None)] * 5
    df = spark.createDataFrame(rows, "a long, b long, c double").repartition(5)
    probabilities = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = exact_quantiles(df, ["a", "b"], probabilities, most) | exact_quantiles(df, ["c"], probabilities, most)
    assert len(got) == 18
    for (name, p), value in got.items():
        column = [x["abc".index(name)] for x in rows if x[0] is not None]
        assert value == pytest.approx(np.quantile(column, p), rel=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 11, 257, 20_001])
def test_quantiles_of_few_values(spark, n):
    values = [int(x) for x in np.random.default_rng(n).permutation(n)]
    df = spark.createDataFrame([(v,) for v in values], "a int")
    probabilities = [0.0, 0.001, 0.25, 0.5, 0.75, 0.9, 1.0]
    for (_, p), value in exact_quantiles(df, ["a"], probabilities).items():
        assert value == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_quantiles_of_extremes(spark):
    df = spark.createDataFrame([(-(2**63),), (2**63 - 1,), (0,)], "a long")
    got = exact_quantiles(df, ["a"], [0.0, 0.5, 1.0])
    assert got == {("a", 0.0): float(-(2**63)), ("a", 0.5): 0.0, ("a", 1.0): float(2**63 - 1)}


def test_column_without_values_has_no_quantile(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "a long, b long")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {("b", 0.5): 1.5}


def test_second_scan_shuffles_the_bracket_only(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(200_000).selectExpr("pmod(xxhash64(id), 1000000007) as a").write.parquet(path)
    df = spark.read.parquet(path)
    first = df.agg(*sketches(df, ["a"], [0.5, 0.9]))
    sought = targets(first.first(), ["a"], [0.5, 0.9])
    second = bracketed(df, "bigint", sought)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (first, second)]
    assert [p.count("FileScan") for p in plans] == [1, 1]
    assert sum(len(re.findall(r"(?<!Reused)Exchange ", p)) for p in plans) <= 3
    inside = df.filter(F.col("a").between(sought[0].low, sought[0].high)).count()
    assert inside <= 200_000 * 6 / 10_000
