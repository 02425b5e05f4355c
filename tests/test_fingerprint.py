"""Bags of rows by fingerprint: what adds up, and what is found."""

import pytest
from pyspark.sql import functions as F

from ratewright.functions.fingerprint import Bag, fingerprints, same_bags, union_of

COLUMNS = ["k", "a", "b", "x"]


@pytest.fixture(scope="module")
def rows(spark):
    text = F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), (F.col("id") % 50).cast("string")))
    return spark.range(3000).select(
        F.col("id").alias("k"), text.alias("a"), F.reverse(text).alias("b"), (F.col("id") % 11 / 3.0).alias("x")
    )


def same(one, other):
    tables = [fingerprints(one, {"one": Bag(COLUMNS)}), fingerprints(other, {"other": Bag(COLUMNS)}, dict(one.dtypes))]
    return same_bags(tables, {"c": (F.col("one"), F.col("other"))}).first()["same_rows"]


def test_order_and_layout_do_not_matter(rows):
    assert same(rows, rows.repartition(7, "x").orderBy(F.rand(3)))
    assert same(rows, rows.withColumn("k", F.col("k").cast("int")))  # compared in one type


@pytest.mark.parametrize(
    "change",
    [
        lambda df: df.filter("k <> 17"),
        lambda df: df.unionByName(df.filter("k = 17")),
        # one row for another, count and sum of k kept
        lambda df: df.withColumn("k", F.expr("CASE k WHEN 10 THEN 11 WHEN 13 THEN 12 ELSE k END")),
        # values change places between columns, or with a NULL
        lambda df: df.withColumns({"a": F.expr("if(k = 15, b, a)"), "b": F.expr("if(k = 15, a, b)")}),
        lambda df: df.withColumns({"a": F.expr("if(k = 1, NULL, a)"), "b": F.expr("if(k = 1, concat(a, b), b)")}),
        lambda df: df.withColumn("x", F.expr("if(k = 4, x + 1e-12D, x)")),
        # values of two rows of one column change places
        lambda df: df.withColumn("a", F.expr("CASE k WHEN 1 THEN 't2' WHEN 2 THEN 't1' ELSE a END")),
    ],
)
def test_every_change_is_found(rows, change):
    assert not same(rows, change(rows))


def test_parts_add_up(rows):
    odd = F.col("k") % 2 == 1
    table = fingerprints(rows, {"all": Bag(COLUMNS), "odd": Bag(COLUMNS, odd), "even": Bag(COLUMNS, ~odd)})
    found = same_bags([table], {"c": (union_of(F.col("odd"), F.col("even")), F.col("all"))}).first()
    assert found["same_rows"] and found["n_part"] == 3000


def test_no_rows(rows):
    none = rows.limit(0)
    assert same(none, none) and not same(none, rows)


def test_one_scan_a_table(rows):
    table = fingerprints(rows, {"all": Bag(COLUMNS), "odd": Bag(["k"], F.col("k") % 2 == 1)})
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1
