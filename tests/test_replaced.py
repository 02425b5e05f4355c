"""Tables replaced at once, and sketches as cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewright.operators.sketch_cube import distinct_error, rank_error, rolled_up, sketch_cells
from ratewright.sources.tables import _names, current, read_table, replace_table


def ids(df):
    return sorted(r["id"] for r in df.collect())


def folders(spark, path):
    return [n for n in _names(spark, path) if n.startswith("v")]


def test_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        read_table(spark, path)
    first = replace_table(spark.range(5), path)
    assert ids(first) == [0, 1, 2, 3, 4]
    # from the version it replaces, and with another schema
    second = replace_table(first.filter("id > 2").withColumn("x", F.lit("y")), path)
    assert ids(second) == [3, 4] and second.columns == ["id", "x"]
    assert ids(read_table(spark, path)) == [3, 4]
    assert len(folders(spark, path)) == 1 and len(_names(spark, f"{path}/_manifest")) == 1
    empty = replace_table(second.limit(0), path)
    assert empty.columns == ["id", "x"] and ids(empty) == []


def test_a_job_that_dies_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_table(spark.range(3), path)
    dying = spark.range(0, 100, 1, 4).withColumn("x", F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(1))
    with pytest.raises(Exception, match="lost"):
        replace_table(dying, path)
    assert ids(read_table(spark, path)) == [0, 1, 2]
    # the next writer puts its version in place and removes what the dead one left
    assert ids(replace_table(spark.range(4), path)) == [0, 1, 2, 3]
    assert len(folders(spark, path)) == 1


def test_a_manifest_that_is_not_whole_is_not_followed(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_table(spark.range(2), path)
    (tmp_path / "t" / "_manifest" / "00000002.json").write_text('{"number": 2, "fol')
    assert current(spark, path)["number"] == 1 and ids(read_table(spark, path)) == [0, 1]


def test_of_two_writers_one_stops(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_table(spark.range(2), path)
    (tmp_path / "t" / "_manifest" / "00000002.json").write_text('{"number": 2, "folder": "x"}'[:-3])
    with pytest.raises(Exception, match="[Ee]xist"):
        replace_table(spark.range(9), path)


def test_versions_kept(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 2, 3):
        replace_table(spark.range(n), path, keep=2)
    assert len(folders(spark, path)) == 2 and ids(read_table(spark, path)) == [0, 1, 2]


def test_sketches_roll_up(spark):
    dice = np.random.default_rng(4)
    n = 60_000
    rows = spark.createDataFrame(
        [(int(g), int(c), int(u), None if v % 97 == 0 else int(v)) for g, c, u, v in
         zip(dice.integers(0, 3, n), dice.integers(0, 40, n), dice.integers(0, 9000, n), dice.integers(0, 10**9, n))],
        "g int, c int, unit long, value long",
    )
    cells = sketch_cells(rows, ["g", "c"], "unit", "value")
    assert cells.count() == 120
    exact = rows.groupBy("g").agg(F.countDistinct("unit").alias("u"), F.count("*").alias("n")).collect()
    got = {r["g"]: r for r in rolled_up(cells, ["g"], {"median": 0.5, "p99": 0.99}).collect()}
    values = {}
    for r in rows.filter("value IS NOT NULL").collect():
        values.setdefault(r["g"], []).append(r["value"])
    for e in exact:
        r = got[e["g"]]
        assert r["n_establishments"] == e["n"] and abs(r["n_units"] - e["u"]) <= 4 * distinct_error() * e["u"]
        for name, p in (("median", 0.5), ("p99", 0.99)):
            assert abs(np.mean(np.array(values[e["g"]]) <= r[name]) - p) <= 3 * rank_error()
    whole = rolled_up(cells, [], {"median": 0.5}).collect()
    assert len(whole) == 1 and whole[0]["n_establishments"] == n
    # a group without values
    none = sketch_cells(rows.filter("value IS NULL"), ["g"], "unit", "value")
    assert [r["median"] for r in rolled_up(none, ["g"], {"median": 0.5}).collect()] == [None] * 3
