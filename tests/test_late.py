"""Late filings folded in, roll-ups from the cube, and ranks over many rows, against recomputing."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import EDGES, edge_frame, row

from ratewright.functions.many_ranks import rank_correlation, value_ranks
from ratewright.operators import late
from ratewright.operators.lattice import cube_lattice
from ratewright.plans.publish import establishment_study
from ratewright.sources.contract import RAW_SCHEMA

BY = ["sector", "size_band", "size_order", "state"]


@pytest.fixture(scope="module")
def study(spark):
    return establishment_study(spark)


def cells(df):
    return sorted(map(str, df.collect()))


def folded(spark, study, batches):
    """Fold batch after batch into what the first gives."""
    r, lim, lookup = study.roles, study.limits, study.lookup
    frames = [spark.createDataFrame(b, RAW_SCHEMA) for b in batches]
    winners = late.latest(frames[0], r)
    cube = late.standing_cube(winners, r, lim, lookup, BY)
    for batch in frames[1:]:
        out = late.fold(winners, cube, batch, r, lim, lookup, BY)
        winners, cube = out.winners, out.cube
    return winners, cube


def recomputed(spark, study, rows):
    staged = study.stage(spark.createDataFrame(rows, RAW_SCHEMA))
    return staged.filter("submission_rank = 1"), study.cube(study.clean(staged))


FIRST = [
    row(1, establishment_id="A"),
    row(2, establishment_id="B"),
    row(3, establishment_id="C"),
    row(4, establishment_id="D", total_hours_worked=None),
    row(5, establishment_id="E", state="VT"),
    row(6, establishment_id=None),
    row(7, establishment_id="G", created_timestamp="soon"),
]
CHANGES = {
    "newer of the same cell": [row(11, establishment_id="A", created_timestamp="3/1/2026", total_dafw_cases=4)],
    "older changes nothing": [row(12, establishment_id="A", created_timestamp="1/1/2026", total_dafw_cases=4)],
    "moves to another group": [row(13, establishment_id="B", created_timestamp="3/1/2026", naics_code=221111)],
    "moves to another band": [row(14, establishment_id="B", created_timestamp="3/1/2026", annual_average_employees=150,
                                  total_hours_worked=300_000)],
    "now dropped": [row(15, establishment_id="C", created_timestamp="3/1/2026", total_hours_worked=10)],
    "no longer dropped": [row(16, establishment_id="D", created_timestamp="3/1/2026")],
    "last of its cell": [row(17, establishment_id="E", created_timestamp="3/1/2026")],
    "without a unit": [row(18, establishment_id=None, created_timestamp="3/1/2026", total_deaths=1)],
    "new unit, filed twice": [row(19, establishment_id="N"), row(20, establishment_id="N", created_timestamp="3/1/2026")],
    "another period": [row(21, establishment_id="A", year_filing_for=2024, created_timestamp="3/1/2026")],
    "date beats none": [row(22, establishment_id="G", created_timestamp="1/1/2020", total_dafw_cases=2)],
    "tie by id": [row(23, establishment_id="A", total_dafw_cases=2)],
    "nothing": [],
}


UNIT = RAW_SCHEMA.fieldNames().index("establishment_id")


def of_case(name, rows):
    """The rows with units of the case's own; those without a unit are in one case only."""
    named = [(*r[:UNIT], f"{name}/{r[UNIT]}", *r[UNIT + 1 :]) for r in rows if r[UNIT] is not None]
    return named + ([r for r in rows if r[UNIT] is None] if name == "without a unit" else [])


def test_one_batch(spark, study):
    """Every change at once, each on units of its own."""
    first = [r for name in CHANGES for r in of_case(name, FIRST)]
    batch = [r for name, rows in CHANGES.items() for r in of_case(name, rows)]
    winners, cube = folded(spark, study, [first, batch])
    whole, cube_of_all = recomputed(spark, study, first + batch)
    assert cells(winners) == cells(whole.select(*winners.columns))
    assert cells(cube.select(*cube_of_all.columns)) == cells(cube_of_all)


def test_last_of_a_cell_and_an_empty_batch(spark, study):
    moved = [row(13, establishment_id="E", created_timestamp="3/1/2026")]
    only = [row(5, establishment_id="E", state="VT"), row(1, establishment_id="A")]
    winners, cube = folded(spark, study, [only, [], moved])
    assert {r["state"] for r in cube.collect()} == {"ME"} and winners.count() == 2


def test_several_batches(spark, study):
    rows = [values for values, _ in EDGES.values()]
    batches = [FIRST, [r for change in CHANGES.values() for r in change][:6], rows]
    winners, cube = folded(spark, study, batches)
    whole, cube_of_all = recomputed(spark, study, [r for b in batches for r in b])
    assert cells(winners) == cells(whole.select(*winners.columns))
    assert cells(cube.select(*cube_of_all.columns)) == cells(cube_of_all)


def test_lattice(spark, study):
    clean = study.clean(study.stage(edge_frame(spark)))
    cube = study.cube(clean).withColumn("state", F.when(F.col("size_order") > 1, F.col("state")))  # a group that is NULL
    found = cube_lattice(cube, {"sector": ["sector"], "band": ["size_band", "size_order"], "state": ["state"]})
    got = {(r["grouping_id"], r["sector"], r["size_band"], r["state"]): r["total_cases"] for r in found.collect()}
    want = {}
    for r in cube.collect():
        for number in range(8):
            key = tuple(None if number >> i & 1 else r[c] for i, c in ((2, "sector"), (1, "size_band"), (0, "state")))
            want[number, *key] = want.get((number, *key), 0) + r["total_cases"]
    assert got == want and found.count() == len(want)
    assert cube_lattice(cube.limit(0), {"sector": ["sector"]}).count() == 0
    assert "FileScan parquet" in found._jdf.queryExecution().executedPlan().toString()


def test_ranks_with_ties(spark):
    dice = np.random.default_rng(8)
    a = [7] * 800 + [int(x) for x in dice.integers(-50, 5000, 2500)]
    b = [float(x) for x in dice.normal(0, 1, 2500).round(2)] + [0.5] * 800
    df = spark.createDataFrame([*zip(a, b), (None, 1.0), (3, None)], "a long, b double").repartition(6)
    r = rank_correlation(df, "a", "b").first()

    def ranks(values):
        values = np.array(values)
        return np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])

    assert r["n"] == 3300 and r["rho"] == pytest.approx(np.corrcoef(ranks(a), ranks(b))[0, 1], abs=1e-12)
    ones = df.filter("a IS NOT NULL").groupBy("a").count()
    found = {x["a"]: x["rank"] for x in value_ranks(ones, "a", "count").collect()}
    assert found == dict(zip([*a, 3], ranks([*a, 3])))
    empty = rank_correlation(df.limit(0), "a", "b").first()
    assert empty["rho"] is None and empty["n"] == 0
