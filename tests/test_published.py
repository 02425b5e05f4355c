"""From published tables to published figures: what needs no raw file."""

import math

import published as P
import pytest
from pyspark.sql import functions as F

from ratewright.functions.frames import rank_descending
from ratewright.functions.student import central_quantile, with_two_sided_p
from ratewright.operators import compare, composition, cube, models, rates

BANDS = [name for name, *_ in P.BANDS]


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(s, n, h, k, d, 0) for (s, n, h, k, *_), d in zip(P.SECTORS, P.DEATHS)]
    return spark.createDataFrame(
        rows,
        "sector string, n_establishments long, total_hours long, total_cases long, deaths long, dart_cases long",
    )


@pytest.fixture(scope="module")
def ranked(cells):
    return (
        cube.rollup_from_cube(cells, ["sector"])
        .withColumns(
            {
                "rank_by_rate": rank_descending(F.col("trir")),
                "rank_by_count": rank_descending(F.col("total_cases")),
                "note": F.lit(""),
            }
        )
        .cache()
    )


@pytest.fixture(scope="module")
def overall(cells):
    whole = cells.withColumn("all", F.lit(1))
    return cube.rollup_from_cube(whole, ["all"])


def test_rates_and_ranks(ranked):
    got = {r["sector"]: r for r in ranked.collect()}
    for s, _, _, _, rate, by_rate, by_count in P.SECTORS:
        assert got[s]["trir"] == rate
        assert (got[s]["rank_by_rate"], got[s]["rank_by_count"]) == (by_rate, by_count)


def test_groups_add_up(overall):
    r = overall.collect()[0]
    assert (r["n_establishments"], r["total_hours"], r["total_cases"]) == (
        P.CLEAN_ROWS, P.CLEAN_HOURS, P.CLEAN_CASES,
    )
    assert r["trir"] == P.CLEAN_RATE
    assert sum(P.WATERFALL) == P.RAW_ROWS
    for table in (P.BANDS, P.OWNERSHIP):
        assert sum(t[3] for t in table) == P.CLEAN_CASES and sum(t[1] for t in table) == P.CLEAN_ROWS


def test_rank_agreement(ranked):
    r = compare.spearman(ranked, "rank_by_rate", "rank_by_count").collect()[0]
    assert r["rho"] == pytest.approx(P.RHO, rel=1e-13)
    assert r["p_value"] == pytest.approx(P.RHO_P, abs=5e-10) and r["n"] == 20


def test_top_five(ranked):
    rows = {r["sector"]: r["status"] for r in compare.topk_set_changes(ranked, "sector").collect()}
    assert {s for s, v in rows.items() if v == "both"} == {
        "Retail Trade", "Transportation and Warehousing",
    }
    assert {s for s, v in rows.items() if v == "count only"} == {
        "Health Care and Social Assistance", "Manufacturing", "Construction",
    }
    first = compare.top5_side_by_side(ranked, "sector").collect()[0]
    assert (first["by_rate"], first["trir"]) == ("Public Administration", 5.615)
    assert (first["by_count"], first["cases"]) == ("Health Care and Social Assistance", 333819)


def test_largest_falls(ranked):
    moves = compare.rank_moves(ranked, "sector").collect()
    assert (moves[0]["sector"], moves[0]["places_moved"]) == ("Construction", 10)
    assert (moves[1]["sector"], moves[1]["places_moved"]) == ("Manufacturing", 9)


def test_regions(spark):
    df = spark.createDataFrame(P.REGIONS, "state string, n_establishments long, rank_by_rate long, trir double")
    top = rates.state_top10(df, "state").collect()
    assert [r["state"] for r in top] == ["ME", "MT", "VT", "WA", "ID", "OR", "CT", "SD", "NV", "NH"]
    assert [r["rank_by_rate"] for r in top][:3] == [2, 5, 6]


def test_standardised_on_sector(spark, overall):
    rows = [(s, h, float(rate)) for (s, _, _, _, rate, *_), h in zip(P.SECTORS, P.TARGET_HOURS)]
    mix = spark.createDataFrame(rows, "sector string, me_hours long, nat_trir double")
    both = overall.select(F.lit(P.TARGET_RATE).alias("actual_trir"), F.col("trir").alias("whole_trir"))
    r = composition.indirect_standardisation(mix, both).collect()[0]
    assert round(r["expected_trir"], 3) == 3.538
    assert round(r["pct_of_gap_explained"], 1) == 2.3 and round(r["gap"], 3) == 2.767


def test_size_gradient(spark):
    rows = [(s[0], *b) for s, b in zip(P.SECTORS, P.BAND_RATES)]
    pivot = spark.createDataFrame(rows, "sector string, " + ", ".join(f"`{b}` double" for b in BANDS))
    shape = cube.gradient_shape(pivot, BANDS)
    r = cube.gradient_summary(shape, "sector").collect()[0]
    assert (r["n_groups"], r["n_falls"], r["n_monotonic"], r["n_other_way"]) == (20, 16, 8, 4)
    assert r["other_way"].startswith("Accommodation and Food Services, Arts")
    falls = {x["sector"]: x["fall_first_to_last"] for x in shape.collect()}
    assert falls["Public Administration"] == -1.88 and falls["Accommodation and Food Services"] == -1.03


def test_missing_band_is_neither(spark):
    pivot = spark.createDataFrame([("x", 3.0, None, 2.0, None)], "sector string, " + ", ".join(f"`{b}` double" for b in BANDS))
    r = cube.gradient_summary(cube.gradient_shape(pivot, BANDS), "sector").collect()[0]
    assert (r["n_falls"], r["n_monotonic"], r["n_other_way"], r["other_way"]) == (0, 0, 1, "")


def test_ownership(spark, overall):
    rows = [("All sectors", *r) for r in P.OWNERSHIP]
    split = spark.createDataFrame(
        rows,
        "scope string, ownership string, n_establishments long, total_hours long, total_cases long,"
        " trir double, pct_of_scope_hours double",
    )
    r = composition.subset_share_and_rate(
        split, "All sectors", ["2 state government", "3 local government"], "1 private", overall
    ).collect()[0]
    assert r["subset_pct_of_hours"] == 9.89 and round(r["rest_trir"], 3) == 3.453


def test_benchmark(overall):
    r = composition.external_benchmark(overall, 2.3).collect()[0]
    assert round(r["ratio"], 1) == 1.5 and round(r["difference"], 2) == 1.18


def test_averaging(spark):
    total = "ALL SECTORS (whole clean table)"
    rows = [
        (s[0], s[1], float(s[4]), 0.0, 0.0, s[5], m, m - s[5]) for s, m in zip(P.SECTORS, P.RANK_OF_MEAN)
    ]
    rows.append((total, P.CLEAN_ROWS, P.CLEAN_RATE, P.MEAN_OF_RATES, P.MEAN_OF_RATES - P.CLEAN_RATE, None, None, None))
    table = spark.createDataFrame(
        rows,
        "sector string, n_establishments long, trir_sum_then_divide double, trir_average_of_rates double,"
        " overstatement double, rank_sum_then_divide long, rank_average_of_rates long,"
        " places_moved_under_averaging long",
    )
    r = compare.averaging_summary(table, "sector", total).collect()[0]
    assert (r["n_moved"], r["n_groups"]) == (14, 20) and round(r["overstatement_pct"]) == 23
    moves = compare.averaging_moves(table, "sector", total).collect()
    assert (moves[0]["sector"], moves[0]["places_moved_under_averaging"]) == (
        "Other Services (except Public Administration)", -7,
    )


def test_concentration(spark):
    rows = [(s[0], p) for s, p in zip(P.SECTORS, P.LARGEST_ROW_PERCENT)]
    df = spark.createDataFrame(rows, "sector string, largest_row_pct_of_sector_hours double")
    r = compare.concentration_count(df).collect()[0]
    assert (r["n_over"], r["n_groups"]) == (12, 20)


def test_deaths(spark):
    rows = [
        (s[0], d, s[5], k, float(s[4]), 1e8 * d / s[2])
        for s, d, k in zip(P.SECTORS, P.DEATHS, P.DEATH_RANKS)
    ]
    df = spark.createDataFrame(
        rows,
        "sector string, deaths long, rank_by_trir long, rank_by_death_rate long, trir double,"
        " deaths_per_100m_hours double",
    )
    again = df.withColumn("again", rank_descending(F.col("deaths_per_100m_hours")))
    assert again.filter("again <> rank_by_death_rate").count() == 0
    moves = [(r["sector"], r["places_moved"]) for r in compare.deaths_rank_moves(df, "sector").collect()]
    assert moves[0] == ("Construction", 13) and moves[1] == ("Health Care and Social Assistance", -12)
    assert sum(d < 10 for d in P.DEATHS) == 7


def test_interval_and_p_of_the_slope(spark):
    dof = P.CLEAN_ROWS - 21
    error = (P.SLOPE_HIGH - P.SLOPE_LOW) / 2 / 1.959964
    one = spark.range(1).withColumn("t", central_quantile(0.95, F.lit(dof)))
    r = with_two_sided_p(one, F.lit(P.SLOPE / error), F.lit(dof), "p").collect()[0]
    assert P.SLOPE + r["t"] * error == pytest.approx(P.SLOPE_HIGH, abs=1e-7)
    assert r["p"] == pytest.approx(P.SLOPE_P, rel=2e-3)
    assert P.SLOPE * math.log(2) == pytest.approx(P.PER_DOUBLING, rel=1e-12)


def test_table_of_model_figures(spark):
    agreement = spark.createDataFrame([(P.RHO, P.RHO_P, 20)], "rho double, p_value double, n long")
    fit = spark.createDataFrame(
        [(P.CLEAN_ROWS, 20, P.SLOPE, 0.0114386, P.SLOPE_LOW, P.SLOPE_HIGH, P.SLOPE_P, 0.014975, P.PER_DOUBLING)],
        "n long, n_groups long, slope double, std_error double, ci_low double, ci_high double,"
        " p_value double, r_squared double, change_per_doubling double",
    )
    gradient = spark.createDataFrame(
        [(20, 16, 8, 4, "")], "n_groups long, n_falls long, n_monotonic long, n_other_way long, other_way string"
    )
    got = {r["statistic"]: (r["value"], r["detail"]) for r in models.model_stats(agreement, fit, gradient).collect()}
    assert len(got) == 9
    assert got["spearman_rho_rate_vs_count_rankings"] == (P.RHO, "p=0.000386913; n=20 sectors")
    assert got["ols_log_employees_coefficient"] == (P.SLOPE, "95% CI [-0.1976, -0.1527]; p=6.52e-53")
    assert got["sectors_u20_above_250plus"] == (16.0, "of 20 sectors")
    assert got["ols_n"] == (369996.0, "clean establishments")
