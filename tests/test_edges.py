"""Staging, audit and results on hand-built rows."""

import pytest
from pyspark.sql import functions as F
from rows import EDGES, NAMES, edge_frame, row

from ratewright.operators import audit, composition, cube, profile, rates, rules
from ratewright.plans.publish import accounted, establishment_study
from ratewright.sources.contract import RAW_SCHEMA
from ratewright.plans.study import EXPORT_COLUMNS, WITHHELD_COLUMNS


@pytest.fixture(scope="module")
def study(spark):
    return establishment_study(spark)


@pytest.fixture(scope="module")
def raw(spark):
    return edge_frame(spark).cache()


@pytest.fixture(scope="module")
def staged(study, raw):
    return study.stage(raw).cache()


@pytest.fixture(scope="module")
def clean(study, staged):
    return study.clean(staged).cache()


def test_first_failing_rule(staged):
    key = lambda r: tuple(r[n] for n in NAMES)
    got = {key(r): r["drop_step"] for r in staged.collect()}
    wanted = {values: step for values, step in EDGES.values()}
    wrong = {
        name: (got[values], step) for name, (values, step) in EDGES.items() if got[values] != step
    }
    assert not wrong and len(got) == len(wanted)


def test_waterfall_adds_up(study, raw, staged):
    table = {r["step"]: r["rows_dropped"] for r in rules.waterfall(staged, study.limits.rules).collect()}
    steps = [step for _, step in EDGES.values()]
    assert table == {**{i: steps.count(i) for i in range(1, 9)}, 99: steps.count(None)}
    assert accounted(staged, raw, study).collect()[0]["matches"]


def test_strict_reconcile_raises(spark):
    one, two = spark.sql("SELECT 1 AS n"), spark.sql("SELECT 2 AS n")
    assert not rules.reconcile({"x": (one, two)}).collect()[0]["matches"]
    with pytest.raises(Exception, match="does not reconcile"):
        rules.reconcile({"x": (one, two)}, strict=True).collect()


def test_sector_of_many_prefixes(clean):
    assert {r["sector"] for r in clean.select("sector").distinct().collect()} == {"Manufacturing"}


def test_audit_counts(study, raw):
    got = {r["check_no"]: r["rows_failing"] for r in study.audit(raw).collect()}
    values = [dict(zip(NAMES, v)) for v, _ in EDGES.values()]
    hours = [v["total_hours_worked"] for v in values]
    workers = [v["annual_average_employees"] for v in values]
    assert got[1] == sum(v["year_filing_for"] != 2025 for v in values)
    ids = [v["establishment_id"] for v in values]
    assert got[2] == len(ids) - len({i for i in ids if i is not None})
    assert got[3] == hours.count(None)
    assert got[4] == sum(h is not None and h < 1000 for h in hours)
    assert got[5] == sum(w in (None, 0) for w in workers)
    assert got[6] == sum(v["naics_code"] in (None, 31111, 999999) for v in values)
    assert got[12] == 1

    def implied(w):
        return 1 if w < 20 else 21 if w < 100 else 22 if w < 250 else 3

    def disagrees(v):
        w, s = v["annual_average_employees"], v["size"]
        if w is None:
            return False
        return s not in (1, 2, 21, 22, 3) or (implied(w) not in (21, 22) if s == 2 else s != implied(w))

    assert got[11] == sum(map(disagrees, values))


def test_torn_halves(raw):
    found = profile.torn_records(raw, "id", ["state", "naics_code", "year_filing_for"])
    got = {r["condition"]: r["n_rows"] for r in found.collect()}
    assert got["id IS NULL"] == 1 and got["left half"] == 1 and got["either half"] == 2
    rows = profile.torn_rows(raw, "id", ["state", "naics_code", "year_filing_for"]).collect()
    assert sorted(r["half"] for r in rows) == ["left", "right"]


def test_uncastable(raw):
    bad = profile.uncastable_values(raw, "total_hearing_loss").collect()
    assert [(r["raw_value"], r["n"], r["n_total"]) for r in bad] == [("Manufacturing", 1, 1)]
    assert profile.uncastable_values(raw, "total_other_illnesses").count() == 0  # 06854 is a number
    odd = profile.nonmatching_values(raw, "total_skin_disorders", "^[0-9]+$").collect()
    assert [(r["raw_value"], r["len"]) for r in odd] == [("half past nine", 14)]


def test_texts_that_cast(spark):
    # What a lenient cast to BIGINT accepts and refuses.
    good = ["7", " 7 ", "\t7\n", "+5", "06854", "1.5", "1.", ".5", "-.5e2", "1e3", "1E3", "1_000",
            "9223372036854775807", "-9223372036854775808", "5e18"]
    bad = ["", "e3", "1e", "--5", "1 2", "1,000", "1.5.2", "1__0", "1._5", "inf", "nan", "true",
           "1e19", "1e40", "9223372036854775808", "half past nine"]
    df = spark.createDataFrame([(t,) for t in [*good, *bad, None]], "t string")
    found = {r["raw_value"] for r in profile.uncastable_values(df, "t").collect()}
    assert found == set(bad)


def test_parse_coverage(raw):
    r = audit.parse_coverage(raw, "created_timestamp").collect()[0]
    assert (r["n_fail"], r["n_null"]) == (3, 2)
    assert r["n_ok"] == r["n_rows"] - 5
    assert str(r["earliest"])[:10] == "2026-01-01" and str(r["latest"])[:10] == "2026-03-01"


def test_null_key_is_listed_but_matches_nothing(raw):
    keys = audit.duplicate_keys(raw, ["establishment_id"])
    assert {r["establishment_id"] for r in keys.collect()} == {"D1", "D2", "D3", None}
    rows = audit.duplicate_drilldown(raw, ["establishment_id"], ["id"]).collect()
    assert {r["id"] for r in rows} == {4, 5, 6, 7, 8, 9}


def test_band_edges(spark, study):
    sizes = [19, 20, 99, 100, 249, 250]
    rows = [row(i, annual_average_employees=w, total_hours_worked=w * 1000) for i, w in enumerate(sizes)]
    got = study.clean(study.stage(spark.createDataFrame(rows, RAW_SCHEMA))).select(
        "annual_average_employees", "size_order", "size_band"
    )
    assert [(r[1], r[2]) for r in got.orderBy("annual_average_employees").collect()] == [
        (1, "Under 20"), (2, "20-99"), (2, "20-99"), (3, "100-249"), (3, "100-249"), (4, "250+"),
    ]


def test_rows_without_cases_count(study, clean):
    r = study.overall(clean).collect()[0]
    assert r["n_zero_case_establishments"] == 1
    assert r["trir"] == r["total_cases"] * 200000.0 / r["total_hours"]


def test_unknown_owner(study, clean):
    split = {r["ownership"]: r["n_establishments"] for r in study.ownership(clean).collect()}
    assert split["4 unknown / not coded"] == 2


def groups(spark, study, counts):
    """Clean rows of made sectors: {industry code: (rows, deaths, cases)}."""
    rows, n = [], 0
    for code, (size, deaths, cases) in counts.items():
        for i in range(size):
            n += 1
            rows.append(
                row(n, naics_code=code, total_deaths=deaths if i == 0 else 0, total_dafw_cases=cases,
                    total_djtr_cases=0, total_other_cases=0)
            )
    return study.clean(study.stage(spark.createDataFrame(rows, RAW_SCHEMA)))


def test_thresholds_and_ties(spark, study):
    made = groups(
        spark, study,
        {311111: (29, 50, 2), 221111: (30, 9, 2), 236111: (30, 10, 1), 111111: (1, 0, 5)},
    )
    deaths = {r["sector"]: r for r in study.deaths(made).collect()}
    assert deaths["Manufacturing"]["note"] == "insufficient n"
    assert deaths["Utilities"]["note"] == "fewer than 10 deaths - too thin to rank"
    assert deaths["Construction"]["note"] == ""
    assert deaths["Agriculture, Forestry, Fishing and Hunting"]["deaths_per_100m_hours"] == 0.0
    ranked = {r["sector"]: r for r in study.ranked(made).collect()}
    assert ranked["Manufacturing"]["rank_by_rate"] == ranked["Utilities"]["rank_by_rate"] == 2
    assert ranked["Construction"]["rank_by_rate"] == 4
    assert ranked["Utilities"]["note"] == "" and ranked["Manufacturing"]["note"] == "insufficient n"
    small = rates.insufficient_groups(study.ranked(made), "sector").collect()
    assert len(small) == 2
    alone = {r["sector"]: r for r in study.sensitivity(made).collect()}
    one = alone["Agriculture, Forestry, Fishing and Hunting"]
    assert one["largest_row_pct_of_sector_hours"] == 100.0
    assert one["trir_excluding_largest_row"] is None and one["change_if_excluded"] is None


def test_target_lacks_a_group(spark, study):
    rows = [row(1), row(2, state="TX", naics_code=221111)]
    made = study.clean(study.stage(spark.createDataFrame(rows, RAW_SCHEMA)))
    mix = {r["sector"]: r for r in study.group_mix(made).collect()}
    assert mix["Utilities"]["me_hours"] == 0 and mix["Utilities"]["me_trir"] is None
    assert mix["Utilities"]["nat_trir"] is not None and len(mix) == 2


def test_standardising_on_everything_returns_the_overall_rate(spark, study):
    made = groups(spark, study, {311111: (5, 0, 2), 221111: (3, 0, 7)})
    found = composition.indirect_standardisation(
        study.group_mix(made), study.target_and_whole(made)
    ).collect()[0]
    assert found["expected_trir"] == pytest.approx(found["whole_trir"], rel=1e-12)
    assert found["gap"] == 0.0 and found["pct_of_gap_explained"] is None


def test_export_names_nobody(clean):
    assert not set(EXPORT_COLUMNS) & set(WITHHELD_COLUMNS)
    assert cube.clean_export(clean, EXPORT_COLUMNS, WITHHELD_COLUMNS).columns == EXPORT_COLUMNS
    with pytest.raises(ValueError):
        cube.clean_export(clean, ["company_name"], WITHHELD_COLUMNS)


def test_cube_gives_the_rates_of_the_rows(study, clean):
    direct = {r["sector"]: r["trir"] for r in study.ranked(clean).collect()}
    coarse = {r["sector"]: r["trir"] for r in cube.rollup_from_cube(study.cube(clean), ["sector"]).collect()}
    assert direct == coarse


def test_leaving_one_out_and_putting_it_back(study, clean):
    for r in study.sensitivity(clean).collect():
        total = clean.filter(F.col("sector") == r["sector"]).agg(F.sum("total_hours_worked")).collect()[0][0]
        rest = r["trir_excluding_largest_row"] * (total - r["largest_row_hours"]) / 200000.0
        assert (rest + r["largest_row_cases"]) * 200000.0 / total == pytest.approx(r["trir"])
