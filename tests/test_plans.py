"""What the physical plans must and must not do."""

import re

import pytest

from ratewright.plans.registered import QUERIES, Tables
from ratewright.sources.observations import observations

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text: str) -> list[set[str]]:
    """Columns each scan reads."""
    found = re.findall(r"FileScan parquet \[([^\]]*)\]", text)
    return [{c.split("#")[0] for c in one.split(",")} for one in found]


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan(build(spark, FOLDER)) for name, build in QUERIES.items()}


def test_no_cartesian_product_and_no_python(plans):
    for name, text in plans.items():
        assert not re.search("CartesianProduct|Python|Pandas|Arrow", text), name


def test_rows_are_never_gathered_in_one_partition(plans):
    """Single-partition exchanges follow an aggregate or a limit, never a bare scan."""
    for name, text in plans.items():
        lines = text.splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                below = " ".join(lines[i + 1 : i + 14])
                assert re.search(r"Aggregate|Limit|TakeOrdered|LocalTableScan", below), (name, line)


def test_results_read_only_their_columns(plans):
    measures = {"workers", "exposure", "c1", "c2", "deaths", "recordable_cases"}
    assert scans(plans["overall_rates"]) == [measures]
    assert scans(plans["sector_two_rankings"]) == [measures | {"grp"}]
    assert scans(plans["ols_fixed_effects"]) == [{"trir", "workers", "grp"}]
    assert scans(plans["waterfall"]) == [{"drop_step"}]


def test_filters_reach_the_scan(plans):
    dropped = plans["examples_per_step"]
    assert "PushedFilters: [IsNotNull(drop_step)]" in dropped


def test_audit_makes_one_pass_and_one_over_the_identifier(spark):
    tables = Tables.of(spark, FOLDER)
    read = scans(plan(tables.study.audit(tables.raw)))
    assert {"unit_id"} in read and sorted(map(len, read)) == [1, 10]
    assert "BroadcastHashJoin" in plan(tables.prepared)


def test_one_scan_per_result(plans):
    for name in (
        "waterfall", "overall_rates", "sector_two_rankings", "size_band_rates", "state_top10",
        "largest_row_sensitivity", "null_profile", "ols_fixed_effects", "mix_table",
        "ownership_split", "post_clean_ranges", "gradient_summary", "torn_records",
    ):
        assert len(scans(plans[name])) == 1, name


def test_examples_are_limited_before_the_shuffle(plans):
    assert plans["examples_per_step"].count("WindowGroupLimit") >= 2


def test_top_rows_are_not_sorted_whole(plans):
    for name in ("extreme_rows", "inspection_sample", "commonest_parses", "code_confusion"):
        assert "TakeOrderedAndProject" in plans[name], name


def test_staging_reads_narrow_columns_beside_the_rows(plans):
    """Beside the rows themselves, numbering reads only keys and sort columns."""
    keys = {"unit_id", "period"}
    order = keys | {"filed_txt", "part_id", "supp_id", "price", "quantity"}
    widest, *others = sorted(scans(plans["first_fail"]), key=len, reverse=True)
    assert order < widest
    assert all(one in (keys, order) for one in others)


def test_no_hand_broadcast_of_growing_tables(spark):
    logical = observations(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in logical
