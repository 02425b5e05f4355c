"""Hand-built rows of the raw file, one per edge."""

from ratewright.sources.contract import RAW_SCHEMA

NAMES = RAW_SCHEMA.fieldNames()

PLAIN = {
    "establishment_name": "somewhere",
    "company_name": "someone",
    "state": "ME",
    "naics_code": 311111,
    "establishment_type": 1,
    "size": 21,
    "annual_average_employees": 50,
    "total_hours_worked": 100_000,
    "no_injuries_illnesses": 1,
    "total_deaths": 0,
    "total_dafw_cases": 1,
    "total_djtr_cases": 1,
    "total_other_cases": 1,
    "created_timestamp": "2/27/2026",
    "year_filing_for": 2025,
}


def row(number: int, **changes):
    values = {"id": number, "establishment_id": f"E{number}", **PLAIN, **changes}
    return tuple(values.get(name) for name in NAMES)


# name -> (row, step it is dropped at, None if kept)
EDGES = {
    "plain": (row(1), None),
    "period NULL": (row(2, year_filing_for=None), 1),
    "period wrong": (row(3, year_filing_for=2024), 1),
    "older filing": (row(4, establishment_id="D1", created_timestamp="2/27/2026"), 2),
    "newer filing": (row(5, establishment_id="D1", created_timestamp="03/01/2026"), None),
    "unparsable, lower id": (
        row(6, establishment_id="D2", created_timestamp="the day after"), 2,
    ),
    "unparsable, higher id": (
        row(7, establishment_id="D2", created_timestamp="no day at all"), None,
    ),
    "unparsable loses to a date": (row(9, establishment_id="D3", created_timestamp="soon"), 2),
    "date beats higher id": (row(8, establishment_id="D3", created_timestamp="1/1/2026"), None),
    "unit NULL, older": (row(10, establishment_id=None, created_timestamp="1/1/2026"), 2),
    "unit NULL, newer": (row(11, establishment_id=None, created_timestamp="1/2/2026"), None),
    "hours NULL": (row(12, total_hours_worked=None), 3),
    "hours 0": (row(13, total_hours_worked=0), 3),
    "hours 999": (row(14, total_hours_worked=999, annual_average_employees=5), 3),
    "hours 1000": (row(15, total_hours_worked=1000, annual_average_employees=5), None),
    "employees NULL": (row(16, annual_average_employees=None), 4),
    "employees 0": (row(17, annual_average_employees=0), 4),
    "employees negative": (row(18, annual_average_employees=-3), 7),
    "code NULL": (row(19, naics_code=None), 5),
    "code of five digits": (row(20, naics_code=31111), 5),
    "code unknown": (row(21, naics_code=999999), 5),
    "cases NULL": (row(22, total_djtr_cases=None), 6),
    "cases negative": (row(23, total_other_cases=-1), 6),
    "deaths negative": (row(24, total_deaths=-1), 6),
    "cases equal employees": (row(25, total_dafw_cases=48), None),
    "cases one over": (row(26, total_dafw_cases=49), 7),
    "ratio 99.9": (row(27, annual_average_employees=1000, total_hours_worked=99_900), 8),
    "ratio 100": (row(28, annual_average_employees=1000, total_hours_worked=100_000), None),
    "ratio 5000": (row(29, annual_average_employees=10, total_hours_worked=50_000), None),
    "ratio 5000.1": (row(30, annual_average_employees=10, total_hours_worked=50_001), 8),
    "fails 3, 4 and 7": (
        row(31, total_hours_worked=10, annual_average_employees=0, total_dafw_cases=99), 3,
    ),
    "no cases": (
        row(32, total_dafw_cases=0, total_djtr_cases=0, total_other_cases=0, no_injuries_illnesses=2),
        None,
    ),
    "legacy size": (row(33, size=2), None),
    "size NULL": (row(34, size=None), None),
    "size unknown": (row(35, size=7), None),
    "owner 0": (row(36, establishment_type=0), None),
    "owner NULL": (row(37, establishment_type=None), None),
    "left half": (
        tuple(
            {"id": 38, "establishment_name": "torn", "establishment_id": "E38"}.get(n) for n in NAMES
        ),
        1,
    ),
    "right half": (
        tuple(
            {"establishment_name": "Old Harbour", "establishment_id": "TX",
             "total_skin_disorders": "half past nine", "total_hearing_loss": "Manufacturing",
             "total_other_illnesses": "06854"}.get(n)
            for n in NAMES
        ),
        1,
    ),
}


def edge_frame(spark):
    return spark.createDataFrame([values for values, _ in EDGES.values()], RAW_SCHEMA)
