"""A study: a table's roles and limits bound to the operators."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.functions.ranking import FLOOR, SLICES
from ratewright.functions.values import banded
from ratewright.operators import audit, composition, count_model, cube, models, rates, rules
from ratewright.operators.audit import Check
from ratewright.operators import compare
from ratewright.roles import Band, Limits, Roles


@dataclass(frozen=True)
class Study:
    roles: Roles
    limits: Limits
    lookup: DataFrame
    slices: int = SLICES
    floor: int = FLOOR

    # raw -> staged -> clean

    def stage(self, raw: DataFrame) -> DataFrame:
        return rules.stage(raw, self.roles, self.limits, self.lookup, self.slices, self.floor)

    def clean(self, staged: DataFrame) -> DataFrame:
        return rules.clean(staged, self.roles, self.limits)

    # audit

    @cached_property
    def implied_code(self) -> Column:
        bands = self.limits.bands
        return banded(F.col(self.roles.workers), [b.below for b in bands[:-1]], [b.code for b in bands])

    def checks(self) -> list[Check]:
        """The twelve checks, over raw rows with measures and the looked-up name."""
        r, lim = self.roles, self.limits
        workers, exposure, code = F.col(r.workers), F.col(r.exposure), F.col(r.size_code)
        cases, flag = F.col("recordable_cases"), F.col(r.none_flag)
        per_worker = F.col("hours_per_employee")
        known = [b.code for b in lim.bands]
        agrees = F.when(code == lim.legacy_code, self.implied_code.isin(list(lim.legacy_covers))).otherwise(
            code.isin(known) & (code == self.implied_code)
        )
        tests = [
            rules.outside_period(r, lim),
            None,
            exposure.isNull(),
            exposure < lim.min_exposure,
            workers.isNull() | (workers == 0),
            F.col(r.code).isNull() | ~rules.well_formed_code(r, lim) | F.col("sector").isNull(),
            rules.bad_counts(r),
            cases > workers,
            ((flag == 2) & (cases > 0)) | ((flag == 1) & (cases == 0)),
            (per_worker > lim.max_ratio) | (per_worker < lim.min_ratio),
            workers.isNotNull() & (code.isNull() | ~agrees),
            code == lim.legacy_code,
        ]
        return [
            Check(i, text, test, None if test is not None else r.unit)
            for i, (text, test) in enumerate(zip(lim.checks, tests), start=1)
        ]

    def prepared(self, raw: DataFrame) -> DataFrame:
        """Raw rows with measures and looked-up name, for the audit."""
        r, lim = self.roles, self.limits
        return rules.prefix_lookup(
            rules.with_measures(raw, r), r.code, lim.prefix_length, self.lookup
        )

    def audit(self, raw: DataFrame) -> DataFrame:
        return audit.dq_audit(self.prepared(raw), self.checks())

    # results on the clean table

    def overall(self, clean: DataFrame) -> DataFrame:
        return rates.overall_rates(clean, self.roles)

    def ranked(self, clean: DataFrame) -> DataFrame:
        return rates.sector_two_rankings(clean, self.roles, self.limits.min_n)

    def bands(self, clean: DataFrame) -> DataFrame:
        return rates.size_band_rates(clean, self.roles, self.limits, self.limits.min_n)

    def regions(self, clean: DataFrame) -> DataFrame:
        return rates.state_rates(clean, self.roles, self.limits.min_n)

    def top_regions(self, clean: DataFrame) -> DataFrame:
        return rates.state_top10(self.regions(clean), self.roles.region, self.limits.min_n)

    def deaths(self, clean: DataFrame) -> DataFrame:
        return rates.deaths_rates(clean, self.roles, self.limits.min_n, self.limits.min_deaths)

    def averaging(self, clean: DataFrame) -> DataFrame:
        return compare.averaging_counterfactual(clean, self.roles, self.limits.total_label)

    def sensitivity(self, clean: DataFrame) -> DataFrame:
        return compare.largest_row_sensitivity(clean, self.roles)

    def ownership(self, clean: DataFrame) -> DataFrame:
        return composition.ownership_split(clean, self.roles, self.limits)

    def group_mix(self, clean: DataFrame) -> DataFrame:
        return composition.mix_table(clean, self.roles.group, self.roles, self.limits.target_region)

    def ownership_mix(self, clean: DataFrame) -> DataFrame:
        owned = composition.with_ownership(clean, self.roles, self.limits)
        return composition.mix_table(owned, "ownership", self.roles, self.limits.target_region)

    def target_and_whole(self, clean: DataFrame) -> DataFrame:
        return composition.target_and_whole_rate(clean, self.roles, self.limits.target_region)

    def cube(self, clean: DataFrame) -> DataFrame:
        r = self.roles
        return cube.pivot_source(clean, [r.group, "size_band", "size_order", r.region], r)

    def band_labels(self) -> list[str]:
        return [b.label for b in self.limits.bands]

    def shape(self, cube_table: DataFrame) -> DataFrame:
        pivot = cube.rate_pivot(cube_table, self.roles.group, self.band_labels(), places=2)
        return cube.gradient_shape(pivot, self.band_labels())

    def fit(self, clean: DataFrame) -> DataFrame:
        return models.ols_fixed_effects(
            clean, "trir", F.log(F.col(self.roles.workers).cast("double")), self.roles.group
        )

    def count_fit(self, clean: DataFrame) -> DataFrame:
        """Counts of cases with the exposure as offset, in place of rates."""
        size = F.log(F.col(self.roles.workers).cast("double"))
        return count_model.count_model(clean, "recordable_cases", size, self.roles.exposure, self.roles.group)

    def model_stats(self, clean: DataFrame, cube_table: DataFrame) -> DataFrame:
        agreement = compare.spearman(self.ranked(clean), "rank_by_rate", "rank_by_count")
        gradient = cube.gradient_summary(self.shape(cube_table), self.roles.group)
        return models.model_stats(agreement, self.fit(clean), gradient)


# The yearly establishment file.

ESTABLISHMENT_ROLES = Roles(
    unit="establishment_id",
    period="year_filing_for",
    filed="created_timestamp",
    ties=("id",),
    group="sector",
    region="state",
    owner="establishment_type",
    code="naics_code",
    workers="annual_average_employees",
    exposure="total_hours_worked",
    severe_cases=("total_dafw_cases", "total_djtr_cases"),
    other_cases=("total_other_cases",),
    deaths="total_deaths",
    size_code="size",
    none_flag="no_injuries_illnesses",
)

# Rule and check texts, labels, thresholds and codes of the published tables.
ESTABLISHMENT_LIMITS = Limits(
    period_from=2025,
    period_to=2025,
    min_exposure=1000,
    min_ratio=100,
    max_ratio=5000,
    prefix_length=2,
    code_pattern="^[0-9]{6}$",
    bands=(
        Band("Under 20", 1, 20),
        Band("20-99", 21, 100),
        Band("100-249", 22, 250),
        Band("250+", 3),
    ),
    legacy_code=2,
    legacy_covers=(21, 22),
    target_region="ME",
    scope_group="Public Administration",
    scope_all_label="All sectors",
    total_label="ALL SECTORS (whole clean table)",
    owner_labels={1: "1 private", 2: "2 state government", 3: "3 local government"},
    rules=(
        "year_filing_for missing or not 2025",
        "duplicate submission for the same establishment and year (kept the latest)",
        "total_hours_worked NULL or below 1,000",
        "annual_average_employees NULL or 0",
        "naics_code invalid or sector not in the lookup",
        "a case-count column NULL or negative",
        "recordable cases greater than annual average employees",
        "hours per employee below 100 or above 5,000",
    ),
    checks=(
        "year_filing_for is not 2025 (or is NULL)",
        "duplicate establishment_id (rows minus distinct ids)",
        "total_hours_worked is NULL",
        "total_hours_worked < 1000",
        "annual_average_employees is NULL or 0",
        "naics_code NULL, not six digits, or sector not in lookup",
        "a case-count column is NULL or negative",
        "recordable_cases > annual_average_employees",
        "no_injuries_illnesses inconsistent with the case counts",
        "hours per employee above 5,000 or below 100",
        "size code disagrees with the annual_average_employees band",
        "legacy size code 2 present (retired in 2023)",
    ),
)

# Columns of the row-level export, and those that may never be in it.
EXPORT_COLUMNS = [
    "establishment_id",
    "state",
    "sector",
    "naics_code",
    "size_band",
    "annual_average_employees",
    "total_hours_worked",
    "total_deaths",
    "total_dafw_cases",
    "total_djtr_cases",
    "total_other_cases",
    "recordable_cases",
    "trir",
    "dart",
]
WITHHELD_COLUMNS = ["establishment_name", "company_name"]
PUBLISHED_RATE = 2.3  # private industry, one year earlier, cases per 100 full-time workers


# The order tables in the same roles.

ORDER_LINE_ROLES = Roles(
    unit="unit_id",
    period="period",
    filed="filed_txt",
    ties=("part_id", "supp_id", "price", "quantity"),
    group="grp",
    region="region_grp",
    owner="owner_code",
    code="code",
    workers="workers",
    exposure="exposure",
    severe_cases=("c1", "c2"),
    other_cases=("c3",),
    deaths="deaths",
    size_code="size_code",
    none_flag="none_flag",
)

ORDER_LINE_LIMITS = Limits(
    period_from=None,
    period_to=1999,
    min_exposure=5000,
    min_ratio=200,
    max_ratio=20000,
    prefix_length=1,
    code_pattern="^[0-9]-",
    bands=(Band("Under 10", 1, 10), Band("10-24", 21, 25), Band("25-39", 22, 40), Band("40+", 3)),
    legacy_code=2,
    legacy_covers=(21, 22),
    target_region="NATION_14",
    scope_group="Brand#7",
    scope_all_label="All groups",
    total_label="ALL GROUPS",
    min_n=900,
    owner_labels={
        "AUTOMOBILE": "1 automobile",
        "BUILDING": "2 building",
        "FURNITURE": "3 furniture",
    },
    rules=(
        "period missing or after 1999",
        "earlier submission for the same unit and period",
        "exposure NULL or below 5,000",
        "workers NULL or 0",
        "code invalid or not in the lookup",
        "a count NULL or negative",
        "cases greater than workers",
        "exposure per worker below 200 or above 20,000",
    ),
    checks=(
        "period missing or after 1999",
        "unit_id repeated (rows minus distinct ids)",
        "exposure is NULL",
        "exposure < 5000",
        "workers is NULL or 0",
        "code NULL, malformed, or not in lookup",
        "a count is NULL or negative",
        "cases > workers",
        "none_flag inconsistent with the counts",
        "exposure per worker above 20,000 or below 200",
        "size code disagrees with the workers band",
        "legacy size code 2 present",
    ),
)
