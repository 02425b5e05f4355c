"""Every operator as a query over the order tables.

Raw, staged and clean rows are written once per session and folder, as tables in the shared
folder, and read from there: results must not stage the same rows again. Queries about
staging and cleaning themselves start from the raw table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.functions import many_ranks
from ratewright.operators import audit, compare, composition, cube, late, lattice, models, profile, rates, rules, sketch_cube
from ratewright.plans.study import ORDER_LINE_LIMITS, ORDER_LINE_ROLES, Study
from ratewright.session import land, new_shared_path
from ratewright.sources import catalog, files, records, tables
from ratewright.sources.observations import (
    OBSERVATION_SCHEMA,
    observations,
    prefix_lookup_table,
)

R, LIM = ORDER_LINE_ROLES, ORDER_LINE_LIMITS
IDENTITY = ["unit_id", "part_id", "supp_id", "quantity", "filed_txt"]
EXPORTED = [
    "unit_id", "region_grp", "grp", "code", "size_band", "workers", "exposure", "deaths",
    "c1", "c2", "c3", "recordable_cases", "trir", "dart",
]
RATIO_LABELS = ["1. < 200", "2. 200 - 1,000", "3. 1,000 - 5,000", "4. 5,000 - 20,000", "5. > 20,000"]
RATIO_EDGES = [200, 1000, 5000, 20000]
PROBABILITIES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}
METRICS = ["workers", "exposure", "deaths", "c1", "c2", "c3"]
SIZE_MEANINGS = {1: "under 10", 2: "legacy 10-39", 21: "10-24", 22: "25-39", 3: "40+"}
OWNER_SUBSET, OWNER_REST = ["2 building", "3 furniture"], "1 automobile"
PUBLISHED = 15.0


class Tables:
    """The tables of one folder, each written at most once."""

    _known: dict[tuple[str, str], Tables] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.study = Study(R, LIM, prefix_lookup_table(spark))

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Tables:
        key = (spark.sparkContext.applicationId, folder)
        if key not in cls._known:
            cls._known[key] = cls(spark, folder)
        return cls._known[key]

    @cached_property
    def raw(self) -> DataFrame:
        return land(observations(self.spark, self.folder), "raw")

    @cached_property
    def staged(self) -> DataFrame:
        return land(self.study.stage(self.raw), "staged")

    @cached_property
    def clean(self) -> DataFrame:
        return land(self.study.clean(self.staged), "clean")

    # Result tables that others are read off: a row a group, or a row a cell.

    @cached_property
    def cube(self) -> DataFrame:
        return land(self.study.cube(self.clean), "cube")

    @cached_property
    def ranked(self) -> DataFrame:
        return land(self.study.ranked(self.clean), "ranked")

    @cached_property
    def bands(self) -> DataFrame:
        return land(self.study.bands(self.clean), "bands")

    @cached_property
    def regions(self) -> DataFrame:
        return land(self.study.regions(self.clean), "regions")

    @cached_property
    def overall(self) -> DataFrame:
        return land(self.study.overall(self.clean), "overall")

    @property
    def prepared(self) -> DataFrame:
        return self.study.prepared(self.raw)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def as_csv(self, df: DataFrame, label: str) -> str:
        path = new_shared_path(self.spark, label)
        files.write_csv(df, path)
        return path


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(Tables.of(spark, folder))

    QUERIES[build.__name__] = run
    return build


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    """Means and fits depend on the order of addition in the last digits."""
    return df.withColumns({c: F.round(c, places) for c in columns})


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """Whole numbers that may be NULL as doubles, the one form both engines' frames share."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


# Profiling and audit


@query
def null_profile(t: Tables) -> DataFrame:
    return profile.null_profile(t.raw)


@query
def value_counts(t: Tables) -> DataFrame:
    return profile.value_counts(t.raw, "size_code", SIZE_MEANINGS)


@query
def value_counts_text(t: Tables) -> DataFrame:
    return profile.value_counts(t.raw, "filed_txt")


@query
def numeric_profile(t: Tables) -> DataFrame:
    return profile.numeric_profile(t.raw, METRICS)


@query
def extreme_rows(t: Tables) -> DataFrame:
    ties = [F.col(c).asc_nulls_first() for c in IDENTITY]
    return profile.extreme_rows(
        t.prepared, "exposure", 5, ("exposure", "workers"),
        ["exposure", "workers", "size_code", "region_grp", "code", "recordable_cases"], ties,
    )


KEPT = ["exposure", "workers", "size_code", "region_grp", "code", "recordable_cases"]


@query
def extreme_rows_workers(t: Tables) -> DataFrame:
    ties = [F.col(c).asc_nulls_first() for c in IDENTITY]
    found = profile.extreme_rows(t.prepared, "workers", 8, ("exposure", "workers"), [*KEPT, *IDENTITY], ties)
    return shown(found, "exposure")


@query
def extreme_rows_staged(t: Tables) -> DataFrame:
    """The largest after staging, with the step that drops them."""
    ties = [F.col(c).asc_nulls_first() for c in IDENTITY]
    found = profile.extreme_rows(t.staged, "exposure", 5, ("exposure", "workers"), [*KEPT, "drop_step"], ties)
    return shown(found, "drop_step", "workers")


@query
def quantiles(t: Tables) -> DataFrame:
    return rounded(profile.quantiles(t.raw, "exposure", PROBABILITIES), 6, *PROBABILITIES)


@query
def uncastable_values(t: Tables) -> DataFrame:
    """Whole numbers and prices cast; the codes do not."""
    mixed = (
        F.when(F.col("size_code") == 2, F.col("quantity").cast("string"))
        .when(F.col("size_code") == 3, F.col("price").cast("string"))
        .otherwise(F.col("code"))
    )
    return profile.uncastable_values(t.raw.select(mixed.alias("mixed")), "mixed")


@query
def nonmatching_values(t: Tables) -> DataFrame:
    return profile.nonmatching_values(t.raw, "code", "^[0-9]-[A-Z]+$")


@query
def torn_records(t: Tables) -> DataFrame:
    return profile.torn_records(t.raw, "owner_code", ["workers", "exposure"])


@query
def torn_rows(t: Tables) -> DataFrame:
    torn = profile.torn_rows(t.raw, "owner_code", ["workers", "exposure"])
    return torn.select("unit_id", "period", "part_id", "supp_id", "quantity", "owner_code", "half")


@query
def schema_check(t: Tables) -> DataFrame:
    return catalog.schema_check(t.raw, OBSERVATION_SCHEMA)


@query
def schema_check_changed(t: Tables) -> DataFrame:
    """A table with a column less, one more, one in another type and two that changed places."""
    names = ["period", "unit_id", *[c for c in t.raw.columns[2:] if c != "price"]]
    changed = t.raw.select(*names, F.col("quantity").alias("amount")).withColumn("c1", F.col("c1").cast("string"))
    return shown(catalog.schema_check(changed, OBSERVATION_SCHEMA), "expected_ordinal", "ordinal", "n_values")


@query
def describe(t: Tables) -> DataFrame:
    return catalog.describe(t.raw)


@query
def inferred_read(t: Tables) -> DataFrame:
    """Rows as CSV, read with the types that all records together allow, and added up."""
    read = files.infer_csv(t.spark, t.as_csv(t.raw, "inferred-csv"))
    return read.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("quantity").alias("quantity"),
        F.sum(F.col("exposure") * 2).alias("twice_exposure"),
        F.count("workers").alias("n_workers"),
        F.max("price").alias("max_price"),
        F.min("c3").alias("min_c3"),
        F.max(F.length("filed_txt")).cast("bigint").alias("longest_day"),
    )


@query
def load_check(t: Tables) -> DataFrame:
    return catalog.load_check(t.raw, t.table("lineitem").agg(F.count(F.lit(1)).alias("n")))


@query
def record_structure(t: Tables) -> DataFrame:
    middle = [c for c in t.raw.columns if c not in ("workers", "exposure")]
    path = t.as_csv(t.raw.select("workers", *middle, "exposure"), "observations-csv")
    return records.record_structure(records.records(t.spark, path))


@query
def record_structure_quoted(t: Tables) -> DataFrame:
    """Records whose text holds quotes, commas and line breaks."""
    path = t.as_csv(t.table("documents"), "documents-csv")
    found = records.record_structure(records.records(t.spark, path))
    return found.select("n_fields", "n_records", "n_suspect")


def _torn_file(t: Tables) -> str:
    """Rows as comma-separated lines under a header a file; every seventh quantity is cut in two,
    inside the field that its last digit names, and comes once more uncut."""
    columns = t.raw.columns
    text = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    k = (F.col("quantity") % 10 + 1).cast("int")
    fields = F.split("text", ",", -1)
    cut = F.length(F.array_join(F.slice(fields, F.lit(1), k), ",")) + 2  # behind a separator
    lines = F.when(
        F.col("quantity") % 7 == 0, F.array(F.substring("text", F.lit(1), cut - 1), F.expr("substring(text, cut)"), "text")
    ).otherwise(F.array("text"))
    # the first row of a task's file comes behind the header
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    header = F.when(first, F.array(F.lit(",".join(columns)))).otherwise(F.array().cast("array<string>"))
    numbered = t.raw.select("quantity", text.alias("text")).withColumns({"cut": cut, "header": header})
    path = new_shared_path(t.spark, "torn-lines")
    numbered.select(F.explode(F.concat("header", lines)).alias("value")).write.option("compression", "gzip").text(path)
    return path


@query
def torn_pairs(t: Tables) -> DataFrame:
    found = records.torn_pairs(records.records(t.spark, _torn_file(t)), len(t.raw.columns))
    return found.groupBy("left_fields", "right_fields").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.col("right_line") == F.col("left_line") + 1).alias("n_adjacent"),
        F.count_if("sure").alias("n_sure"),
    )


@query
def inspection_sample(t: Tables) -> DataFrame:
    sample = files.inspection_sample(t.raw, IDENTITY, 10)
    return shown(
        sample.select(*IDENTITY, "grp", "region_grp", "workers", "exposure"), "workers", "exposure"
    )


@query
def dq_audit(t: Tables) -> DataFrame:
    return t.study.audit(t.raw)


@query
def duplicate_keys(t: Tables) -> DataFrame:
    return audit.duplicate_keys(t.raw, ["unit_id"])


@query
def duplicate_drilldown(t: Tables) -> DataFrame:
    keep = [*IDENTITY, "period", "grp", "workers", "exposure"]
    return shown(audit.duplicate_drilldown(t.raw, ["unit_id"], keep), "workers", "exposure")


@query
def ratio_bands(t: Tables) -> DataFrame:
    return audit.ratio_bands(t.raw, "exposure", "workers", RATIO_EDGES, RATIO_LABELS)


@query
def code_agreement(t: Tables) -> DataFrame:
    counted = t.raw.filter(F.col("workers").isNotNull())
    return audit.code_agreement(counted, "size_code", t.study.implied_code, 2, [21, 22])


@query
def code_confusion(t: Tables) -> DataFrame:
    label, _ = rules.size_band(R, LIM)
    return audit.code_confusion(t.raw.filter(F.col("workers").isNotNull()), "size_code", label)


@query
def invalid_code_reasons(t: Tables) -> DataFrame:
    return audit.invalid_code_reasons(t.prepared, "code", F.col("code").rlike("^[0-9]-[A-Z]+$"), "sector")


@query
def invalid_code_values(t: Tables) -> DataFrame:
    return audit.invalid_code_values(t.prepared, "code", F.col("code").rlike("^[0-9]-[A-Z]+$"), "sector")


@query
def parse_coverage(t: Tables) -> DataFrame:
    late = F.when(F.col("quantity") == 7, F.lit("the day after")).otherwise(F.col("filed_txt"))
    return audit.parse_coverage(t.raw.select(late.alias("filed_txt")), "filed_txt")


@query
def parse_coverage_plain(t: Tables) -> DataFrame:
    """A plain cast reads none of the days."""
    return audit.parse_coverage(t.raw, "filed_txt", F.col("filed_txt").try_cast("timestamp_ntz"))


@query
def commonest_parses(t: Tables) -> DataFrame:
    return audit.commonest_parses(t.raw, "filed_txt")


# Staging, cleaning, reconciliation

ROW = ["unit_id", "period", "part_id", "supp_id", "quantity"]


@query
def latest_submission(t: Tables) -> DataFrame:
    return rules.latest_submission(t.raw, ["unit_id", "period"], R.filed, R.ties).select(
        *ROW, "filed_txt", "submission_rank"
    )


@query
def prefix_lookup(t: Tables) -> DataFrame:
    named = rules.prefix_lookup(t.raw, "code", 1, t.study.lookup)
    return named.groupBy("code", "sector").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def prefix_lookup_from_csv(t: Tables) -> DataFrame:
    """The lookup from a file of its own."""
    listed = files.read_csv(t.spark, t.as_csv(t.study.lookup, "lookup-csv"), t.study.lookup.schema)
    named = rules.prefix_lookup(t.raw, "code", 1, listed)
    return named.groupBy("code", "sector").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def first_fail(t: Tables) -> DataFrame:
    staged = t.study.stage(t.raw).select(*ROW, "sector", "recordable_cases", "drop_step")
    return shown(staged, "drop_step")


@query
def clean(t: Tables) -> DataFrame:
    return t.study.clean(t.study.stage(t.raw)).select(*ROW, "trir", "dart", "size_band", "size_order")


@query
def waterfall(t: Tables) -> DataFrame:
    return rules.waterfall(t.staged, LIM.rules)


@query
def reconcile(t: Tables) -> DataFrame:
    def n(df: DataFrame, column: str | None = None) -> DataFrame:
        return df.agg((F.count(F.lit(1)) if column is None else F.sum(column)).alias("v"))

    # one row a table, each from one scan
    raw, kept = land(n(t.raw), "raw-count"), F.col("drop_step").isNull()
    staged = land(t.staged.agg(F.count(F.lit(1)).alias("v"), F.count_if(kept).alias("kept")), "staged-count")
    clean = land(t.clean.agg(F.count(F.lit(1)).alias("v"), F.sum("recordable_cases").alias("cases")), "clean-count")
    whole = clean.select("v")
    groups = "n_establishments"
    return rules.reconcile(
        {
            "staged rows are raw rows": (staged.select("v"), raw),
            "waterfall adds up to raw": (n(rules.waterfall(t.staged, LIM.rules), "rows_dropped"), raw),
            "groups add up to clean": (n(t.ranked, groups), whole),
            "bands add up to clean": (n(t.bands, groups), whole),
            "regions add up to clean": (n(t.regions, groups), whole),
            "export rows are clean rows": (n(cube.clean_export(t.clean, EXPORTED)), staged.select("kept")),
            "cube rows add up to clean": (n(t.cube, groups), whole),
            "cube cases add up to clean": (n(t.cube, "total_cases"), clean.select("cases")),
        }
    )


@query
def reconcile_rows(t: Tables) -> DataFrame:
    """Export and cube as written to CSV and read again."""
    exported, cells = cube.clean_export(t.clean, EXPORTED), t.study.cube(t.clean)
    rows, table = new_shared_path(t.spark, "export"), new_shared_path(t.spark, "cube")
    files.write_export(exported, rows, ["grp", "size_band", "region_grp"], ["unit_id"], compression="gzip")
    files.write_result(cells, table, ["grp", "size_order", "region_grp"])
    return rules.reconcile_rows(
        t.raw, t.staged, t.clean,
        files.read_csv(t.spark, rows, exported.schema), cells, files.read_csv(t.spark, table, cells.schema),
    )


@query
def examples_per_step(t: Tables) -> DataFrame:
    keep = [*ROW, "workers", "exposure", "recordable_cases"]
    return shown(rules.examples_per_step(t.staged, R, keep), "workers", "exposure")


@query
def post_clean_ranges(t: Tables) -> DataFrame:
    return rules.post_clean_ranges(t.staged, R, LIM)


# Rates and rankings


@query
def overall_rates(t: Tables) -> DataFrame:
    return t.study.overall(t.clean)


@query
def rate_by_group(t: Tables) -> DataFrame:
    return rates.rate_by_group(t.clean, ["grp", "region_grp"], R)


@query
def sector_two_rankings(t: Tables) -> DataFrame:
    return t.study.ranked(t.clean)


@query
def size_band_rates(t: Tables) -> DataFrame:
    return t.study.bands(t.clean)


@query
def state_rates(t: Tables) -> DataFrame:
    return t.study.regions(t.clean)


@query
def state_top10(t: Tables) -> DataFrame:
    return t.study.top_regions(t.clean)


@query
def insufficient_groups(t: Tables) -> DataFrame:
    return rates.insufficient_groups(t.study.regions(t.clean), "region_grp", LIM.min_n)


@query
def top5_side_by_side(t: Tables) -> DataFrame:
    return compare.top5_side_by_side(t.ranked, "grp")


@query
def topk_set_changes(t: Tables) -> DataFrame:
    return compare.topk_set_changes(t.ranked, "grp")


@query
def rank_moves(t: Tables) -> DataFrame:
    return compare.rank_moves(t.ranked, "grp")


@query
def spearman(t: Tables) -> DataFrame:
    found = compare.spearman(t.study.ranked(t.clean), "rank_by_rate", "rank_by_count")
    return rounded(found, 9, "rho", "p_value")


@query
def rank_correlation(t: Tables) -> DataFrame:
    """Size against rate, over all clean rows."""
    return rounded(many_ranks.rank_correlation(t.clean, "workers", "trir"), 9, "rho")


AVERAGED = ["trir_average_of_rates", "overstatement"]


@query
def averaging_counterfactual(t: Tables) -> DataFrame:
    compared = rounded(t.study.averaging(t.clean), 9, *AVERAGED)
    return shown(
        compared, "rank_sum_then_divide", "rank_average_of_rates", "places_moved_under_averaging"
    )


@query
def averaging_summary(t: Tables) -> DataFrame:
    summary = compare.averaging_summary(t.study.averaging(t.clean), "grp", LIM.total_label)
    return rounded(summary, 9, *AVERAGED, "overstatement_pct")


@query
def averaging_moves(t: Tables) -> DataFrame:
    moves = compare.averaging_moves(t.study.averaging(t.clean), "grp", LIM.total_label)
    return rounded(moves, 9, "trir_average_of_rates")


@query
def largest_row_sensitivity(t: Tables) -> DataFrame:
    return t.study.sensitivity(t.clean)


@query
def concentration_count(t: Tables) -> DataFrame:
    return compare.concentration_count(t.study.sensitivity(t.clean), 0.2)


@query
def deaths_rates(t: Tables) -> DataFrame:
    return t.study.deaths(t.clean)


@query
def deaths_rank_moves(t: Tables) -> DataFrame:
    return compare.deaths_rank_moves(t.study.deaths(t.clean), "grp", LIM.min_deaths)


# Composition and benchmarks


@query
def ownership_split(t: Tables) -> DataFrame:
    return t.study.ownership(t.clean)


@query
def subset_share_and_rate(t: Tables) -> DataFrame:
    return composition.subset_share_and_rate(
        t.study.ownership(t.clean), LIM.scope_all_label, OWNER_SUBSET, OWNER_REST, t.overall
    )


@query
def external_benchmark(t: Tables) -> DataFrame:
    return composition.external_benchmark(t.study.overall(t.clean), PUBLISHED)


@query
def mix_table(t: Tables) -> DataFrame:
    return t.study.group_mix(t.clean)


@query
def mix_table_ownership(t: Tables) -> DataFrame:
    return t.study.ownership_mix(t.clean)


STANDARDISED = ["expected_trir", "gap", "pct_of_gap_explained"]


@query
def indirect_standardisation(t: Tables) -> DataFrame:
    found = composition.indirect_standardisation(
        t.study.group_mix(t.clean), t.study.target_and_whole(t.clean)
    )
    return rounded(found, 8, *STANDARDISED)


@query
def indirect_standardisation_ownership(t: Tables) -> DataFrame:
    found = composition.indirect_standardisation(
        t.study.ownership_mix(t.clean), t.study.target_and_whole(t.clean)
    )
    return rounded(found, 8, *STANDARDISED)


@query
def target_top3_ratio(t: Tables) -> DataFrame:
    return composition.target_top3_ratio(t.study.group_mix(t.clean), "grp")


# Cube, pivot, model, feeds


@query
def clean_export(t: Tables) -> DataFrame:
    return cube.clean_export(t.clean, EXPORTED)


@query
def pivot_source(t: Tables) -> DataFrame:
    return t.study.cube(t.clean)


@query
def rollup_from_cube(t: Tables) -> DataFrame:
    return cube.rollup_from_cube(t.study.cube(t.clean), ["grp"])


CELLS = ["grp", "size_band", "size_order", "region_grp"]


@query
def cube_lattice(t: Tables) -> DataFrame:
    dimensions = {"group": ["grp"], "band": ["size_band", "size_order"], "region": ["region_grp"]}
    found = lattice.cube_lattice(t.study.cube(t.clean), dimensions)
    return shown(found, "size_order")


def _filings(t: Tables) -> tuple[DataFrame, Column]:
    """An order as a unit that files once a line; every other line comes in late."""
    return t.raw.withColumn("unit_id", F.expr("unit_id div 10")), F.col("c1") % 2 == 1


def _folded(t: Tables) -> late.Folded:
    filings, lateness = _filings(t)
    winners = land(late.latest(filings.filter(~lateness), R), "winners")
    standing = land(late.standing_cube(winners, R, LIM, t.study.lookup, CELLS), "standing-cube")
    return late.fold(winners, standing, filings.filter(lateness), R, LIM, t.study.lookup, CELLS)


@query
def late_filings(t: Tables) -> DataFrame:
    return _folded(t).cube


@query
def late_winners(t: Tables) -> DataFrame:
    return _folded(t).winners.select("unit_id", "period", "filed_txt", "part_id", "supp_id", "quantity")


SPREAD = {"median": 0.5, "p90": 0.9}


@query
def sketch_accuracy(t: Tables) -> DataFrame:
    """Distinct parts and quantiles of exposure, rolled up from cells, against the exact ones."""
    cells = land(sketch_cube.sketch_cells(t.clean, CELLS, "part_id", "exposure"), "sketch-cells")
    return sketch_cube.sketch_accuracy(t.clean, cells, "grp", "part_id", "exposure", SPREAD)


@query
def replaced_table(t: Tables) -> DataFrame:
    """The cube of one region, replaced by the whole cube, as a reader then finds it."""
    path = new_shared_path(t.spark, "replaced")
    tables.replace_table(t.cube.filter(F.col("region_grp") == LIM.target_region), path)
    return tables.replace_table(t.cube, path)


@query
def sector_size_rates(t: Tables) -> DataFrame:
    return cube.sector_size_rates(t.study.cube(t.clean), "grp")


def _named_bands(pivot: DataFrame) -> DataFrame:
    """Band labels as plain column names."""
    return pivot.withColumnsRenamed({b: f"band_{i}" for i, b in enumerate(band_names(), start=1)})


def band_names() -> list[str]:
    return [b.label for b in LIM.bands]


@query
def rate_pivot(t: Tables) -> DataFrame:
    return _named_bands(cube.rate_pivot(t.study.cube(t.clean), "grp", band_names()))


@query
def rate_pivot_sliced(t: Tables) -> DataFrame:
    here = F.col("region_grp") == LIM.target_region
    return _named_bands(cube.rate_pivot(t.study.cube(t.clean), "grp", band_names(), keep=here))


@query
def gradient_shape(t: Tables) -> DataFrame:
    return _named_bands(t.study.shape(t.study.cube(t.clean)))


@query
def gradient_summary(t: Tables) -> DataFrame:
    return cube.gradient_summary(t.study.shape(t.study.cube(t.clean)), "grp")


@query
def gradient_from_published(t: Tables) -> DataFrame:
    """The same shape, from the result table as published and read again."""
    table = cube.sector_size_rates(t.study.cube(t.clean), "grp")
    path = new_shared_path(t.spark, "sector-size")
    files.write_result(table, path, ["grp", "size_order"])
    again = files.read_csv(t.spark, path, table.schema)
    pivot = cube.published_pivot(again, "grp", band_names())
    return _named_bands(cube.gradient_shape(pivot, band_names()))


@query
def export_read_back(t: Tables) -> DataFrame:
    """The row export as written, read again and summed."""
    exported = cube.clean_export(t.clean, EXPORTED)
    path = new_shared_path(t.spark, "export")
    files.write_export(exported, path, ["grp", "size_band", "region_grp"], ["unit_id"])
    again = files.read_csv(t.spark, path, exported.schema)
    return again.groupBy("grp", "size_band").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("exposure").alias("exposure"),
        F.sum("recordable_cases").alias("recordable_cases"),
        F.min("trir").alias("min_trir"),
        F.max("dart").alias("max_dart"),
    )


@query
def regression_input(t: Tables) -> DataFrame:
    return models.regression_input(
        t.clean, ["trir", "workers", "grp", "size_band", "recordable_cases", "exposure"]
    )


COUNTED = [
    "slope", "std_error", "ci_low", "ci_high", "rate_ratio_per_doubling", "dispersion", "pearson_per_df",
]
FITTED = ["slope", "std_error", "ci_low", "ci_high", "p_value", "r_squared", "change_per_doubling"]


@query
def ols_fixed_effects(t: Tables) -> DataFrame:
    return rounded(t.study.fit(t.clean), 7, *FITTED)


@query
def count_model(t: Tables) -> DataFrame:
    fitted = rounded(t.study.count_fit(t.clean), 6, *COUNTED)
    return fitted.withColumn("solved", F.col("largest_score") <= 1e-8).drop("largest_score")


@query
def doubling_share(t: Tables) -> DataFrame:
    shared = models.doubling_share(t.study.fit(t.clean), t.overall)
    return rounded(shared, 7, "change_per_doubling", "pct_of_overall")


@query
def model_stats(t: Tables) -> DataFrame:
    stats = t.study.model_stats(t.clean, t.cube)
    return rounded(stats, 7, "value").select("statistic", "value")


@query
def chart_feeds(t: Tables) -> DataFrame:
    ranked, bands, top = t.study.ranked(t.clean), t.study.bands(t.clean), t.study.top_regions(t.clean)
    return shown(cube.chart_feeds(ranked, bands, top, "grp", "region_grp"), "other_rank")
