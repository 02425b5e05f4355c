"""From the raw yearly file to the published tables.

Raw, staged and clean rows are tables under ``out``, each written once and read by what
follows. Every result is a function of the clean table, written as one sorted CSV; the
row export is many files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.operators import composition, cube, rules
from ratewright.plans.study import (
    ESTABLISHMENT_LIMITS,
    ESTABLISHMENT_ROLES,
    EXPORT_COLUMNS,
    PUBLISHED_RATE,
    WITHHELD_COLUMNS,
    Study,
)
from ratewright.sources import contract, files
from ratewright.sources.tables import replace_table


def establishment_study(spark: SparkSession, lookup_path: str | None = None) -> Study:
    """The yearly file's study; the sector lookup is built in unless a CSV is given."""
    lookup = (
        contract.sector_lookup(spark)
        if lookup_path is None
        else contract.read_lookup(spark, lookup_path)
    )
    return Study(ESTABLISHMENT_ROLES, ESTABLISHMENT_LIMITS, lookup)


def load_raw(spark: SparkSession, path: str, quoted_newlines: bool = False) -> DataFrame:
    return files.read_csv(spark, path, contract.RAW_SCHEMA, quoted_newlines)


def loaded(raw: DataFrame, expected_rows: int) -> DataFrame:
    """Rows loaded against rows announced; computing it raises where they differ. Columns that are
    missing, moved or added stop the reader already, as it holds the header against the schema."""
    found = raw.agg(F.count(F.lit(1)).alias("n"))
    announced = raw.sparkSession.range(1).select(F.lit(expected_rows).cast("bigint").alias("n"))
    return rules.reconcile({"rows loaded": (found, announced)}, strict=True)


def submitted_once(staged: DataFrame) -> DataFrame:
    """No row is dropped as an older submission; computing it raises where one is."""
    older = staged.agg(F.count_if(F.col("drop_step") == 2).alias("n"))
    none = staged.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("n"))
    return rules.reconcile({"older submissions": (older, none)}, strict=True)


def accounted(staged: DataFrame, raw: DataFrame, study: Study) -> DataFrame:
    """The waterfall against the raw row count; computing it raises where they differ."""
    dropped = rules.waterfall(staged, study.limits.rules).agg(F.sum("rows_dropped").alias("n"))
    whole = raw.agg(F.count(F.lit(1)).alias("n"))
    return rules.reconcile({"waterfall adds up to raw": (dropped, whole)}, strict=True)


def results(
    study: Study, raw: DataFrame, staged: DataFrame, clean: DataFrame
) -> dict[str, tuple[DataFrame, list[Column | str]]]:
    """Result tables by name, each with the order it is published in."""
    group, region = study.roles.group, study.roles.region
    ranked, overall = study.ranked(clean), study.overall(clean)
    cells, regions = study.cube(clean), study.regions(clean)
    mix, owned = study.group_mix(clean), study.ownership_mix(clean)
    both = study.target_and_whole(clean)
    return {
        "audit": (study.audit(raw), ["check_no"]),
        "drop_waterfall": (rules.waterfall(staged, study.limits.rules), ["step"]),
        "overall": (overall, ["n_establishments"]),
        "sector_by_rate": (ranked, ["rank_by_rate", group]),
        "sector_by_count": (ranked, ["rank_by_count", group]),
        "size_band": (study.bands(clean), ["size_order"]),
        "state_all": (regions, ["rank_by_rate", region]),
        "state_top10": (study.top_regions(clean), ["rank_by_rate", region]),
        "averaging_counterfactual": (
            study.averaging(clean),
            [F.col("rank_sum_then_divide").asc_nulls_last(), group],
        ),
        "largest_row_sensitivity": (
            study.sensitivity(clean),
            [F.col("largest_row_pct_of_sector_hours").desc(), group],
        ),
        "ownership_split": (study.ownership(clean), ["scope", "ownership"]),
        "external_benchmark": (
            composition.external_benchmark(overall, PUBLISHED_RATE),
            ["published_rate"],
        ),
        "target_sector_mix": (mix, [F.col("me_pct_of_hours").desc_nulls_last(), group]),
        "target_ownership_mix": (owned, ["ownership"]),
        "target_sector_standardised": (
            composition.indirect_standardisation(mix, both),
            ["gap"],
        ),
        "target_ownership_standardised": (
            composition.indirect_standardisation(owned, both),
            ["gap"],
        ),
        "deaths_by_sector": (
            study.deaths(clean),
            [F.col("deaths_per_100m_hours").desc_nulls_last(), group],
        ),
        "sector_size_check": (cube.sector_size_rates(cells, group), [group, "size_order"]),
        "pivot_source": (cells, [group, "size_order", region]),
        "model_stats": (study.model_stats(clean, cells), ["statistic"]),
    }


def publish(
    spark: SparkSession,
    raw_path: str,
    out: str,
    lookup_path: str | None = None,
    quoted_newlines: bool = False,
    expected_rows: int | None = None,
    expect_single_submissions: bool = False,
) -> dict[str, str]:
    """Run everything; returns the path of each table written. Raw, staged and clean rows are
    replaced at once (``sources.tables.read_table`` reads them), so a run that stops leaves those of the run before.

    Stops before any result if the file has not ``expected_rows`` rows, or if units were to
    submit once (``expect_single_submissions``) and one did not.
    """
    study = establishment_study(spark, lookup_path)
    raw = replace_table(load_raw(spark, raw_path, quoted_newlines), f"{out}/raw")
    if expected_rows is not None:
        loaded(raw, expected_rows).write.format("noop").mode("overwrite").save()
    staged = replace_table(study.stage(raw), f"{out}/staged")
    if expect_single_submissions:
        submitted_once(staged).write.format("noop").mode("overwrite").save()
    accounted(staged, raw, study).write.format("noop").mode("overwrite").save()
    clean = replace_table(study.clean(staged), f"{out}/clean")

    written = {}
    for name, (table, order) in results(study, raw, staged, clean).items():
        written[name] = f"{out}/tables/{name}"
        files.write_result(table, written[name], order)
    written["clean_export"] = f"{out}/export"
    files.write_export(
        cube.clean_export(clean, EXPORT_COLUMNS, WITHHELD_COLUMNS),
        written["clean_export"],
        order=["sector", "size_band", "state"],
        spread_by=["establishment_id"],
    )
    reconciled(spark, study, raw, staged, clean, written).write.mode("overwrite").parquet(f"{out}/reconcile_rows")
    return written


def reconciled(
    spark: SparkSession, study: Study, raw: DataFrame, staged: DataFrame, clean: DataFrame, written: dict[str, str]
) -> DataFrame:
    """Raw, staged, clean and what was written, row for row; computing it raises where a table does
    not hold the rows it should."""
    cells = study.cube(clean)
    schema = clean.select(*EXPORT_COLUMNS).schema
    exported = files.read_csv(spark, written["clean_export"], schema)
    published = files.read_csv(spark, written["pivot_source"], cells.schema)
    checked = rules.reconcile_rows(raw, staged, clean, exported, cells, published)
    message = F.concat_ws(" ", F.lit("not the same rows:"), "check_name", "n_part", "n_whole")
    same = F.when(F.col("same_rows"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return checked.withColumn("same_rows", same)
