"""The raw fact table: 32 columns, one row per establishment and year.

Codes and damaged count columns stay text; everything that is summed is BIGINT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewright.sources.files import read_csv

# Column names, in file order, with their types.
_COLUMNS = [
    ("id", "bigint"),
    ("establishment_name", "string"),
    ("establishment_id", "string"),
    ("ein", "string"),
    ("company_name", "string"),
    ("street_address", "string"),
    ("city", "string"),
    ("state", "string"),
    ("zip_code", "string"),
    ("naics_code", "bigint"),
    ("naics_year", "bigint"),
    ("industry_description", "string"),
    ("establishment_type", "bigint"),
    ("size", "bigint"),
    ("annual_average_employees", "bigint"),
    ("total_hours_worked", "bigint"),
    ("no_injuries_illnesses", "bigint"),
    ("total_deaths", "bigint"),
    ("total_dafw_cases", "bigint"),
    ("total_djtr_cases", "bigint"),
    ("total_other_cases", "bigint"),
    ("total_dafw_days", "bigint"),
    ("total_djtr_days", "bigint"),
    ("total_injuries", "bigint"),
    ("total_skin_disorders", "string"),
    ("total_respiratory_conditions", "bigint"),
    ("total_poisonings", "bigint"),
    ("total_hearing_loss", "string"),
    ("total_other_illnesses", "string"),
    ("created_timestamp", "string"),
    ("change_reason", "string"),
    ("year_filing_for", "bigint"),
]

RAW_SCHEMA = T.StructType(
    [
        T.StructField(name, T.LongType() if kind == "bigint" else T.StringType())
        for name, kind in _COLUMNS
    ]
)

LOOKUP_SCHEMA = T.StructType(
    [T.StructField("sector_code", T.StringType()), T.StructField("sector", T.StringType())]
)

# Two-digit industry code -> sector name.
SECTORS = [
    ("11", "Agriculture, Forestry, Fishing and Hunting"),
    ("21", "Mining, Quarrying, and Oil and Gas Extraction"),
    ("22", "Utilities"),
    ("23", "Construction"),
    ("31", "Manufacturing"),
    ("32", "Manufacturing"),
    ("33", "Manufacturing"),
    ("42", "Wholesale Trade"),
    ("44", "Retail Trade"),
    ("45", "Retail Trade"),
    ("48", "Transportation and Warehousing"),
    ("49", "Transportation and Warehousing"),
    ("51", "Information"),
    ("52", "Finance and Insurance"),
    ("53", "Real Estate and Rental and Leasing"),
    ("54", "Professional, Scientific, and Technical Services"),
    ("55", "Management of Companies and Enterprises"),
    ("56", "Administrative and Support and Waste Management and Remediation Services"),
    ("61", "Educational Services"),
    ("62", "Health Care and Social Assistance"),
    ("71", "Arts, Entertainment, and Recreation"),
    ("72", "Accommodation and Food Services"),
    ("81", "Other Services (except Public Administration)"),
    ("92", "Public Administration"),
]


def sector_lookup(spark: SparkSession) -> DataFrame:
    """The fixed list above; broadcast, as its size is known."""
    return F.broadcast(spark.createDataFrame(SECTORS, LOOKUP_SCHEMA))


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """A lookup from CSV, one row per prefix."""
    return read_csv(spark, path, LOOKUP_SCHEMA)
