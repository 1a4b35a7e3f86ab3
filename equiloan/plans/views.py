"""Input views every registered query starts from.

``applications`` is the stand-in input (rows in the application schema, built
from the driver's tables). ``labelled`` is the prepared table of the
workflow, built with the library's own operators: P3 drop missing
predictors, P4 valid actions, P5 label, P7 protected attributes, and the
stand-in scorecard decision.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from equiloan.constants import PREDICTORS, SLICE_YEAR, THRESHOLDS
from equiloan.operators import prep
from equiloan.sources.applications import year_slice
from equiloan.sources.standin import rule_decision, stand_in_applications


_STORED: dict[tuple, str] = {}
_LOCK = threading.Lock()
_INPUTS = ("orders", "customer", "lineitem")


def versions(spark: SparkSession, sf_dir: str) -> list:
    """The versions of the driver's tables that the application table is built
    from."""
    from equiloan.session import table_version

    return [table_version(spark, f"{sf_dir.rstrip('/')}/{t}.parquet") for t in _INPUTS]


def applications(spark: SparkSession, sf_dir: str, stored: bool = True) -> DataFrame:
    """The application table. With ``stored`` (default), the stand-in is
    built from the driver's tables once per application and version of those
    tables' files (one Spark job) and written as Parquet to the shared
    checkpoint folder; queries then scan it like the stored application table
    they would read in production (column pruning, pushed filters, parallel
    files)."""
    if not stored:
        return stand_in_applications(spark, sf_dir)
    from equiloan.session import shared_path

    key = (spark.sparkContext.applicationId, *versions(spark, sf_dir))
    with _LOCK:
        path = _STORED.get(key)
        if path is None:
            path = shared_path(spark, "applications")
            stand_in_applications(spark, sf_dir).write.mode("overwrite").parquet(path)
            _STORED[key] = path
        return spark.read.parquet(path)


def prepare(apps: DataFrame) -> DataFrame:
    """The prepared table: P3 -> P4 -> P5 -> P7, then the scorecard decision."""
    df = prep.drop_missing(apps, PREDICTORS)
    df = prep.valid_actions(df)
    df = prep.recode_label(df)
    df = prep.protected_attributes(df, THRESHOLDS)
    return rule_decision(df)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(applications(spark, sf_dir))


def labelled_year(spark: SparkSession, sf_dir: str, year: int = SLICE_YEAR) -> DataFrame:
    """S2 slice of the prepared table (the single-year experiment input)."""
    return year_slice(labelled(spark, sf_dir), year)
