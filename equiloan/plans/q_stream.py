"""Registered query: the streaming monitor, value-checked against the batch
flagship's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from equiloan.plans import views
from equiloan.plans.catalog import PARITY_BY_THRESHOLD_SQL
from equiloan.plans.registry import register
from equiloan.session import shared_path
from equiloan.sources import sinks
from equiloan.streaming import run_monitor


@register("parity_stream", PARITY_BY_THRESHOLD_SQL)
def q_parity_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming G6-G13: the applications land as Parquet files (S4 write);
    a Structured Streaming query folds them, two files per micro-batch, into
    the contingency state and keeps the metrics table current. The final
    table equals the batch result."""
    src = shared_path(spark, "stream-source")
    sinks.write_prepared(views.applications(spark, sf_dir), src, partition_by=None)
    schema = spark.read.parquet(src).schema
    out = run_monitor(spark, src, schema, shared_path(spark, "stream-metrics"),
                      shared_path(spark, "stream-checkpoint"), files_per_trigger=2)
    return spark.read.parquet(out)


@register("write_report", PARITY_BY_THRESHOLD_SQL)
def q_write_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship report written as a CSV report by the executors (one
    part file: it is a small aggregate), read back with its schema."""
    from equiloan.plans.catalog import parity_by_threshold

    rep = parity_by_threshold(spark, sf_dir)
    path = shared_path(spark, "report-csv")
    sinks.write_report(rep, path, fmt="csv")
    return spark.read.schema(rep.schema).option("header", True).csv(path)
