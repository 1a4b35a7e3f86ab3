"""Sinks (S4-S6): prepared tables, reports and models.

Everything is written by the executors in parallel (never ``toPandas``), to
locations on shared storage; writes are whole-job atomic through Spark's
output committer, so a lost executor only reruns its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_prepared(df: DataFrame, path: str, fmt: str = "parquet",
                   partition_by: str | None = "activity_year") -> str:
    """Prepared table, partitioned by year so year slices prune folders.
    No positional row index is written: rows carry their key column."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by and partition_by in df.columns:
        writer = writer.partitionBy(partition_by)
    writer.save(path)
    return path


def write_report(df: DataFrame, path: str, fmt: str = "csv", single_file: bool = True) -> str:
    """Report table. Reports are small aggregates; ``single_file`` puts
    them in one part file (coalesce(1) on an aggregate output, not on data)."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
    return path


def save_model(model, path: str) -> str:
    """Persist a fitted ``pyspark.ml`` model or pipeline."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    """Load a model saved by ``save_model`` (a ``PipelineModel``)."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
