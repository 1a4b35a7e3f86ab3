"""Session plumbing shared by the operators: shipping the package to the
executors, written intermediate tables, and keyed repeatable randomness."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equiloan.session import shared_path

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors once per application, so
    their Python workers can import it wherever the driver found it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="equiloan-code-")  # the driver serves it while the application runs
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, "equiloan_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.join("equiloan", os.path.relpath(full, root)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table that later steps read more than once to the shared
    checkpoint folder and read it back: lineage ends there, and a lost
    executor costs tasks, not the table."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def fold(column: str, modulus: int) -> Column:
    """crc32 of a key's decimal text modulo ``modulus`` (null for a null key)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
