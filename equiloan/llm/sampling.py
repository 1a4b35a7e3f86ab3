"""Bounded, repeatable samples of documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, limit: int, by: str | None = None) -> DataFrame:
    """About ``limit`` rows (a few more or fewer), the same on every run: those
    that hash lowest over all of their columns. Rows equal in all columns count
    as one and are returned once, so the bound holds however often a row or an
    id is repeated. With ``by``, every value of that column gets an equal share;
    a value with fewer rows than its share gives all of them. Counting is one
    aggregation of sketches; no group is gathered anywhere."""
    keyed = rows.withColumn("_key", F.xxhash64(*rows.columns, F.lit("sample")))
    keep = F.pmod(F.col("_key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    distinct = F.approx_count_distinct("_key", 0.02).alias("n")
    rate = F.lit(1.0)
    if by is None:
        n = keyed.agg(distinct).first()["n"]
        rate = F.lit(limit / n) if n > limit else rate
    else:
        counts = {r[by]: r["n"] for r in keyed.groupBy(by).agg(distinct).collect()}  # one row per class
        share = limit / max(len(counts), 1)
        for value, n in counts.items():
            if n > share:
                rate = F.when(F.col(by).eqNullSafe(F.lit(value)), F.lit(share / n)).otherwise(rate)
    return keyed.filter(keep < rate).dropDuplicates(["_key"]).drop("_key")
