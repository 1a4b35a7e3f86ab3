"""Exact running totals and quantiles that never put a whole group in one task.

A window ``partitionBy(group).orderBy(x)`` sends every row of a group to one
task: with two groups (privileged / unprivileged) or ten bins that is two or
ten tasks for the whole table, and a hot group holding a third of the rows
becomes a third of the table in one task. Instead:

1. work on the distinct-value table ``(group, x) -> n`` (ties collapse);
2. cut each group into coarse buckets that are monotone in ``x`` (a natural
   grid such as ``x div 1024``, or Spark's range partitions of (group, x), as
   many as keep one at ``TARGET_ROWS_PER_BUCKET`` rows; where the cuts fall
   only balances the work, it never changes the result);
3. sum ``n`` per (group, bucket) and turn the sums into per-bucket offsets: a
   window over at most ``FAN`` buckets, and above that a tree of such windows
   over the totals of ``FAN`` buckets each;
4. run the inclusive running sum inside each (group, bucket) and add the
   offset.

The result is exact, and no task holds more than a bucket of rows or ``FAN``
totals, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


TARGET_ROWS_PER_BUCKET = 200_000
#: Bucket totals summed by one window.
FAN = 4096


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage of a derived table that later steps read several
    times: write it once as Parquet under the shared checkpoint folder
    (``spark.checkpoint.dir``) and read it back. Unlike a local checkpoint it
    survives the loss of an executor, and unlike an eager ``checkpoint()`` it
    computes the plan once (no second pass to write the checkpoint files). The
    plan's shuffle files go when the table is written."""
    from equiloan.session import shared_path, shuffles_released

    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffles_released(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def materialize_counted(df: DataFrame, name: str = "table") -> tuple[DataFrame, int]:
    """``materialize`` that also returns the row count. The count of a
    written Parquet table is answered from its file footers (row-group
    metadata), not by reading the data again. (An ``Observation`` on the
    write would avoid even that, but in this Spark version it leaves the
    session unable to serialize later ``pyspark.ml`` tasks.)"""
    table = materialize(df, name)
    return table, table.count()


def buckets_for(rows: int, target: int | None = None) -> int:
    """Coarse buckets for a table of so many rows, about ``target`` rows each."""
    return int(max(1, -(-rows // (target or TARGET_ROWS_PER_BUCKET))))


def range_buckets(df: DataFrame, keys: Iterable[str], value: str, buckets: int) -> DataFrame:
    """Add ``_cb``, a coarse bucket monotone in ``value`` within ``keys``: the
    range partition of the row. The table is written, so that the buckets are
    the same for all that read them. With one bucket nothing is added or
    written and ``running_total`` uses one window."""
    if buckets <= 1:
        return df
    cut = df.repartitionByRange(buckets, *keys, value).withColumn("_cb", F.spark_partition_id().cast("long"))
    return materialize(cut, "ranges")


def _offsets(totals: DataFrame, keys: list[str], counts: list[str], buckets: int) -> DataFrame:
    """(keys, _cb, _off_<c>): the sum of ``_t_<c>`` over all buckets before."""
    if buckets <= FAN:
        before = Window.partitionBy(*keys).orderBy("_cb").rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*keys, "_cb", *[
            F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in counts])
    up = totals.withColumn("_up", F.floor(F.col("_cb") / F.lit(FAN)).cast("long"))
    above = _offsets(up.groupBy(*keys, F.col("_up").alias("_cb")).agg(*[F.sum(f"_t_{c}").alias(f"_t_{c}") for c in counts]),
                     keys, counts, -(-buckets // FAN))
    above = above.select(*keys, F.col("_cb").alias("_up"), *[F.col(f"_off_{c}").alias(f"_up_{c}") for c in counts])
    before = Window.partitionBy(*keys, "_up").orderBy("_cb").rowsBetween(Window.unboundedPreceding, -1)
    inner = up.select(*keys, "_up", "_cb", *[
        F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_in_{c}") for c in counts])
    return inner.join(above, [*keys, "_up"], "inner").select(*keys, "_cb", *[
        (F.col(f"_up_{c}") + F.col(f"_in_{c}")).alias(f"_off_{c}") for c in counts])


def running_total(df: DataFrame, keys: Iterable[str], order: str, counts: Iterable[str] | str,
                  coarse: Column | None = None, prefix: str = "cum_", buckets: int = 1) -> DataFrame:
    """Inclusive running sums of ``counts`` over ``order`` within ``keys``.

    ``df`` must hold one row per (keys, order). ``coarse`` is a bucket column
    monotone in ``order`` within ``keys``; if None, a ``_cb`` column already
    on ``df`` is used, else one bucket per key. ``buckets`` is a bound of the
    bucket numbers.
    """
    keys = list(keys)
    counts = [counts] if isinstance(counts, str) else list(counts)
    if coarse is None and "_cb" not in df.columns:
        # One bucket per key (the caller measured the key small enough):
        # the plain window is the same running sum with fewer stages.
        whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(*df.columns, *[F.sum(c).over(whole).alias(prefix + c) for c in counts])
    if coarse is not None:
        d = df.withColumn("_cb", coarse.cast("long"))
    else:
        d = df.withColumn("_cb", F.col("_cb").cast("long"))
    # Per-bucket totals: groups x buckets rows.
    totals = d.groupBy(*keys, "_cb").agg(*[F.sum(c).alias(f"_t_{c}") for c in counts])
    offsets = _offsets(totals, keys, counts, buckets)
    within = Window.partitionBy(*keys, "_cb").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    inner = d.select("*", *[F.sum(c).over(within).alias(f"_in_{c}") for c in counts])
    out = inner.join(offsets, [*keys, "_cb"], "inner")
    return out.select(*[F.col(c) for c in d.columns if c != "_cb"],
                      *[(F.col(f"_off_{c}") + F.col(f"_in_{c}")).alias(prefix + c) for c in counts])


def distinct_counts(df: DataFrame, keys: Iterable[str], value: str, out: str = "n") -> DataFrame:
    """(keys, value) -> n over non-null values: ties collapse before any sort."""
    keys = list(keys)
    return (df.filter(F.col(value).isNotNull())
            .groupBy(*keys, value).agg(F.count(F.lit(1)).alias(out)))


def exact_quantiles(df: DataFrame, keys: Iterable[str], value: str, probs: list[float],
                    buckets: int | None = None, names: list[str] | None = None) -> DataFrame:
    """Quantiles with linear interpolation between order statistics (the
    pandas ``describe`` / SQL ``quantile_cont`` definition), exact, per keys.

    Position p*(N-1) (0-based); q = lo + (hi - lo) * frac.
    """
    keys = list(keys)
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    dist, rows = materialize_counted(
        distinct_counts(df.select(*keys, F.col(value).cast("double").alias("_v")), keys, "_v", "_n"), "quantile-dist")
    buckets = buckets if buckets is not None else buckets_for(rows)
    dist = range_buckets(dist, keys, "_v", buckets)
    cum = running_total(dist, keys, "_v", "_n", buckets=buckets)
    totals = dist.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    c = cum.join(totals, keys, "inner")
    first_rank = F.col("cum__n") - F.col("_n")   # 0-based rank of the first copy
    last_rank = F.col("cum__n") - F.lit(1)
    aggs = [F.max("_total").alias("_total")]
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_total") - F.lit(1)).cast("double")
        lo = F.floor(pos)
        hi = F.least(lo + F.lit(1), F.col("_total") - F.lit(1))
        aggs.append(F.max(F.when((first_rank <= lo) & (lo <= last_rank), F.col("_v"))).alias(f"_lo{i}"))
        aggs.append(F.max(F.when((first_rank <= hi) & (hi <= last_rank), F.col("_v"))).alias(f"_hi{i}"))
    g = c.groupBy(*keys).agg(*aggs)
    outs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_total") - F.lit(1)).cast("double")
        frac = pos - F.floor(pos)
        outs.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac).alias(names[i]))
    return g.select(*keys, *outs)
