"""Repeatable splits and sampling.

A row's fate depends only on its key and the seed (``portable_hash``), never
on partitioning or task order, so a rerun after a lost executor, or any
``repartition``, gives the same split. The k lowest hashes of a stratum are
selected as in a radix sort, without a global sort and without a window over
its rows: one scan counts the rows per stratum and high part of the hash
(about 1,000 values), which gives the part at which the stratum is cut; a
second keeps the rows of that part (about n / 1,000), counts them per hash
(1,024 values) and ranks the keys of the one hash that is cut (about
n / 1e6). The rows are then marked by one comparison with the stratum's
(hash, key). Only the rows of the cut part are written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiloan.constants import HASH_MODULUS, SEED_SPLIT, TEST_FRACTION
from equiloan.functions.columns import portable_hash
from equiloan.operators.cumulative import materialize

#: Hash values per part of the first count.
PART = 1024
#: Strata up to which their cuts are fetched.
LOCAL_STRATA = 10_000


def _same(left: Iterable[str], right: Iterable[str]) -> Column:
    cond = F.lit(True)
    for a, b in zip(left, right, strict=True):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def _few(df: DataFrame) -> DataFrame:
    """A table of one row per stratum: fetched and broadcast if it has at most
    ``LOCAL_STRATA`` rows, else written and left to the planner."""
    rows = df.limit(LOCAL_STRATA + 1).collect()
    if len(rows) > LOCAL_STRATA:
        return materialize(df, "split-strata")
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def lowest_k_by_hash(df: DataFrame, strata: Iterable[str], k_of_n: Callable[[Column], Column],
                     key: str = "application_id", seed: int = SEED_SPLIT,
                     out: str = "selected") -> DataFrame:
    """Mark the k rows with the lowest (hash, key) in each stratum.

    ``k_of_n`` maps a stratum's row count (a Column) to k; it may also read the
    stratum's columns by their names. Strata are compared in the column's own
    type, null being a stratum of its own. The key must be unique: it breaks
    ties between equal hashes. The tables of cuts have one row per stratum:
    up to ``LOCAL_STRATA`` they are fetched and broadcast, above that they are
    joined as the planner sees fit.
    """
    strata = list(strata)
    bk = [f"_b{i}" for i in range(len(strata))]
    h = portable_hash(key, seed)
    keyed = df.select(*strata, F.col(key).alias("_key"), h.alias("_h"))
    back = lambda names, to: [F.col(a).alias(b) for a, b in zip(names, to, strict=True)]
    upto = lambda order: F.sum("_n").over(Window.partitionBy(*strata).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    cut = lambda need: (F.col("_upto") - F.col("_n") < F.col(need)) & (F.col(need) <= F.col("_upto"))
    parts = (keyed.groupBy(*strata, F.floor(F.col("_h") / F.lit(PART)).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_upto", upto("_p"))
             .withColumn("_k", k_of_n(F.sum("_n").over(Window.partitionBy(*strata))).cast("long")).filter(cut("_k"))
             .select(*back(strata, bk), F.col("_p").alias("_pb"), (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_need")))
    near = materialize(keyed.join(_few(parts), _same(strata, bk) & (F.floor(F.col("_h") / F.lit(PART)) == F.col("_pb")), "inner")
                       .select(*strata, "_h", "_key", "_need"), "split-cut")
    hashes = (near.groupBy(*strata, "_h").agg(F.count(F.lit(1)).alias("_n"), F.max("_need").alias("_need"))
              .withColumn("_upto", upto("_h")).filter(cut("_need"))
              .select(*back(strata, bk), F.col("_h").alias("_hb"), (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need")))
    ties = near.drop("_need").join(hashes, _same(strata, bk) & (F.col("_h") == F.col("_hb")), "inner")
    rank = F.row_number().over(Window.partitionBy(*bk).orderBy("_key"))
    edge = _few(ties.withColumn("_r", rank).filter(F.col("_r") == F.col("_need")).select(*bk, "_hb", F.col("_key").alias("_kb")))
    below = (h < F.col("_hb")) | ((h == F.col("_hb")) & (F.col(key) <= F.col("_kb")))
    marked = df.join(edge, _same(strata, bk), "left")
    return marked.select(*[F.col(c) for c in df.columns], F.coalesce(below, F.lit(False)).alias(out))


def stratified_split(df: DataFrame, by: str = "bins", test_fraction: float = TEST_FRACTION,
                     key: str = "application_id", seed: int = SEED_SPLIT, out: str = "split") -> DataFrame:
    """Per stratum, the round(test_fraction * n) rows with the lowest
    (hash, key) go to 'test', the rest to 'train'."""
    marked = lowest_k_by_hash(df, [by], lambda n: F.round(F.lit(float(test_fraction)) * n), key, seed, "_test")
    return marked.withColumn(out, F.when(F.col("_test"), F.lit("test")).otherwise(F.lit("train"))).drop("_test")


def random_split(df: DataFrame, test_fraction: float = TEST_FRACTION, key: str = "application_id",
                 seed: int = SEED_SPLIT, out: str = "split") -> DataFrame:
    """Plain seeded split by hash threshold; no shuffle at all."""
    h = portable_hash(key, seed)
    return df.withColumn(out, F.when(h < F.lit(float(test_fraction) * HASH_MODULUS), F.lit("test"))
                         .otherwise(F.lit("train")))


def downsample_majority(df: DataFrame, label: str = "approved", key: str = "application_id",
                        seed: int = SEED_SPLIT) -> DataFrame:
    """Keep every row of the smaller class and as many rows of the larger
    class (its lowest hashes), so both classes end the same size. Rows without
    a label belong to neither class and go. The class sizes are one small
    aggregation (one row per class)."""
    df = df.filter(F.col(label).isNotNull())
    m = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c")).agg(F.min("_c").alias("_m")).first()["_m"] or 0
    kept = lowest_k_by_hash(df, [label], lambda n: F.least(n, F.lit(int(m))), key, seed, "_keep")
    return kept.filter(F.col("_keep")).drop("_keep")
