import pytest
from pyspark.sql import functions as F

from equiloan.constants import HASH_MODULUS, HASH_MULTIPLIER, HASH_QUOTIENT
from equiloan.functions.columns import portable_hash
from equiloan.operators import splits


def _hash(k, seed, m=HASH_MODULUS):
    x = (k % m * HASH_MULTIPLIER + k // m % m * HASH_QUOTIENT + seed) % m
    return (pow(x, 5, m) * HASH_MULTIPLIER + seed) % m


def _df(spark, n=4000):
    return spark.range(1, n + 1).select(F.col("id").alias("application_id"), (F.col("id") % 7).cast("int").alias("bins"),
                                        (F.col("id") % 3 == 0).cast("int").alias("approved"))


def test_split_sizes_complete_and_disjoint(spark):
    df = _df(spark)
    s = splits.stratified_split(df)
    assert s.count() == 4000
    assert s.select("application_id").distinct().count() == 4000
    sizes = {r["bins"]: (r["n"], r["t"]) for r in s.groupBy("bins").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect()}
    for n, t in sizes.values():
        assert t == int(n * 0.25 + 0.5)


def test_split_unchanged_by_repartition(spark):
    df = _df(spark)
    a = {r[0]: r[1] for r in splits.stratified_split(df).select("application_id", "split").collect()}
    b = {r[0]: r[1] for r in splits.stratified_split(df.repartition(13)).select("application_id", "split").collect()}
    assert a == b


@pytest.mark.parametrize("local", [10_000, 3])
def test_split_matches_brute_force_rank(spark, monkeypatch, local):
    """With the strata's cuts fetched and with them joined."""
    monkeypatch.setattr(splits, "LOCAL_STRATA", local)
    df = _df(spark, 1500)
    got = {r[0]: r[1] for r in splits.stratified_split(df).select("application_id", "split").collect()}
    by_bin = {}
    for i in range(1, 1501):
        by_bin.setdefault(i % 7, []).append((_hash(i, 42), i))
    for b, items in by_bin.items():
        k = int(len(items) * 0.25 + 0.5)
        test = {i for _, i in sorted(items)[:k]}
        for _, i in items:
            assert got[i] == ("test" if i in test else "train")


def test_downsample_majority_balances_classes(spark):
    out = splits.downsample_majority(_df(spark))
    c = {r[0]: r[1] for r in out.groupBy("approved").count().collect()}
    assert c[0] == c[1] == 4000 // 3


def test_random_split_fraction(spark):
    s = splits.random_split(_df(spark, 20000))
    frac = s.filter(F.col("split") == "test").count() / 20000
    assert 0.23 < frac < 0.27


def test_hash_mixes_seed_and_quotient(spark):
    keys = [0, 1, 2, 1000003, 1000004, 2**40, 5, 7 * 1000003 + 1]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r["k"]: (r["a"], r["b"]) for r in df.select("k", portable_hash("k", 42).alias("a"),
                                                      portable_hash("k", 43).alias("b")).collect()}
    assert got == {k: (_hash(k, 42), _hash(k, 43)) for k in keys}
    assert got[1][0] != got[1000004][0]
    shift = {(b - a) % HASH_MODULUS for a, b in got.values()}
    assert len(shift) > 1  # another seed is another order, not a rotation


def test_downsample_ignores_missing_labels(spark):
    df = _df(spark).withColumn("approved", F.when(F.col("application_id") > 7, F.col("approved")))
    c = {r[0]: r[1] for r in splits.downsample_majority(df).groupBy("approved").count().collect()}
    assert set(c) == {0, 1} and c[0] == c[1] > 1000


def test_strata_keep_their_type(spark):
    """1.0 and 1.2, text and null strata are strata of their own."""
    for value in (F.when(F.col("application_id") % 4 == 0, 1.0).when(F.col("application_id") % 4 == 1, 1.2),
                  F.when(F.col("application_id") % 4 == 0, "x|1").when(F.col("application_id") % 4 == 1, "x")):
        s = splits.stratified_split(_df(spark, 800).withColumn("bins", value))
        got = {r["bins"]: (r["n"], r["t"]) for r in s.groupBy("bins").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect()}
        assert sorted(got.values()) == [(200, 50), (200, 50), (400, 100)]


def test_equal_hashes_are_cut_by_key(spark, monkeypatch):
    """All rows on one hash, or on a few of one part: the keys decide."""
    for hashes in (1, 5):
        monkeypatch.setattr(splits, "portable_hash", lambda key, seed, m=hashes: (F.col(key) % m).cast("long"))
        got = {r[0]: r[1] for r in splits.stratified_split(_df(spark, 1500)).select("application_id", "split").collect()}
        for b in range(7):
            mine = sorted((i % hashes, i) for i in range(1, 1501) if i % 7 == b)
            test = {i for _, i in mine[:int(len(mine) * 0.25 + 0.5)]}
            assert {i for _, i in mine if got[i] == "test"} == test


def test_one_written_table_and_no_row_shuffle(spark, monkeypatch):
    """The split writes the rows of the cut parts only and marks the rows by a
    broadcast join."""
    written = []
    write = splits.materialize
    monkeypatch.setattr(splits, "materialize", lambda df, name: written.append(name) or write(df, name))
    out = splits.stratified_split(_df(spark, 20000))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert written == ["split-cut"] and "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
