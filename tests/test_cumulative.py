import numpy as np
import pytest
from pyspark.sql import functions as F

from equiloan.operators import cumulative
from equiloan.operators.cumulative import exact_quantiles, range_buckets, running_total


@pytest.mark.parametrize("fan", [4096, 2])
def test_running_total_matches_cumsum_with_many_buckets(spark, monkeypatch, fan):
    """Seven buckets under one window of totals, and under a tree of windows
    over two totals each."""
    monkeypatch.setattr(cumulative, "FAN", fan)
    rng = np.random.default_rng(7)
    vals = rng.integers(0, 500, size=3000)
    grp = rng.integers(0, 3, size=3000)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(grp, vals)], "g int, v double")
    dist = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    dist = range_buckets(dist, ["g"], "v", 7)
    assert dist.groupBy("_cb").count().agg(F.max("count")).first()[0] < dist.count() / 3
    got = {(r["g"], r["v"]): r["cum_n"] for r in running_total(dist, ["g"], "v", "n", buckets=7).collect()}
    for g in range(3):
        vs, cnt = np.unique(vals[grp == g], return_counts=True)
        for v, c in zip(vs, np.cumsum(cnt)):
            assert got[(g, float(v))] == c


@pytest.mark.parametrize("buckets", [1, 5])
def test_exact_quantiles_match_linear_interpolation(spark, buckets):
    rng = np.random.default_rng(3)
    data = {k: rng.normal(size=n).round(2) for k, n in (("a", 101), ("b", 2), ("c", 1), ("d", 640))}
    rows = [(k, float(x)) for k, xs in data.items() for x in xs]
    df = spark.createDataFrame(rows, "k string, x double")
    q = {r["k"]: r for r in exact_quantiles(df, ["k"], "x", [0.25, 0.5, 0.75], buckets=buckets).collect()}
    for k, xs in data.items():
        for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
            assert q[k][name] == pytest.approx(np.percentile(xs, p * 100), abs=1e-9)
