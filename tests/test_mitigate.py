import numpy as np
import pytest
from pyspark.sql import functions as F

from equiloan.operators import parity, mitigate


def _df(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 2, size=n)
    x = rng.normal(size=n) + g * 1.5
    y = (rng.random(n) < 0.4 + 0.3 * g).astype(int)
    rows = [(i, int(gi), float(round(xi, 3)), float(round(xi * 2 + 1, 3)), int(yi))
            for i, (gi, xi, yi) in enumerate(zip(g, x, y))]
    return spark.createDataFrame(rows, "application_id long, a int, x double, z double, approved int")


def test_reweighing_zeroes_weighted_parity_and_keeps_total(spark):
    df = _df(spark)
    w = mitigate.reweigh_weights(df, ["a"])
    wdf = mitigate.apply_weights(df, w, "a")
    assert wdf.count() == df.count()
    total = wdf.agg(F.sum("weight")).first()[0]
    assert total == pytest.approx(600.0)
    m = parity.label_metrics(wdf, ["a"], weight="weight").first()
    assert m["statistical_parity_difference"] == pytest.approx(0.0, abs=1e-9)
    assert m["disparate_impact"] == pytest.approx(1.0, abs=1e-9)


def test_weights_formula(spark):
    rows = [(1, 0, 1), (2, 0, 0), (3, 0, 0), (4, 1, 1), (5, 1, 1), (6, 1, 0)]
    df = spark.createDataFrame(rows, "application_id long, a int, approved int")
    w = {(r["g"], r["y"]): r["weight"] for r in mitigate.reweigh_weights(df, ["a"]).collect()}
    # N=6; N_g0=3, N_g1=3; N_y1=3, N_y0=3; N_gy: (0,1)=1 (0,0)=2 (1,1)=2 (1,0)=1
    assert w[(0, 1)] == pytest.approx(3 * 3 / (6 * 1))
    assert w[(0, 0)] == pytest.approx(3 * 3 / (6 * 2))
    assert w[(1, 1)] == pytest.approx(3 * 3 / (6 * 2))
    assert w[(1, 0)] == pytest.approx(3 * 3 / (6 * 1))


def test_empty_cell_has_no_weight(spark):
    rows = [(1, 0, 0), (2, 0, 0), (3, 1, 1), (4, 1, 0)]
    df = spark.createDataFrame(rows, "application_id long, a int, approved int")
    w = mitigate.reweigh_weights(df, ["a"]).collect()
    assert len(w) == 3
    assert all(r["weight"] is not None for r in w)


def test_repair_level_zero_is_identity(spark):
    df = _df(spark)
    rep = mitigate.repair_disparate_impact(df, ["x", "z"], "a", level=0.0)
    a = {r[0]: (r[1], r[2]) for r in df.select("application_id", "x", "z").collect()}
    b = {r[0]: (r[1], r[2]) for r in rep.select("application_id", "x", "z").collect()}
    for k in a:
        assert b[k][0] == pytest.approx(a[k][0]) and b[k][1] == pytest.approx(a[k][1])


def test_repair_preserves_order_within_group_and_aligns_groups(spark):
    df = _df(spark, n=2000)
    rep = mitigate.repair_disparate_impact(df, ["x"], "a", level=1.0).select("application_id", "a", "x")
    orig = {r[0]: r[1] for r in df.select("application_id", "x").collect()}
    rows = rep.collect()
    for g in (0, 1):
        pairs = sorted((orig[r[0]], r[2]) for r in rows if r[1] == g)
        repaired = [p[1] for p in pairs]
        assert all(b >= a - 1e-12 for a, b in zip(repaired, repaired[1:]))
    gap_before = mitigate.group_gap(df, ["x"], "a").first()
    gap_after = mitigate.group_gap(rep, ["x"], "a").first()
    assert abs(gap_after["mean_unprivileged"] - gap_after["mean_privileged"]) < 0.05
    assert gap_after["ks_distance"] < gap_before["ks_distance"] / 5


def test_repair_keeps_nulls_and_labels(spark):
    df = _df(spark).withColumn("x", F.when(F.col("application_id") % 10 == 0, None).otherwise(F.col("x")))
    rep = mitigate.repair_disparate_impact(df, ["x"], "a")
    assert rep.filter(F.col("x").isNull()).count() == df.filter(F.col("x").isNull()).count()
    a = {r[0]: r[1] for r in df.select("application_id", "approved").collect()}
    b = {r[0]: r[1] for r in rep.select("application_id", "approved").collect()}
    assert a == b


def test_repair_with_one_group_is_identity(spark):
    df = _df(spark).withColumn("a", F.lit(1))
    rep = mitigate.repair_disparate_impact(df, ["x"], "a")
    a = {r[0]: r[1] for r in df.select("application_id", "x").collect()}
    b = {r[0]: r[1] for r in rep.select("application_id", "x").collect()}
    assert a == b


def test_one_fit_for_several_attributes(spark):
    """One fit for all attributes gives each attribute's own repair, also as
    new columns and with several blocks and buckets of edges."""
    df = _df(spark).withColumn("b", (F.col("application_id") % 3 == 0).cast("int"))
    edges = mitigate.repair_edges(df, ["x"], ["a", "b"], coarse_buckets=7)
    for attr in ["a", "b"]:
        one = {r[0]: r[1] for r in mitigate.repair_disparate_impact(df, ["x"], attr).select("application_id", "x").collect()}
        new = mitigate.repaired_columns(df, edges, ["x"], attr, names={"x": "x2"})
        assert {r[0]: r[1] for r in new.select("application_id", "x2").collect()} == one
        assert new.columns == [*df.columns, "x2"]


def test_repair_resolution_follows_the_parameter(spark):
    df = _df(spark)
    fine, coarse = (mitigate.repair_disparate_impact(df, ["x"], "a", max_buckets=n).select("x").distinct().count()
                    for n in (200, 5))
    assert coarse <= 5 < fine


def test_repair_plan_does_not_shuffle_the_rows(spark):
    """Nor join by value, with as many buckets as the smaller group has rows."""
    df = _df(spark, n=6000)
    plan = mitigate.repair_disparate_impact(df, ["x"], "a")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_weights_by_typed_keys(spark):
    """Boolean, null and text ``by`` values get the weights of their own cells."""
    rows = [(i, i % 2, (i // 6) % 2, [True, False, None][i % 3]) for i in range(240)]
    df = spark.createDataFrame([(i, int(y), int(g), b) for i, g, y, b in rows], "id long, approved int, a50 int, part boolean")
    for by in (F.col("part"), F.when(F.col("part"), "a|b").when(~F.col("part"), "a"), F.col("part").cast("int")):
        d = df.withColumn("part", by)
        w = mitigate.reweigh_weights(d, ["a50"], by=["part"])
        out = mitigate.apply_weights(d, w, "a50", by=["part"])
        assert out.count() == 240 and out.filter("weight is null").count() == 0
        assert abs(out.agg(F.sum("weight")).first()[0] - 240) < 1e-6


def test_repair_resolution_follows_the_smaller_group(spark, monkeypatch):
    """Groups of more than 1,000 rows: as many buckets as the smaller group has
    rows, equal to a per-row computation, by arrays or by a join."""
    df = spark.range(5200).selectExpr("id AS application_id", "CAST(id % 5 < 2 AS INT) AS a",
                                      "CAST(CASE WHEN id % 97 <> 0 THEN pmod(id * 7919, 10007) + IF(id % 5 < 2, 900, 0) "
                                      "END AS DOUBLE) AS x")
    got = {r[0]: r[1] for r in mitigate.repair_disparate_impact(df, ["x"], "a").select("application_id", "x").collect()}
    d = df.toPandas()
    known = d[d.x.notna()].copy()
    size = known.groupby("a").x.transform("size")
    bb = int(size.min())
    rank = known.groupby("a").x.rank(method="average") - 0.5
    known["b"] = np.minimum(np.floor(rank / size * bb), bb - 1).astype(int)
    filled = [m.reindex(range(bb)).ffill().bfill() for _, m in known.groupby(["a", "b"]).x.mean().groupby(level=0)
              for m in [m.droplevel(0)]]
    mid = sum(filled) / 2
    want = dict(zip(known.application_id, known.b.map(mid)))
    assert bb > 2000 and len(set(want.values())) > 1000
    assert len(got) == 5200 and all(got[i] is None for i in d[d.x.isna()].application_id)
    assert all(got[i] == pytest.approx(v) for i, v in want.items())
    monkeypatch.setattr(mitigate, "FILL_RUN", 300)
    monkeypatch.setattr(mitigate, "ARRAY_EDGES", 10)
    again = mitigate.repair_disparate_impact(df, ["x"], "a").select("application_id", "x").collect()
    assert {r[0]: r[1] for r in again} == got


def test_repair_fitted_by_group_equals_the_joins(spark, monkeypatch):
    """Few distinct values once went through the joins of any size, and their
    number of buckets, not of edges, chose the join by value."""
    nan = float("nan")
    df = spark.range(3000).selectExpr(
        "id AS application_id", "CAST(id % 5 < 2 AS INT) AS a", "CAST(IF(id % 11 = 0, NULL, id % 3 = 0) AS INT) AS b", "1 AS one",
        "CAST(IF(id % 97 = 0, NULL, pmod(id * 7919, 1009) / 8 + IF(id % 5 < 2, 40, 0)) AS DOUBLE) AS x",
        "CAST(IF(id % 5 < 2, id % 7, 100 + id % 4) AS DOUBLE) AS y", "CAST(NULL AS DOUBLE) AS z")
    df = df.withColumn("x", F.when(F.col("application_id") % 500 == 7, F.lit(nan)).otherwise(F.col("x")))
    names = {f: f"{f}2" for f in "xyz"}

    def fit(max_buckets=None):
        edges, out = mitigate.repair_edges(df, list("xyz"), ["a", "b", "one"], max_buckets), {}
        for a in ("a", "b", "one"):
            new = mitigate.repaired_columns(df, edges, list("xyz"), a, 0.7, names)
            out[a] = [tuple(map(repr, r)) for r in new.orderBy("application_id").select(*names.values()).collect()]
        return "mid" in edges.columns, out

    def no_joins(*_):
        raise AssertionError("the buckets were filled by joins")

    monkeypatch.setattr(mitigate, "ARRAY_EDGES", 4000)
    monkeypatch.setattr(mitigate, "GROUP_VALUES", 0)
    joined, coarse = fit(), fit(5)
    monkeypatch.setattr(mitigate, "GROUP_VALUES", 1_000_000)
    monkeypatch.setattr(mitigate, "_filled", no_joins)
    assert fit() == joined and fit(5) == coarse and not joined[0]
    # More rows than edges: at most one edge a distinct value.
    monkeypatch.setattr(mitigate, "ARRAY_EDGES", 1400)
    assert "mid" not in mitigate.repair_edges(df, list("xyz"), ["a", "b", "one"]).columns
    monkeypatch.setattr(mitigate, "ARRAY_EDGES", 10)
    assert fit() == (True, joined[1])


def test_repair_by_value_joins_once_per_feature(spark, monkeypatch):
    """Every attribute once joined the rows to one row per (attribute, feature,
    group, value): 36 joins for the six features of the grid, each shuffling all
    columns made so far. Blocks and runs of any size give the same bits."""
    nan = float("nan")
    df = spark.range(2000).selectExpr(
        "id AS application_id", "CAST(id % 5 < 2 AS INT) AS a", "CAST(IF(id % 11 = 0, NULL, id % 3 = 0) AS INT) AS b", "1 AS one",
        "CAST(IF(id % 97 = 0, NULL, pmod(id * 7919, 1009) / 7.3 + IF(id % 5 < 2, 40, 0)) AS DOUBLE) AS x",
        "CAST(IF(id % 5 < 2, id % 7, 100 + id % 4) AS DOUBLE) / 0.7 AS y", "CAST(NULL AS DOUBLE) AS z")
    df = df.withColumn("x", F.when(F.col("application_id") % 500 == 7, F.lit(nan)).otherwise(F.col("x")))
    names = {a: {f: f"{f}_{a}" for f in "xyz"} for a in ("a", "b", "one")}

    def fit(max_buckets=None):
        edges = mitigate.repair_edges(df, list("xyz"), list(names), max_buckets)
        new = mitigate.repaired_attributes(df, edges, list("xyz"), names, 0.7)
        assert new.columns == [*df.columns, *[n for a in names.values() for n in a.values()]]
        return new, [tuple(map(repr, r)) for r in new.orderBy("application_id").collect()], edges

    want = {n: fit(n)[1] for n in (None, 9)}
    monkeypatch.setattr(mitigate, "ARRAY_EDGES", 3)
    for values, runs in ((100_000, 100_000), (37, 10)):
        monkeypatch.setattr(mitigate, "BLOCK_VALUES", values)
        monkeypatch.setattr(mitigate, "FILL_RUN", runs)
        for n, rows in want.items():
            new, got, edges = fit(n)
            assert got == rows and "mid" in edges.columns and edges.count() == df.select("x").distinct().count() - 1 + 11
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("Join LeftOuter") <= 3
    # Values that the fit has not seen, at all or in the row's group.
    for other in ("CAST(0.123 AS DOUBLE)", "CAST(0.0 AS DOUBLE)"):
        with pytest.raises(Exception, match="not fitted on"):
            mitigate.repaired_columns(df.selectExpr("application_id", "0 AS a", f"{other} AS y"), edges, ["y"], "a").collect()


def test_package_is_shipped_once_by_threads(spark, monkeypatch):
    """Both splits' repair is fitted at once, and both found it not shipped."""
    import time
    from concurrent.futures import ThreadPoolExecutor

    from equiloan import session

    sent = []
    monkeypatch.setattr(session, "_SHIPPED", set())
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: (time.sleep(0.5), sent.append(path)))
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(session.ship_package, [spark] * 3))
    assert len(sent) == 1
