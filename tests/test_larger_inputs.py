"""Steps that must spread over the cores, and hold bounded parts, on larger
tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from equiloan.operators import models, sharedfit
from equiloan.operators.sharedfit import Arm, Layout

FEATS = ["f1", "f2", "f3"]


@pytest.fixture(scope="module")
def train(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + rng.normal(size=400) * 0.5 > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))],
                               "application_id long, f1 double, f2 double, f3 double, approved int")
    path = str(tmp_path_factory.mktemp("sf") / "train")
    df.repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def test_spread_fills_whole_waves(spark):
    n = spark.sparkContext.defaultParallelism
    parts = lambda k: models.spread(spark.range(1000).repartition(k)).rdd.getNumPartitions()
    assert [parts(n + 1), parts(n), parts(1), parts(20 * n + 1)] == [2 * n, n, n, 20 * n + 1]


def test_forest_keeps_node_ids(train):
    rf = models.fit_forest(train, FEATS, num_trees=3, max_depth=3).pipeline.stages[-1]
    assert rf.getOrDefault("cacheNodeIds") and rf.getOrDefault("checkpointInterval") == -1


def test_small_nodes_are_grown_by_one_job(train, monkeypatch):
    written, real = [], sharedfit.materialize
    monkeypatch.setattr(sharedfit, "materialize", lambda df, name: written.append(name) or real(df, name))
    monkeypatch.setattr(sharedfit, "PIECE_BYTES", 100)
    layout = Layout("application_id", "approved", [], [FEATS])
    fit = sharedfit.fit_arms(train, layout, [Arm("m", "rf", trees=3, depth=4)])
    assert written == ["forest-nodes"] and (fit.params["m"]["size"] > 1).all()


def test_tree_ranges_end_at_settings_and_at_the_limit():
    assert sharedfit._tree_ranges([5, 5, 5, 20, 5], [2, 5], 10) == [(0, 2), (2, 3), (3, 4), (4, 5)]


def test_tuning_in_many_passes_holds_one_forest(train, monkeypatch):
    grid = {"numTrees": [2, 4], "maxDepth": [2, 5], "minInstancesPerNode": [1]}
    _, _, rows = sharedfit.tune_forest(train, FEATS, grid=grid, folds=2)
    fitted, real = [], sharedfit.fit_arms
    monkeypatch.setattr(sharedfit, "PASS_NODES", 1)
    monkeypatch.setattr(sharedfit, "fit_arms", lambda *a, **b: fitted.append(len(a[2])) or real(*a, **b))
    _, _, again = sharedfit.tune_forest(train, FEATS, grid=grid, folds=2)
    assert again == rows and fitted == [1, 1, 1]


def test_denial_chart_fits_the_denial_models_alone(spark, tmp_path, monkeypatch):
    from equiloan.plans import q_models

    made = []

    def score(df, name):
        made.append(name)
        return spark.createDataFrame([(name, "test", 1, 1, 0.5, None, None, None)], "query string, split string, n long, "
                                     "n_decided long, accuracy double, f1 double, recall double, precision double")

    monkeypatch.setattr(q_models, "_score_rows", score)
    monkeypatch.setattr(q_models, "_data", lambda *a: spark.range(1))
    monkeypatch.setattr(q_models, "_TABLES", {})
    monkeypatch.setattr(q_models.views, "versions", lambda *a: [("t",)])
    assert q_models.q_denial_plot_series(spark, str(tmp_path)).count() > 0
    assert sorted(made) == sorted(q_models.DENIAL_MODELS)
    assert q_models.q_fit_scores(spark, str(tmp_path)).filter(F.col("n") == 1).count() == 7 and len(made) == 7


def test_repair_keeps_its_edges_out_of_the_rows(spark):
    """Rows once carried the whole arrays of edges through the lookup."""
    from equiloan.operators import mitigate

    nan = float("nan")
    rows = [(i, float(i * i % 97), i % 2) for i in range(300)] + [(900, None, 1), (901, 5.0, None), (902, nan, 0), (903, nan, 1)]
    df = spark.createDataFrame(rows, "application_id long, x double, a int")
    edges = mitigate.repair_edges(df, ["x"], "a")
    new = mitigate.repaired_columns(df, edges, ["x"], "a", 0.5, {"x": "y"})
    assert "hi_0" not in new._jdf.queryExecution().optimizedPlan().toString()
    (e0, e1) = ({r["g"]: r for r in edges.collect()}[g] for g in (0, 1))
    top = lambda v: v if v == v else float("inf")  # noqa: E731 - unknown numbers sort last
    for r in new.collect():
        e = {0: e0, 1: e1}.get(r["a"])
        want = r["x"]
        if e is not None and want is not None:
            below = sum(top(h) < top(want) for h in e["hi_0"])
            want = 0.5 * want + 0.5 * e["mid_0"][min(below, len(e["hi_0"]) - 1)]
        assert r["y"] == want or (r["y"] != r["y"] and want != want)


def test_fits_deal_their_rows_evenly_and_keep_them(train, spark, monkeypatch):
    """Files are read in as many parts as they happen to give, so a pass took a
    second, nearly empty wave, and every pass decoded them again."""
    seen, real = [], sharedfit._evaluate
    monkeypatch.setattr(sharedfit, "_evaluate", lambda rows, tasks, *a: seen.append((tasks, rows.is_cached)) or real(
        rows, tasks, *a))
    n = spark.sparkContext.defaultParallelism
    sharedfit.fit_arms(train.repartition(n + 1), Layout("application_id", "approved", [], [FEATS]), [Arm("lr", "lr")])
    assert set(seen) == {(2 * n, True)} and not spark.sparkContext._jsc.getPersistentRDDs()


def test_network_sums_in_small_parts(monkeypatch):
    rng = np.random.default_rng(5)
    x, y, w = rng.normal(size=(50, 3)), rng.integers(0, 2, 50).astype(float), rng.random(50)
    point = sharedfit._first_network(sharedfit._layers(3), 1)
    whole = sharedfit._network_sums(x, y, w, point)
    monkeypatch.setattr(sharedfit, "CACHED_ROWS", 7)
    assert np.allclose(sharedfit._network_sums(x, y, w, point), whole, rtol=1e-12)
    alone = sum(sharedfit._network_sums(x[i:i + 1], y[i:i + 1], w[i:i + 1], point) for i in range(50))
    assert np.allclose(alone, whole, rtol=1e-10)


def test_rows_of_a_small_node_travel_in_ten_bytes(train, monkeypatch):
    """24 bytes a row and tree once went through the shuffle."""
    sizes, real = [], sharedfit.grow

    def grow(bins, y, w, c, node, *rest):
        sizes.append((bins.itemsize * bins.shape[1], c.itemsize, sorted(set(w.tolist()))))
        return real(bins, y, w, c, node, *rest)

    assert [c.split()[0] for c in sharedfit._PIECE.split(", ")][3:] == ["node", "bins", "y", "c", "g"]
    assert sharedfit._number_type(np.arange(1)).itemsize == 1 and sharedfit._number_type(np.arange(400)).itemsize == 2
    found = grow(np.array([[0, 1], [3, 1], [3, 0]], np.uint8), np.array([0.0, 1.0, 1.0]), np.array([0.5, 2.0, 2.0]),
                 np.array([1, 2, 1], np.uint8), np.ones(3, np.int64), Arm("m", "rf", depth=2), 0, 1)
    assert found["w0"][0] == 0.5 and found["w1"][0] == 6.0 and sizes == [(2, 1, [0.5, 2.0])]


def test_passes_read_packed_rows(train, monkeypatch):
    """Every pass once took the values of all columns over one by one."""
    seen, real = [], sharedfit._evaluate
    monkeypatch.setattr(sharedfit, "_evaluate", lambda rows, *a: seen.append((rows.columns, rows.count())) or real(rows, *a))
    layout = Layout("application_id", "approved", [], [FEATS])
    fit = sharedfit.fit_arms(train.repartition(2), layout, [Arm("lr", "lr"), Arm("rf", "rf", trees=1, depth=2)])
    names = [c.split()[0] for c in sharedfit._Packed.SCHEMA.split(", ")]
    assert {tuple(c) for c, _ in seen} == {tuple(names)} and {n for _, n in seen} == {
        train.sparkSession.sparkContext.defaultParallelism}

    unknown = train.sparkSession.createDataFrame(
        [(1, 1, 0.5, None, 2.0), (2, None, 1.0, 2.0, 3.0), (3, 0, float("nan"), 2.0, 3.0), (4, 0, 1.5, 2.5, 3.5)],
        ["application_id", "approved", *FEATS]).coalesce(1)
    raw = layout.select(unknown)
    batches = [b for b in raw.toArrow().to_batches() if b.num_rows]
    packed = sharedfit._pack(raw, layout, fit, {"lr", "rf"}).toArrow().to_batches()
    rows = [r for b in packed for r in sharedfit._Packed.of(b, layout)]
    assert len(batches) == len(rows) == 1
    want, got = sharedfit._Rows(batches[0], layout), rows[0]
    assert got.known.tolist() == [[False, True, False, True]] and (got.scaled(0, fit) == want.scaled(0, fit)).all()
    for a, b in ((got.k, want.k), (got.fold, want.fold), (got.y, want.y), (got.binned(0, fit), want.binned(0, fit))):
        assert np.array_equal(a, b, equal_nan=a.dtype == float)
    arm, none = Arm("lr", "lr"), np.zeros((0, 2, 2))
    assert got.weight(arm, none).tolist() == want.weight(arm, none).tolist() == [0.0, 0.0, 0.0, 1.0]


def test_repair_of_both_splits_is_fitted_at_once(spark, monkeypatch):
    """The jobs of the second split once waited for those of the first."""
    from threading import Barrier

    from equiloan.operators import mitigate, models

    class Met(Exception):
        pass

    both = Barrier(2, timeout=60)

    def repair_edges(*_):
        both.wait()
        raise Met

    monkeypatch.setattr(mitigate, "repair_edges", repair_edges)
    df = spark.createDataFrame([(i, i % 2, i % 2, float(i), "train" if i % 3 else "test") for i in range(12)],
                               "application_id long, approved int, a50 int, x double, split string")
    with pytest.raises(Met):
        models.fit_grid_packed(df, ["x"], models.model_grid(["lr"], ["repair"], ["a50"]))


def test_trees_are_finished_in_waves(train, spark, monkeypatch):
    """The rows of all trees once went through one shuffle, whose files grew with
    rows times trees, and the tables of nodes stayed until the session's end."""
    from equiloan import session

    layout, arms = Layout("application_id", "approved", [], [FEATS]), [Arm("m", "rf", trees=3, depth=4), Arm("o", "rf", trees=2)]
    whole = sharedfit.fit_arms(train, layout, arms, local_rows=150)
    written, real = [], sharedfit.materialize
    monkeypatch.setattr(sharedfit, "materialize", lambda df, name: written.append(real(df, name)) or written[-1])
    monkeypatch.setattr(sharedfit, "WAVE_BYTES", 1)
    waves = sharedfit.fit_arms(train, layout, arms, local_rows=150)
    assert len(written) == 5
    kept = [p for p in session._HANDED_OUT[spark.sparkContext.applicationId] if "/forest-nodes-" in p]
    assert not any(p.rsplit("/", 1)[-1] in f for p in kept for t in written for f in t.inputFiles()[:1])
    for a in arms:
        assert all((waves.params[a.model_id][k] == whole.params[a.model_id][k]).all() for k in whole.params[a.model_id])


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    from equiloan import session
    from equiloan.operators.cumulative import materialize

    status = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in (status.getAllFiles().apply(i) for i in range(status.getAllFiles().size()))
                     if f.getName().startswith("shuffle_")}
    before = files()
    table = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    left = {f for f in files() - before if f.endswith(".data")}
    assert not left and table.count() == 7
    assert spark.conf.get(session._FILE_CLEANUP) == "false"
    folder = table.inputFiles()[0].rsplit("/", 1)[0]
    session.discard(table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)


def test_tuning_holds_no_forest(train, monkeypatch):
    """The driver once held every forest of the tuning, 26 bytes a node."""
    grid = {"numTrees": [2, 4], "maxDepth": [2, 5], "minInstancesPerNode": [1]}
    fits, real = [], sharedfit.fit_arms
    monkeypatch.setattr(sharedfit, "fit_arms", lambda *a, **b: fits.append(real(*a, **b)) or fits[-1])
    small, best, rows = sharedfit.tune_forest(train, FEATS, grid=grid, folds=2)
    assert [len(f.params) for f in fits] == [0, 0, 1] and isinstance(small.params["best"], dict)
    monkeypatch.setattr(sharedfit, "PASS_NODES", 1)
    monkeypatch.setattr(sharedfit, "WAVE_BYTES", 1)
    large, _, again = sharedfit.tune_forest(train, FEATS, grid=grid, folds=2, local_rows=60)
    forest = large.params["best"]
    assert again == rows and isinstance(forest, sharedfit.StoredForest) and forest.arrays is None
    decided = [sorted(map(str, sharedfit.score(f, train, [best], ["application_id"]).collect())) for f in (small, large)]
    assert decided[0] == decided[1]
