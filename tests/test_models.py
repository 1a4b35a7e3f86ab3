import numpy as np
import pytest
from pyspark.sql import functions as F

from equiloan.operators import models, splits


def _data(spark, n=1200, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int)
    rows = [(i, float(a), float(b), float(c), int(t), float(1 + (i % 3))) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "application_id long, f1 double, f2 double, f3 double, approved int, w double")
    return splits.random_split(df)


FEATS = ["f1", "f2", "f3"]


def _acc(p):
    return p.select(F.avg((F.col("approved") == F.col("prediction")).cast("double"))).first()[0]


def test_forest_learns_separable_data(spark):
    df = _data(spark)
    train, test = df.filter("split = 'train'"), df.filter("split = 'test'")
    m = models.fit_forest(train, FEATS, num_trees=10, max_depth=5)
    p = models.predict(m, test, ["application_id", "approved"])
    assert _acc(p) > 0.85
    imp = models.feature_importance(m)
    assert imp[-1][0] == "f1"


def test_logistic_and_weights_change_the_fit(spark):
    df = _data(spark)
    train = df.filter("split = 'train'")
    a = models.fit_logistic(train, FEATS, max_iter=50)
    b = models.fit_logistic(train, FEATS, weight="w", max_iter=50)
    ca = a.pipeline.stages[-1].coefficients.toArray()
    cb = b.pipeline.stages[-1].coefficients.toArray()
    assert not np.allclose(ca, cb)
    assert _acc(models.predict(a, train, ["application_id", "approved"])) > 0.85


def test_mlp_with_replicated_weights(spark):
    df = _data(spark)
    train = df.filter("split = 'train'")
    rep = models.replicate_by_weight(train, "w")
    weights = {r["w"]: r["count"] for r in train.groupBy("w").count().collect()}
    n, total = train.count(), sum(w * c for w, c in weights.items())
    assert abs(rep.count() - n) <= len(weights) / 2
    for r in rep.groupBy("w").count().collect():  # copies of a weight, to within one half
        assert abs(r["count"] - r["w"] * weights[r["w"]] * n / total) <= 0.5 + 1e-6
    again = models.replicate_by_weight(train.repartition(7), "w")
    assert sorted(again.select("application_id").collect()) == sorted(rep.select("application_id").collect())
    m = models.fit_mlp(train, FEATS, hidden=(8,), weight="w", max_iter=60)
    assert _acc(models.predict(m, train, ["application_id", "approved"])) > 0.8


def test_multiclass_reindex_and_back(spark):
    df = _data(spark).withColumn("cls", (F.col("approved") * 9 + 1).cast("int"))  # classes 1 and 10
    m = models.fit_mlp(df, FEATS, label="cls", hidden=(8,), multiclass=True, max_iter=40)
    assert m.classes == [1, 10]
    vals = {r[0] for r in models.predict(m, df).select("prediction").distinct().collect()}
    assert vals <= {1, 10}


def test_save_and_load_give_equal_predictions(spark, tmp_path):
    from equiloan.sources import sinks

    df = _data(spark)
    m = models.fit_forest(df, FEATS, num_trees=5, max_depth=4)
    path = str(tmp_path / "m")
    sinks.save_model(m.pipeline, path)
    loaded = models.FittedModel(sinks.load_model(path), FEATS, "approved")
    a = {r[0]: r[1] for r in models.predict(m, df).select("application_id", "prediction").collect()}
    b = {r[0]: r[1] for r in models.predict(loaded, df).select("application_id", "prediction").collect()}
    assert a == b


def test_reports_of_fitted_models_hold_values(spark):
    """R1, R3, R4 and R6 of a small grid against a count over its predictions."""
    from equiloan.operators import parity, report
    from equiloan.operators.cumulative import materialize

    attrs = ["a50", "a60"]
    df = _data(spark, 600).withColumn("a50", (F.col("f1") > 0.2).cast("int")).withColumn(
        "a60", (F.col("f3") > 0).cast("int"))
    grid = models.model_grid(["lr"], ["reweighing", "repair"], attrs)
    preds = materialize(models.fit_grid(df, FEATS, grid, logistic_iter=20))
    ct = parity.contingency(preds, attrs, decision="prediction", by=["model_id", "split"])
    p = preds.filter("split = 'test'").toPandas()

    def rate(model, attr, g):
        x = p[(p.model_id == model) & (p[attr] == g)]
        return x.prediction.mean()

    diff = lambda m, a: rate(m, a, 0) - rate(m, a, 1)
    res = {(r["model_id"], r["metric"]): r for r in report.grid_results(ct, attrs).filter("split = 'test'").collect()}
    assert len(res) == len(grid) * (len(parity.METRIC_NAMES) + 4)
    x = p[p.model_id == "lr_original"]
    assert res["lr_original", "accuracy"]["a50"] == pytest.approx((x.prediction == x.approved).mean(), abs=1e-6)
    for a in attrs:
        assert res["lr_repair_a60", "decision_parity_difference"][a] == pytest.approx(diff("lr_repair_a60", a), abs=1e-6)
    apr = report.approval_series(ct, ["model_id", "split"]).filter(
        "split = 'test' and model = 'decision' and model_id = 'lr_repair_a50' and attribute = 'a50' and g = 1").first()
    assert apr["approval_rate"] == pytest.approx(rate("lr_repair_a50", "a50", 1), abs=1e-6)
    cmp = {r["attribute"]: r for r in report.grid_comparison(ct, grid, attrs, "decision_parity_difference")
           .filter("split = 'test'").collect()}
    series = {(r["section"], r["category"], r["metric"], r["threshold"]): r["value"] for r in report.grid_plot_series(
        ct, grid, attrs, {"parity": ["decision_parity_difference"], "scores": ["f1"]}).collect()}
    assert len(series) == 2 * 2 * 3 * len(attrs)
    for a in attrs:
        for c, m in (("original", "lr_original"), ("reweighed", f"lr_reweighing_{a}"), ("repaired", f"lr_repair_{a}")):
            assert cmp[a][f"decision_parity_difference_{c}"] == pytest.approx(diff(m, a), abs=1e-6)
            assert series["parity test", c, "decision_parity_difference", int(a[1:])] == pytest.approx(diff(m, a), abs=1e-6)
        assert cmp[a]["change_repaired"] == pytest.approx(diff(f"lr_repair_{a}", a) - diff("lr_original", a), abs=2e-6)
