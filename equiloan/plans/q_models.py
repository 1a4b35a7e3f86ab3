"""Registered queries: models (L1-L10), model persistence (S6), timings.

Models are fitted at the workflow's sizes (120 trees; the 8-point grid; up to
1,000 logistic iterations; all six attributes and 39 models). What a fit
decides cannot be said in SQL, so the SQL of these queries is an invariant
check, not a value check: every row of either split is decided, scores lie in
their range, a seeded repeat decides alike, grids are complete. Everything
computed *from* decisions is value-checked elsewhere on the scorecard decision.
"""

from __future__ import annotations

import threading
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from equiloan.constants import ATTRIBUTES, PREDICTORS, TUNE_GRID
from equiloan.functions.columns import round6
from equiloan.operators import compose, mitigate, models, parity, prep, report, sharedfit, splits
from equiloan.operators.cumulative import materialize
from equiloan.plans import oracle as O
from equiloan.plans import views
from equiloan.plans.q_metrics import PLOT_METRICS
from equiloan.plans.registry import register
from equiloan.session import shared_path
from equiloan.sources import sinks

ATTR = "a50"
MLP_ITERATIONS = 100


def _data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared table with the T1 split, stored once for the many passes of
    the learners (only the columns models use)."""
    prepared = prep.primary_denial_reason(views.labelled(spark, sf_dir)).select(
        "application_id", *PREDICTORS, "approved", *ATTRIBUTES, "tract_minority_population_percent",
        "primary_denial_reason")
    return materialize(models.spread(splits.stratified_split(prep.equal_width_bins(prepared))), "model-table")


def _train(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split") == "train")


def _reweighed(df: DataFrame) -> DataFrame:
    train = _train(df)
    return mitigate.apply_weights(train, mitigate.reweigh_weights(train, [ATTR]), ATTR)


SCORES = ["accuracy", "f1", "recall", "precision"]


def _scored(model: models.FittedModel, df: DataFrame, label: str = "approved") -> tuple[DataFrame, bool]:
    """Per split: rows, rows decided and the scores (the accuracy alone with
    more than two classes), and whether there are only two."""
    pred = materialize(models.predict(model, df, ["application_id", "split", label]), "predictions")
    n = pred.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("prediction").alias("n_decided"))
    binary = model.classes is None and df.select(label).distinct().count() <= 2
    sc = (parity.binary_scores(pred, label, "prediction", by=["split"]) if binary
          else parity.multiclass_accuracy(pred, label, "prediction", by=["split"]).drop("n"))
    return n.join(sc, "split"), binary


def _checked(model: models.FittedModel, df: DataFrame, label: str = "approved") -> DataFrame:
    """Per split: rows, rows decided, and whether the scores lie in 0..1 (and
    the accuracy beats a fair coin between the classes)."""
    sc, binary = _scored(model, df, label)
    cols, floor = (SCORES, 0.5) if binary else (["accuracy"], 0.0)
    ok = F.col("accuracy") >= floor
    for c in cols:
        ok = ok & F.coalesce(F.col(c).between(0, 1), F.lit(True))
    return sc.select("split", "n", "n_decided", ok.alias("scores_valid"))


COVERED_SQL = O.with_inputs("SELECT split, COUNT(*) AS n, COUNT(*) AS n_decided, TRUE AS scores_valid "
                            "FROM splitted GROUP BY split", *O.split_ctes())


_TABLES: dict[tuple, str] = {}
_TABLES_LOCK = threading.RLock()


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """The table ``build`` makes, made once per application and version of the
    input files, for the queries that report on the same fits."""
    key = (spark.sparkContext.applicationId, name, *views.versions(spark, sf_dir))
    with _TABLES_LOCK:
        if key not in _TABLES:
            path = shared_path(spark, name)
            build().write.parquet(path)
            _TABLES[key] = path
        return spark.read.parquet(_TABLES[key])


@register("fit_forest", COVERED_SQL)
def q_fit_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: random forest (120 trees, depth 10) on the training split,
    reweighed for a50 (weightCol)."""
    df = _data(spark, sf_dir)
    return _checked(models.fit_forest(_reweighed(df), PREDICTORS, weight="weight"), df)


@register("fit_forest_tuned_size", COVERED_SQL)
def q_fit_forest_tuned_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, second configuration: 100 trees, depth 10, 16 bins."""
    df = _data(spark, sf_dir)
    return _checked(models.fit_forest_tuned_size(_train(df), PREDICTORS), df)


@register("feature_importance", "SELECT UNNEST([" + ", ".join(f"'{p}'" for p in PREDICTORS)
          + "]) AS feature, TRUE AS ascending, TRUE AS sums_to_one")
def q_feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 + R5: the 120-tree forest's importances: every predictor once, in
    ascending order, shares of one (the library returns the values)."""
    values = [(r["feature"], r["importance"]) for r in _importances(spark, sf_dir).orderBy("rank").collect()]
    total = sum(v for _, v in values)
    rows = [(f, i == 0 or values[i - 1][1] <= v, abs(total - 1) < 1e-6) for i, (f, v) in enumerate(values)]
    return spark.createDataFrame(rows, "feature string, ascending boolean, sums_to_one boolean")


def _importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        found = models.feature_importance(models.fit_forest(_train(_data(spark, sf_dir)), PREDICTORS))
        return spark.createDataFrame([(i, f, float(v)) for i, (f, v) in enumerate(found)],
                                     "rank int, feature string, importance double")

    return _once(spark, sf_dir, "importances", build)


@register("feature_importance_values")
def q_feature_importance_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 + R5: the importances of the 120-tree forest, ascending by rank."""
    return _importances(spark, sf_dir)


_GRID_SQL = O.with_inputs(
    "SELECT t AS num_trees, d AS max_depth, m AS min_instances, n AS n_train, TRUE AS accuracy_valid FROM "
    f"(SELECT CAST(UNNEST({TUNE_GRID['numTrees']}) AS INT) AS t), (SELECT CAST(UNNEST({TUNE_GRID['maxDepth']}) AS INT) AS d), "
    f"(SELECT CAST(UNNEST({TUNE_GRID['minInstancesPerNode']}) AS INT) AS m), "
    "(SELECT COUNT(*) AS n FROM splitted WHERE split = 'train')", *O.split_ctes())
_GRID_COLUMNS = "num_trees int, max_depth int, min_instances int, n_train long"


@register("tune_forest", _GRID_SQL)
def q_tune_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: 3-fold cross-validation over the whole grid (trees x depth x leaf
    size, 8 settings), the best refitted; a mean accuracy per setting."""
    return _tuned(spark, sf_dir).select("num_trees", "max_depth", "min_instances", "n_train",
                                        F.col("accuracy").between(0.5, 1.0).alias("accuracy_valid"))


def _tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        train = _train(_data(spark, sf_dir))
        n, (_, _, rows) = train.count(), sharedfit.tune_forest(train, PREDICTORS, folds=3)
        return spark.createDataFrame([(t, d, m, n, float(acc)) for t, d, m, acc in rows], _GRID_COLUMNS + ", accuracy double")

    return _once(spark, sf_dir, "tuning", build)


@register("tune_forest_values")
def q_tune_forest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: the mean accuracy of every setting of the grid."""
    return _tuned(spark, sf_dir)


@register("fit_logistic", COVERED_SQL)
def q_fit_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: logistic regression (up to 1,000 iterations) on standardised
    predictors, reweighed for a50."""
    df = _data(spark, sf_dir)
    return _checked(models.fit_logistic(_reweighed(df), PREDICTORS, weight="weight"), df)


@register("fit_logistic_denial", COVERED_SQL)
def q_fit_logistic_denial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multinomial logistic regression on the primary denial reason."""
    df = _data(spark, sf_dir)
    m = models.fit_logistic(_train(df), PREDICTORS, label="primary_denial_reason", multinomial=True)
    return _checked(m, df, "primary_denial_reason")


@register("fit_mlp", COVERED_SQL)
def q_fit_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multilayer perceptron 6-64-32-2 on standardised predictors;
    reweighing weights honoured by a deterministic resample per weight, as
    many rows as the split has."""
    df = _data(spark, sf_dir)
    return _checked(models.fit_mlp(_reweighed(df), PREDICTORS, weight="weight", max_iter=MLP_ITERATIONS), df)


@register("fit_mlp_denial", COVERED_SQL)
def q_fit_mlp_denial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiclass perceptron on the denial reason (classes re-indexed)."""
    df = _data(spark, sf_dir)
    m = models.fit_mlp(_train(df), PREDICTORS, label="primary_denial_reason", multiclass=True, max_iter=MLP_ITERATIONS)
    return _checked(m, df, "primary_denial_reason")


@register("fit_forest_denial", COVERED_SQL)
def q_fit_forest_denial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random forest (120 trees) on the denial reason."""
    df = _data(spark, sf_dir)
    return _checked(models.fit_forest(_train(df), PREDICTORS, label="primary_denial_reason"), df, "primary_denial_reason")


@register("fit_scores")
def q_fit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, F1, recall and precision per split of every model
    that the fit_* queries fit (the accuracy alone on denial reasons)."""
    return _fit_scores(spark, sf_dir, FITS)


DENIAL_MODELS = {"fit_forest_denial": "rf", "fit_mlp_denial": "mlp", "fit_logistic_denial": "lr"}


@register("denial_plot_series")
def q_denial_plot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The denial chart, accuracy of the three denial-reason models per
    split at every threshold (they use no protected attribute, so a model's
    line is level)."""
    sc = _fit_scores(spark, sf_dir, DENIAL_MODELS)
    kind = F.create_map(*[F.lit(x) for pair in DENIAL_MODELS.items() for x in pair])[F.col("query")]
    long = sc.select(kind.alias("kind"), F.concat_ws(" ", F.lit("denial"), F.col("split")).alias("section"),
                     F.explode(F.array(*[F.lit(a) for a in ATTRIBUTES])).alias("attribute"),
                     F.lit("denial_reason_accuracy").alias("metric"), F.col("accuracy").alias("value"))
    return report.plot_series(long, F.col("metric"), F.col("section"), F.col("kind"), F.lit("original"))


REASON = "primary_denial_reason"
#: The fits of the fit_* queries: what is fitted on the model table, and the label.
FITS = {
    "fit_forest": (lambda df: models.fit_forest(_reweighed(df), PREDICTORS, weight="weight"), "approved"),
    "fit_forest_tuned_size": (lambda df: models.fit_forest_tuned_size(_train(df), PREDICTORS), "approved"),
    "fit_logistic": (lambda df: models.fit_logistic(_reweighed(df), PREDICTORS, weight="weight"), "approved"),
    "fit_logistic_denial": (lambda df: models.fit_logistic(_train(df), PREDICTORS, label=REASON, multinomial=True), REASON),
    "fit_mlp": (lambda df: models.fit_mlp(_reweighed(df), PREDICTORS, weight="weight", max_iter=MLP_ITERATIONS), "approved"),
    "fit_mlp_denial": (lambda df: models.fit_mlp(_train(df), PREDICTORS, label=REASON, multiclass=True,
                                                 max_iter=MLP_ITERATIONS), REASON),
    "fit_forest_denial": (lambda df: models.fit_forest(_train(df), PREDICTORS, label=REASON), REASON),
}


def _model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "model-rows", lambda: _data(spark, sf_dir))


def _fit_scores(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> DataFrame:
    """The scores of the named fits, each made once per input."""
    out = None
    for name in names:
        rows = _once(spark, sf_dir, f"scores-{name}", lambda name=name: _score_rows(_model_table(spark, sf_dir), name))
        out = rows if out is None else out.unionByName(rows)
    return out


def _score_rows(df: DataFrame, name: str) -> DataFrame:
    fit, label = FITS[name]
    sc = _scored(fit(df), df, label)[0].withColumn("query", F.lit(name))
    return sc.select("query", "split", "n", "n_decided", *[
        F.col(c) if c in sc.columns else F.lit(None).cast("double").alias(c) for c in SCORES])


@register("predict", O.with_inputs("SELECT application_id, split, TRUE AS decided FROM splitted", *O.split_ctes()))
def q_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions for every row of both splits, keyed by application: each
    key once, in its split, decided 0 or 1."""
    df = _data(spark, sf_dir)
    p = models.predict(models.fit_logistic(_train(df), PREDICTORS), df, ["application_id", "split"])
    return p.select("application_id", "split", F.coalesce(F.col("prediction").isin(0, 1), F.lit(False)).alias("decided"))


@register("repeatable_fits", O.with_inputs(
    "SELECT k AS kind, COUNT(*) AS n, COUNT(*) AS n_equal FROM splitted, (SELECT UNNEST(['rf', 'lr', 'mlp']) AS k) "
    "GROUP BY k", *O.split_ctes()))
def q_repeatable_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each learner fitted twice with its seed; rows that both
    fits decide alike."""
    df = _data(spark, sf_dir)
    fits = {"rf": models.fit_forest, "lr": models.fit_logistic, "mlp": models.fit_mlp}
    out = None
    for kind, fit in fits.items():
        a, b = (models.predict(fit(_train(df), PREDICTORS), df).select("application_id", F.col("prediction").alias(c))
                for c in ("p1", "p2"))
        rows = a.join(b, "application_id").agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"),
                                               F.count_if(F.col("p1") == F.col("p2")).alias("n_equal"))
        out = rows if out is None else out.unionByName(rows)
    return out


KINDS, MITIGATIONS = ["rf", "lr", "mlp"], ["reweighing", "repair"]
GRID = models.model_grid(KINDS, MITIGATIONS, ATTRIBUTES)
_MODELS_SQL = "SELECT UNNEST([" + ", ".join(f"'{g.model_id}'" for g in GRID) + "]) AS model_id"


MODEL_IDS = [g.model_id for g in GRID]
_GRIDS: dict[tuple, tuple[str, str, str]] = {}
_GRID_LOCK = threading.Lock()


def _fit(spark: SparkSession, sf_dir: str, table: str, store: str) -> tuple[DataFrame, sharedfit.Fitted]:
    return models.fit_grid_packed(spark.read.parquet(table), PREDICTORS, GRID, mlp_iter=MLP_ITERATIONS,
                                  store=sharedfit.ModelStore(spark, store), version=str(views.versions(spark, sf_dir)))


def _grid(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    """Paths of the model table, the packed decisions of the whole grid and the
    model store: fitted once per application and version of the input files."""
    key = (spark.sparkContext.applicationId, *views.versions(spark, sf_dir))
    with _GRID_LOCK:
        if key not in _GRIDS:
            paths = tuple(shared_path(spark, n) for n in ("grid-rows", "grid", "grid-models"))
            _data(spark, sf_dir).write.parquet(paths[0])
            _fit(spark, sf_dir, paths[0], paths[2])[0].write.parquet(paths[1])
            _GRIDS[key] = paths
        return _GRIDS[key]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contingency cells of the whole grid, counted once for the reports
    that read them."""
    def build():
        long = models.unpacked(spark.read.parquet(_grid(spark, sf_dir)[1]), MODEL_IDS)
        return parity.contingency(long, ATTRIBUTES, decision="prediction", by=["model_id", "split"])

    return _once(spark, sf_dir, "grid-cells", build)


@register("fit_mitigated", O.with_inputs(
    "SELECT model_id, split, attribute, COUNT(*) AS n, COUNT(*) AS n_decided, TRUE AS metrics_valid "
    "FROM splitted, models, (SELECT UNNEST([" + ", ".join(f"'{a}'" for a in ATTRIBUTES) + "]) AS attribute) "
    "GROUP BY model_id, split, attribute", *O.split_ctes(), ("models", _MODELS_SQL)))
def q_fit_mitigated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid of 39 models
    {forest, logistic, network} x {reweighing, repair} x six attributes and the
    three unmitigated baselines, fitted once each. Per model, split and
    attribute: rows, rows decided, and whether every decision metric and score
    lies in its range."""
    by = ["model_id", "split"]
    ct = _cells(spark, sf_dir)
    unit = lambda c, lo: F.coalesce(F.col(c).between(lo, 1), F.lit(True))
    m = parity.parity_metrics(ct, by=by).select(
        *by, "attribute", (unit("decision_parity_difference", -1) & unit("average_odds_difference", -1)
                           & unit("equal_opportunity_difference", -1) & (F.col("theil_index") >= 0)).alias("a"))
    s = parity.classification_scores(ct, by=by).select(
        *by, "attribute", (unit("accuracy", 0) & unit("f1", 0) & unit("recall", 0) & unit("precision", 0)).alias("b"))
    n = ct.groupBy(*by, "attribute").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("yhat").isNotNull(), F.col("n")))
                                         .alias("n_decided"))
    return (n.join(m, [*by, "attribute"]).join(s, [*by, "attribute"])
            .select(*by, "attribute", "n", "n_decided", (F.col("a") & F.col("b")).alias("metrics_valid")))


@register("mitigated_results")
def q_mitigated_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 of the 39 models: per model and split every parity metric and score,
    attributes as columns."""
    return report.grid_results(_cells(spark, sf_dir), ATTRIBUTES)


@register("mitigated_plot_series")
def q_mitigated_plot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 of the 39 models: parity and score series, original, reweighed and
    repaired."""
    return report.grid_plot_series(_cells(spark, sf_dir), GRID, ATTRIBUTES, {"parity": PLOT_METRICS, "scores": SCORES})


@register("mitigated_approval_series")
def q_mitigated_approval_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4 of the 39 models: approval rate of labels and decisions per model,
    split, attribute and group."""
    return report.approval_series(_cells(spark, sf_dir), by=["model_id", "split"])


@register("mitigated_comparison")
def q_mitigated_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6 of the 39 models: decision parity original, reweighed and repaired
    per kind, split and attribute, with the changes."""
    return report.grid_comparison(_cells(spark, sf_dir), GRID, ATTRIBUTES, "decision_parity_difference")


@register("mitigated_decisions")
def q_mitigated_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 of the 39 models: every model's decision beside the row."""
    rows = views.labelled(spark, sf_dir).select("application_id", "approved")
    return compose.attach_packed_decisions(rows, spark.read.parquet(_grid(spark, sf_dir)[1]), MODEL_IDS)


@register("reload_mitigated", O.with_inputs(
    f"SELECT {len(GRID)} AS n_models, {len(GRID)} AS n_loaded, COUNT(*) AS n, COUNT(*) AS n_equal FROM splitted",
    *O.split_ctes()))
def q_reload_mitigated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 with L10: the grid fitted a second time loads every model from the
    store instead of training, and decides every row alike."""
    table, packed, store = _grid(spark, sf_dir)
    again, fit = _fit(spark, sf_dir, table, store)
    first = spark.read.parquet(packed).select("application_id", F.col("decisions").alias("first"))
    both = first.join(again.select("application_id", "decisions"), "application_id")
    return both.agg(F.lit(len(GRID)).cast("long").alias("n_models"), F.lit(len(fit.loaded)).cast("long").alias("n_loaded"),
                    F.count(F.lit(1)).alias("n"), F.count_if(F.col("first").eqNullSafe(F.col("decisions"))).alias("n_equal"))


@register("attach_statistics", O.with_inputs(
    "SELECT l.application_id, CAST(n AS BIGINT) AS n_year, (ROUND(m, 6) + 0.0) AS mean_income FROM labelled l "
    "JOIN (SELECT activity_year, COUNT(*) AS n, AVG(income) AS m FROM labelled GROUP BY activity_year) s USING (activity_year)"))
def q_attach_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small statistics table (applications and mean income per year)
    applied back to every row, broadcast behind a check of its size."""
    df = views.labelled(spark, sf_dir).select("application_id", "activity_year", "income")
    stats = df.groupBy("activity_year").agg(F.count(F.lit(1)).alias("n_year"), round6(F.avg("income")).alias("mean_income"))
    return compose.attach_statistics(df, stats, ["activity_year"]).select("application_id", "n_year", "mean_income")


@register("save_load_model", O.with_inputs("SELECT COUNT(*) AS n, COUNT(*) AS n_equal FROM splitted WHERE split = 'test'",
                                           *O.split_ctes()))
def q_save_load_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted forest (120 trees) saved to shared storage and loaded back;
    test-split decisions of the loaded model that equal the original's."""
    df = _data(spark, sf_dir)
    test = df.filter(F.col("split") == "test")
    m = models.fit_forest(_train(df), PREDICTORS)
    path = shared_path(spark, "forest-model")
    sinks.save_model(m.pipeline, path)
    loaded = models.FittedModel(sinks.load_model(path), m.features, m.label)
    a = models.predict(m, test).select("application_id", F.col("prediction").alias("p1"))
    b = models.predict(loaded, test).select("application_id", F.col("prediction").alias("p2"))
    j = a.join(b, "application_id", "inner")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p1") == F.col("p2")).alias("n_equal"))


@register("energy_formula", O.with_inputs(
    "SELECT activity_year, (ROUND(COUNT(*) / 1000.0, 6) + 0.0) AS hours, "
    "(ROUND(COUNT(*) / 1000.0 / 24 / 365 * 57754 / 1000, 6) + 0.0) AS energy_kwh FROM applications GROUP BY activity_year"))
def q_energy_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G17's formula on given hours (one per thousand applications of a year)."""
    hours = views.applications(spark, sf_dir).groupBy("activity_year").agg(
        (F.count(F.lit(1)) / F.lit(1000.0)).alias("h"))
    return hours.select("activity_year", round6("h").alias("hours"), round6(report.energy_kwh(F.col("h"))).alias("energy_kwh"))


_STEPS = [f"{m}_{k}" for m in ("original", "reweighing", "repair") for k in KINDS]


@register("time_and_energy", "SELECT UNNEST([" + ", ".join(f"'{s}'" for s in _STEPS)
          + "]) AS step, TRUE AS measured, TRUE AS energy_follows")
def q_time_and_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall time and energy of each model group (kind x original,
    reweighing, repair; for a50), each timed around its real fit. Hours differ
    from run to run, so the query says whether they were measured and whether
    the energy follows from them by the formula."""
    df = _data(spark, sf_dir)
    train = _train(df)
    fits = {"rf": models.fit_forest, "lr": models.fit_logistic, "mlp": models.fit_mlp}
    timer = report.StepTimer()
    for kind, fit in fits.items():
        with timer.step(f"original_{kind}"):
            fit(train, PREDICTORS)
        with timer.step(f"reweighing_{kind}"):
            fit(_reweighed(df), PREDICTORS, weight="weight")
        with timer.step(f"repair_{kind}"):
            fit(materialize(mitigate.repair_disparate_impact(train, PREDICTORS, ATTR), "timed-repair"), PREDICTORS)
    expected = F.col("hours") / 24 / 365 * 57754 / 1000
    return timer.table(spark).select("step", (F.col("hours") > 0).alias("measured"),
                                     (F.abs(F.col("energy_kwh") - expected) < 1e-9).alias("energy_follows"))
