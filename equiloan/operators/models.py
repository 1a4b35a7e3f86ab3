"""Models (L1-L10) with ``pyspark.ml``: distributed fits, predictions keyed
by ``application_id``, and parity of the decisions through the same
contingency table as everything else.

Training data are never collected: forests, logistic regression and the
multilayer perceptron are fitted by Spark's distributed learners; the driver
only holds model parameters and small statistics (means, sds, class lists).
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiloan.constants import (
    FOREST_BINS,
    FOREST_DEPTH,
    FOREST_TREES,
    HASH_MODULUS,
    LOGISTIC_MAX_ITER,
    SEED_FOREST,
    TUNE_GRID,
)
from equiloan.functions.columns import portable_hash
from equiloan.operators import prep, splits

FEATURES_COL = "features"
#: Partitions per core from which a last, partly filled wave costs little.
MANY_WAVES = 8


@dataclass
class FittedModel:
    """A fitted pipeline plus the standardisation it was trained with (if any)
    and the class list it re-indexed labels to (multiclass)."""

    pipeline: PipelineModel
    features: list[str]
    label: str
    scaler: dict[str, tuple] | None = None
    classes: list | None = None
    info: dict = field(default_factory=dict)

    def prepare(self, df: DataFrame) -> DataFrame:
        return prep.standardize(df, self.features, stats=self.scaler) if self.scaler else df

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(self.prepare(df))


def complete(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    """The rows a learner can use: every feature and the label known."""
    return df.dropna(subset=[*features, *([label] if label else [])])


def _known(features: list[str]):
    cond = F.lit(True)
    for f in features:
        cond = cond & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    return cond


def _assembler(features: list[str]) -> VectorAssembler:
    # "keep" passes unknown features on as NaN: a prediction then exists for
    # every row, and ``predict`` takes back those that rest on a NaN.
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES_COL, handleInvalid="keep")


def _label(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn("_label", F.col(label).cast("double"))


def fit_forest(train: DataFrame, features: list[str], label: str = "approved", weight: str | None = None,
               num_trees: int = FOREST_TREES, max_depth: int = FOREST_DEPTH, max_bins: int = 32,
               min_instances: int = 1, seed: int = SEED_FOREST) -> FittedModel:
    """L1 (and L8 with a multiclass label): random forest."""
    rf = RandomForestClassifier(featuresCol=FEATURES_COL, labelCol="_label", numTrees=num_trees,
                                maxDepth=max_depth, maxBins=max_bins, minInstancesPerNode=min_instances,
                                seed=seed)
    # Every row's node in every tree is kept from level to level; else each
    # level walks all trees from their roots. The lineage is as long as the
    # trees are deep, so it needs no checkpoint.
    rf.setCacheNodeIds(True).setCheckpointInterval(-1)
    if weight:
        rf.setWeightCol(weight)
    pipe = Pipeline(stages=[_assembler(features), rf]).fit(_label(complete(train, features, label), label))
    return FittedModel(pipe, list(features), label)


def fit_forest_tuned_size(train: DataFrame, features: list[str], label: str = "approved",
                          weight: str | None = None, num_trees: int = 100, seed: int = SEED_FOREST) -> FittedModel:
    """L1, second configuration: 100 trees, depth 10, 16 bins."""
    return fit_forest(train, features, label, weight, num_trees, FOREST_DEPTH, FOREST_BINS, 1, seed)


def feature_importance(model: FittedModel) -> list[tuple[str, float]]:
    """(feature, importance) sorted ascending."""
    rf = model.pipeline.stages[-1]
    imp = rf.featureImportances.toArray().tolist()
    return sorted(zip(model.features, imp), key=lambda t: t[1])


def tune_forest(train: DataFrame, features: list[str], label: str = "approved", grid: dict | None = None,
                folds: int = 3, seed: int = SEED_FOREST, parallelism: int = 4, key: str = "application_id"):
    """L3: grid search with k-fold cross-validation on accuracy; the best
    setting is refitted on all training rows. A row's fold is its keyed hash
    modulo ``folds``, so folds do not depend on partitioning. The grid is
    built from the same estimator object that is tuned (params are bound to
    its uid)."""
    grid = grid or TUNE_GRID
    rf = RandomForestClassifier(featuresCol=FEATURES_COL, labelCol="_label", seed=seed)
    b = ParamGridBuilder()
    if "numTrees" in grid:
        b = b.addGrid(rf.numTrees, grid["numTrees"])
    if "maxDepth" in grid:
        b = b.addGrid(rf.maxDepth, grid["maxDepth"])
    if "minInstancesPerNode" in grid:
        b = b.addGrid(rf.minInstancesPerNode, grid["minInstancesPerNode"])
    maps = b.build()
    pipe = Pipeline(stages=[_assembler(features), rf])
    ev = MulticlassClassificationEvaluator(labelCol="_label", predictionCol="prediction", metricName="accuracy")
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=ev, numFolds=folds, seed=seed,
                        parallelism=parallelism, foldCol="_fold")
    fold = (portable_hash(key, seed) % F.lit(folds)).cast("int")
    cvm = cv.fit(_label(complete(train, features, label), label).withColumn("_fold", fold))
    rows = []
    for pm, acc in zip(maps, cvm.avgMetrics):
        rows.append((int(pm.get(rf.numTrees, rf.getNumTrees())), int(pm.get(rf.maxDepth, rf.getMaxDepth())),
                     int(pm.get(rf.minInstancesPerNode, rf.getMinInstancesPerNode())), float(acc)))
    best = FittedModel(cvm.bestModel, list(features), label)
    return best, rows


def fit_logistic(train: DataFrame, features: list[str], label: str = "approved", weight: str | None = None,
                 max_iter: int = LOGISTIC_MAX_ITER, multinomial: bool = False, reg_c: float = 1.0) -> FittedModel:
    """Logistic regression on features standardised with the training
    split's mean and population sd (P20). L2 penalty with the usual C = 1
    convention (regParam = 1 / (C * n))."""
    train = complete(train, features, label)
    stats, n = prep.fit_standardize(train, features, with_count=True)
    lr = LogisticRegression(featuresCol=FEATURES_COL, labelCol="_label", maxIter=max_iter,
                            regParam=1.0 / (reg_c * max(n, 1)), elasticNetParam=0.0, standardization=False,
                            family="multinomial" if multinomial else "auto")
    if weight:
        lr.setWeightCol(weight)
    data = _label(prep.standardize(train, features, stats=stats), label)
    pipe = Pipeline(stages=[_assembler(features), lr]).fit(data)
    return FittedModel(pipe, list(features), label, scaler=stats)


def class_list(df: DataFrame, label: str, cap: int | None = None) -> list:
    """Sorted distinct class labels (one output of the network each); more
    than ``cap`` raise, if given."""
    vals = [r[0] for r in df.select(label).distinct().collect() if r[0] is not None]
    if cap is not None and len(vals) > cap:
        raise ValueError("too many classes")
    return sorted(vals)


def reindex(df: DataFrame, label: str, classes: list, out: str = "_label") -> DataFrame:
    """Class values -> 0..K-1 (so class 10 fits a ten-output layer, Q9)."""
    m = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
    return df.withColumn(out, F.element_at(m, F.col(label)))


def replicate_by_weight(df: DataFrame, weight: str, key: str = "application_id", seed: int = SEED_FOREST,
                        mean_copies: float = 1.0) -> DataFrame:
    """Instance weights for learners without ``weightCol`` (the MLP): a
    resample of ``mean_copies`` rows per row on average, by default as many as
    the table has. With s = mean_copies / mean weight, each of the n rows of
    weight w gets floor(s w) copies, and the round(frac(s w) n) of them with
    the lowest hashes one more: the copies of a weight number s w n to within
    one half, so a class's share of a group's copies is off by at most one row
    a cell. Deterministic and independent of partitioning. With more than
    ``splits.LOCAL_STRATA`` different weights each row draws its last copy by
    its own hash, which meets the numbers on average only. A missing or
    negative weight raises; rows may be left without a copy
    (``rows_without_copies`` counts them)."""
    r = df.agg(F.avg(weight).alias("m"), F.count_if(F.col(weight).isNull() | (F.col(weight) < 0)).alias("bad")).first()
    if r["bad"]:
        raise ValueError(f"{r['bad']} rows have no usable weight")
    share = F.col(weight) * F.lit(mean_copies / (r["m"] or 1.0))
    rest = share - F.floor(share)
    if df.select(weight).distinct().limit(splits.LOCAL_STRATA + 1).count() <= splits.LOCAL_STRATA:
        drawn = splits.lowest_k_by_hash(df, [weight], lambda n: F.round(rest * n), key, seed, "_more")
    else:
        drawn = df.withColumn("_more", portable_hash(key, seed) < rest * F.lit(float(HASH_MODULUS)))
    copies = (F.floor(share) + F.col("_more").cast("long")).cast("int")
    rep = drawn.withColumn("_copies", copies).filter(F.col("_copies") > 0)
    return rep.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies", "_copy", "_more")


def rows_without_copies(df: DataFrame, replicated: DataFrame, key: str = "application_id") -> int:
    """Rows of ``df`` that ``replicate_by_weight`` gave no copy."""
    return df.select(key).join(replicated.select(key).distinct(), key, "left_anti").count()


def fit_mlp(train: DataFrame, features: list[str], label: str = "approved", hidden: Iterable[int] = (64, 32),
            weight: str | None = None, max_iter: int = 100, seed: int = SEED_FOREST, block_size: int = 128,
            multiclass: bool = False, key: str = "application_id", mean_copies: float = 1.0) -> FittedModel:
    """Multilayer perceptron (distributed L-BFGS) on standardised
    features. Weights are honoured by a deterministic resample per weight
    (``mean_copies`` per row on average, so a pass reads no more rows than the
    table has); multiclass labels are re-indexed to
    0..K-1."""
    train = complete(train, features, label)
    stats = prep.fit_standardize(train, features)
    data = prep.standardize(train, features, stats=stats)
    if weight:
        data = replicate_by_weight(data, weight, key, seed, mean_copies)
    classes = class_list(train, label) if multiclass else [0, 1]
    data = reindex(data, label, classes) if multiclass else _label(data, label)
    layers = [len(features), *hidden, len(classes)]
    mlp = MultilayerPerceptronClassifier(featuresCol=FEATURES_COL, labelCol="_label", layers=layers,
                                         maxIter=max_iter, seed=seed, blockSize=block_size)
    pipe = Pipeline(stages=[_assembler(features), mlp]).fit(data)
    return FittedModel(pipe, list(features), label, scaler=stats, classes=classes if multiclass else None)


def predict(model: FittedModel, df: DataFrame, keep: Iterable[str] = ("application_id",),
            threshold: float | None = None, out: str = "prediction") -> DataFrame:
    """Decisions (and the class-1 probability) for every row, keyed.

    Binary models decide probability >= ``threshold`` (P23) when one is
    given; multiclass predictions are mapped back to the original classes. A
    row with an unknown feature keeps its place with a null decision."""
    keep = list(keep)
    p = model.transform(df.withColumn("_known", _known(model.features)))
    cols = [*keep]
    if model.classes is not None:
        m = F.create_map(*[x for i, c in enumerate(model.classes) for x in (F.lit(float(i)), F.lit(c))])
        cols.append(F.when(F.col("_known"), F.element_at(m, F.col("prediction"))).alias(out))
    else:
        prob1 = vector_to_array(F.col("probability"))[1]
        dec = (prob1 >= F.lit(threshold)).cast("int") if threshold is not None else F.col("prediction").cast("int")
        cols += [F.when(F.col("_known"), dec).alias(out), F.when(F.col("_known"), prob1).alias("probability_1")]
    return p.select(*cols)


@dataclass
class GridEntry:
    model_id: str
    kind: str          # rf | lr | mlp
    mitigation: str    # none | reweighing | repair
    attribute: str | None


def model_grid(kinds: Iterable[str], mitigations: Iterable[str], attributes: Iterable[str]) -> list[GridEntry]:
    """Unmitigated baselines once per kind (they do not depend on the
    attribute), then kind x mitigation x attribute."""
    grid = [GridEntry(f"{k}_original", k, "none", None) for k in kinds]
    for a in attributes:
        for m in mitigations:
            for k in kinds:
                grid.append(GridEntry(f"{k}_{m}_{a}", k, m, a))
    return grid


def spread(df: DataFrame) -> DataFrame:
    """A table over all cores evenly, as many passes read it: one partition
    more than there are cores would double the time of every pass. The
    partitions become a multiple of the cores; a table of many is left as it
    is."""
    n, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df if parts and not parts % n or parts >= MANY_WAVES * n else df.repartition(-(-parts // n) * n)


def fit_grid_packed(df: DataFrame, features: list[str], grid: list[GridEntry], label: str = "approved",
                    split: str = "split", forest_trees: int = FOREST_TREES, logistic_iter: int = LOGISTIC_MAX_ITER,
                    mlp_iter: int = 100, key: str = "application_id", store=None, version: str = ""):
    """Fit every grid entry by shared passes (``sharedfit``) and decide all
    rows in one: (key, split, label, attributes, decisions), the array holding
    one decision per entry in the grid's order, and the fitted arms.

    ``df`` holds both splits (``split`` = train / test) and should be a stored
    table. Reweighing arms take the train split's weights for the entry's
    attribute; repair arms take features repaired per split (M3), all
    attributes from one repair fit per split, beside the original ones in one
    stored table. With a ``store``, arms fitted before are loaded."""
    from equiloan.operators import sharedfit
    from equiloan.operators.cumulative import materialize
    from equiloan.operators.mitigate import repair_edges, repaired_attributes, reweigh_weights

    attrs = sorted({g.attribute for g in grid if g.attribute})
    weights = reweigh_weights(df.filter(F.col(split) == "train"), attrs, label) if attrs else None
    repaired = sorted({g.attribute for g in grid if g.mitigation == "repair"})
    names = {a: {f: f"{f}__{a}" for f in features} for a in repaired}
    table = df
    if repaired:
        parts = []
        split_rows = [df.filter(F.col(split) == s) for s in ("train", "test")]
        # Many small jobs each, which leave cores idle when they run one by one.
        with ThreadPoolExecutor(len(split_rows)) as pool:
            fitted = list(pool.map(lambda part: repair_edges(part, features, repaired), split_rows))
        for part, edges in zip(split_rows, fitted, strict=True):
            parts.append(repaired_attributes(part, edges, features, names))
        table = parts[0].unionByName(parts[1])
    table = materialize(spread(table), "grid-table")
    layout = sharedfit.Layout(key, label, attrs, [list(features), *[list(names[a].values()) for a in repaired]])
    arms = []
    for g in grid:
        if g.kind not in ("rf", "lr", "mlp"):
            raise ValueError(g.kind)
        arms.append(sharedfit.Arm(g.model_id, g.kind, 1 + repaired.index(g.attribute) if g.mitigation == "repair" else 0,
                                  attrs.index(g.attribute) if g.mitigation == "reweighing" else None, trees=forest_trees))
    fit = sharedfit.fit_arms(table.filter(F.col(split) == "train"), layout, arms, weights, logistic_iter, mlp_iter,
                             store=store, version=version)
    return sharedfit.score(fit, table, arms, [key, split, label, *attrs]), fit


def unpacked(packed: DataFrame, model_ids: list[str], decisions: str = "decisions") -> DataFrame:
    """One row per model from the packed decisions: model_id, prediction."""
    rest = [c for c in packed.columns if c != decisions]
    long = packed.select(*rest, F.posexplode(decisions).alias("_model", "prediction"))
    names = F.array(*[F.lit(m) for m in model_ids])
    return long.select(*rest, F.get(names, F.col("_model")).alias("model_id"), "prediction")


def fit_grid(df: DataFrame, features: list[str], grid: list[GridEntry], **settings) -> DataFrame:
    """``fit_grid_packed`` as long predictions (key, split, label, attribute
    values..., model_id, prediction)."""
    packed, _ = fit_grid_packed(df, features, grid, **settings)
    return unpacked(packed, [g.model_id for g in grid])
