"""Group parity of labels and decisions.

Everything is arithmetic on one small table, the *contingency*:
(by..., attribute, g, y, yhat) -> n, sum of weights. The protected attributes
are unpivoted, so attributes are a grouping key, not a driver loop; partial
aggregation collapses every task to at most 48 rows per ``by`` value before
the shuffle, so the metric cost is one scan of the input whatever its size or
skew.

Conventions: g = 1 privileged, g = 0 unprivileged; label and decision 1 are
favourable. A ratio with an empty denominator is null, never an error.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiloan.functions.columns import round6, safe_div


def contingency(df: DataFrame, attributes: Iterable[str], label: str = "approved",
                decision: str | None = "rule_decision", weight: str | None = None,
                by: Iterable[str] = ()) -> DataFrame:
    """(by..., attribute, g, y, yhat) -> n (rows), w (sum of weights).

    ``decision`` None gives yhat = y (label-only metrics). ``weight`` None
    gives w = n.
    """
    attributes = list(attributes)
    by = list(by)
    yhat = F.col(decision) if decision else F.col(label)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = df.select(*by, F.col(label).cast("int").alias("y"), yhat.cast("int").alias("yhat"),
                     w.alias("_w"), *[F.col(a).cast("int").alias(a) for a in attributes])
    long = base.unpivot(ids=[*by, "y", "yhat", "_w"], values=attributes,
                        variableColumnName="attribute", valueColumnName="g")
    return (long.groupBy(*by, "attribute", "g", "y", "yhat")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w")))


def _cell(c: Column, **eq) -> Column:
    cond = None
    for k, v in eq.items():
        term = F.col(k) == F.lit(v)
        cond = term if cond is None else (cond & term)
    return F.sum(F.when(cond, c).otherwise(F.lit(0.0)))


#: Cells that metrics may count: a missing decision is not a rejection.
KNOWN = "y is not null and yhat is not null and g is not null"


def excluded_rows(ct: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """(by..., attribute, n_excluded): rows without label, decision or group,
    which no metric counts."""
    by = list(by)
    return ct.groupBy(*by, "attribute").agg(
        F.sum(F.when(F.expr(KNOWN), F.lit(0)).otherwise(F.col("n"))).alias("n_excluded"))


def group_counts(ct: DataFrame, by: Iterable[str] = (), weighted: bool = False) -> DataFrame:
    """Per (by..., attribute): the cell sums every metric needs, over the rows
    whose label and decision are known (``excluded_rows`` counts the others)."""
    by = list(by)
    ct = ct.filter(KNOWN)
    c = F.col("w") if weighted else F.col("n").cast("double")
    n = F.col("n").cast("double")
    aggs = []
    for g, tag in ((0, "u"), (1, "p")):
        aggs += [
            _cell(c, g=g).alias(f"n_{tag}"),
            _cell(c, g=g, y=1).alias(f"pos_{tag}"),
            _cell(c, g=g, yhat=1).alias(f"sel_{tag}"),
            _cell(c, g=g, y=1, yhat=1).alias(f"tp_{tag}"),
            _cell(c, g=g, y=0, yhat=1).alias(f"fp_{tag}"),
            _cell(c, g=g, y=0).alias(f"neg_{tag}"),
        ]
    # Theil index: benefit b = yhat - y + 1 in {0, 1, 2}; always unweighted.
    aggs += [
        F.sum(n).alias("n_all"),
        F.sum(F.when(F.col("y") == F.col("yhat"), n).otherwise(F.lit(0.0))).alias("n_b1"),
        F.sum(F.when((F.col("y") == 0) & (F.col("yhat") == 1), n).otherwise(F.lit(0.0))).alias("n_b2"),
        F.sum(F.when(F.col("y") == F.col("yhat"), c).otherwise(F.lit(0.0))).alias("correct"),
        F.sum(c).alias("total"),
    ]
    return ct.groupBy(*by, "attribute").agg(*aggs)


def _theil(n_all: Column, n_b1: Column, n_b2: Column) -> Column:
    """Generalised entropy index, alpha = 1, from the counts of b = 1 and 2:
    T = 1/N * sum_{b>0} n_b (b/mu) ln(b/mu), mu = (n_b1 + 2 n_b2) / N."""
    mu = safe_div(n_b1 + F.lit(2.0) * n_b2, n_all)
    t1 = F.when(n_b1 > 0, n_b1 * safe_div(F.lit(1.0), mu) * F.log(safe_div(F.lit(1.0), mu))).otherwise(F.lit(0.0))
    t2 = F.when(n_b2 > 0, n_b2 * safe_div(F.lit(2.0), mu) * F.log(safe_div(F.lit(2.0), mu))).otherwise(F.lit(0.0))
    return F.when(mu > 0, safe_div(t1 + t2, n_all))


def metric_columns(gc: DataFrame) -> dict[str, Column]:
    """G7-G13 from ``group_counts`` columns."""
    col = F.col
    base_u, base_p = safe_div("pos_u", "n_u"), safe_div("pos_p", "n_p")
    sel_u, sel_p = safe_div("sel_u", "n_u"), safe_div("sel_p", "n_p")
    tpr_u, tpr_p = safe_div("tp_u", "pos_u"), safe_div("tp_p", "pos_p")
    fpr_u, fpr_p = safe_div("fp_u", "neg_u"), safe_div("fp_p", "neg_p")
    return {
        "base_rate_unprivileged": base_u,
        "base_rate_privileged": base_p,
        "statistical_parity_difference": base_u - base_p,
        "disparate_impact": safe_div(base_u, base_p),
        "mean_difference": base_u - base_p,
        "decision_rate_unprivileged": sel_u,
        "decision_rate_privileged": sel_p,
        "decision_parity_difference": sel_u - sel_p,
        "decision_disparate_impact": safe_div(sel_u, sel_p),
        "average_odds_difference": F.lit(0.5) * ((fpr_u - fpr_p) + (tpr_u - tpr_p)),
        "equal_opportunity_difference": tpr_u - tpr_p,
        "theil_index": _theil(col("n_all"), col("n_b1"), col("n_b2")),
    }


METRIC_NAMES = [
    "base_rate_unprivileged", "base_rate_privileged", "statistical_parity_difference",
    "disparate_impact", "mean_difference", "decision_rate_unprivileged", "decision_rate_privileged",
    "decision_parity_difference", "decision_disparate_impact", "average_odds_difference",
    "equal_opportunity_difference", "theil_index",
]


def parity_metrics(ct: DataFrame, by: Iterable[str] = (), weighted: bool = False,
                     rounded: bool = True, with_total: bool = False) -> DataFrame:
    """One row per (by..., attribute) with group sizes and every
    metric. ``weighted`` uses the weight sums (G10); Theil stays unweighted.
    ``with_total`` adds ``sum_weights`` (rows, or weights when weighted)."""
    by = list(by)
    gc = group_counts(ct, by, weighted)
    cols = metric_columns(gc)
    out = [F.col(c) for c in by] + [F.col("attribute")]
    if weighted:
        out += [round6("n_u").alias("n_unprivileged"), round6("n_p").alias("n_privileged")]
    else:
        out += [F.col("n_u").cast("bigint").alias("n_unprivileged"),
                F.col("n_p").cast("bigint").alias("n_privileged")]
    out += [(round6(v) if rounded else v).alias(k) for k, v in cols.items()]
    if with_total:
        out.append((round6("total") if rounded else F.col("total")).alias("sum_weights"))
    return gc.select(*out)


def label_metrics(df: DataFrame, attributes: Iterable[str], label: str = "approved",
                  weight: str | None = None, by: Iterable[str] = ()) -> DataFrame:
    """G7-G10 on labels only: parity difference, disparate impact, mean
    difference per attribute (weighted when ``weight`` is given)."""
    ct = contingency(df, attributes, label=label, decision=None, weight=weight, by=by)
    m = parity_metrics(ct, by=by, weighted=weight is not None)
    return m.select(*by, "attribute", "n_unprivileged", "n_privileged", "base_rate_unprivileged",
                    "base_rate_privileged", "statistical_parity_difference", "disparate_impact",
                    "mean_difference")


def classification_scores(ct: DataFrame, by: Iterable[str] = (), weighted: bool = False) -> DataFrame:
    """Accuracy, F1, recall and precision of class 1 per (by...,
    attribute). Every attribute holds all rows, so unweighted scores repeat
    across attributes; weighted ones differ because weights are per attribute."""
    by = list(by)
    c = F.col("w") if weighted else F.col("n").cast("double")
    agg = ct.filter(KNOWN).groupBy(*by, "attribute").agg(
        F.sum(c).alias("total"),
        F.sum(F.when(F.col("y") == F.col("yhat"), c).otherwise(F.lit(0.0))).alias("correct"),
        F.sum(F.when((F.col("y") == 1) & (F.col("yhat") == 1), c).otherwise(F.lit(0.0))).alias("tp"),
        F.sum(F.when((F.col("y") == 0) & (F.col("yhat") == 1), c).otherwise(F.lit(0.0))).alias("fp"),
        F.sum(F.when((F.col("y") == 1) & (F.col("yhat") == 0), c).otherwise(F.lit(0.0))).alias("fn"),
    )
    return agg.select(*by, "attribute", *_score_columns())


def _score_columns() -> list[Column]:
    precision = safe_div("tp", F.col("tp") + F.col("fp"))
    recall = safe_div("tp", F.col("tp") + F.col("fn"))
    f1 = safe_div(F.lit(2.0) * F.col("tp"), F.lit(2.0) * F.col("tp") + F.col("fp") + F.col("fn"))
    return [round6(safe_div("correct", "total")).alias("accuracy"), round6(f1).alias("f1"),
            round6(recall).alias("recall"), round6(precision).alias("precision")]


def binary_scores(df: DataFrame, label: str, decision: str, by: Iterable[str] = ()) -> DataFrame:
    """G14 without attributes: one grouped pass with conditional counts, over
    the rows whose label and decision are known."""
    by = list(by)
    y, yhat = F.col(label).cast("int"), F.col(decision).cast("int")
    one = F.lit(1.0)
    agg = df.filter(y.isNotNull() & yhat.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("total"),
        F.sum(F.when(y == yhat, one).otherwise(F.lit(0.0))).alias("correct"),
        F.sum(F.when((y == 1) & (yhat == 1), one).otherwise(F.lit(0.0))).alias("tp"),
        F.sum(F.when((y == 0) & (yhat == 1), one).otherwise(F.lit(0.0))).alias("fp"),
        F.sum(F.when((y == 1) & (yhat == 0), one).otherwise(F.lit(0.0))).alias("fn"),
    )
    return agg.select(*by, *_score_columns())


def multiclass_accuracy(df: DataFrame, label: str, prediction: str, by: Iterable[str] = ()) -> DataFrame:
    """Share of rows whose predicted class equals the label; ``n`` counts
    the rows with both, which are the ones compared."""
    hit = (F.col(label).cast("double") == F.col(prediction).cast("double")).cast("double")
    return df.groupBy(*list(by)).agg(F.count(hit).alias("n"), round6(F.avg(hit)).alias("accuracy"))


def metrics_long(metrics: DataFrame, by: Iterable[str] = (), metric_names: Iterable[str] | None = None) -> DataFrame:
    """Long form (by..., attribute, metric, value) of a metrics table."""
    by = list(by)
    names = list(metric_names) if metric_names is not None else [
        c for c in metrics.columns if c not in set(by) | {"attribute", "n_unprivileged", "n_privileged"}]
    m = metrics.select(*by, "attribute", *[F.col(n).cast("double").alias(n) for n in names])
    return m.unpivot(ids=[*by, "attribute"], values=names, variableColumnName="metric", valueColumnName="value")
