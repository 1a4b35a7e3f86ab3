"""Registered queries: metrics, splits, mitigation, composition and reports
(G1-G18, T1-T3, M1-M4, J1-J5, R1-R4, R6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiloan.constants import (
    ATTRIBUTES,
    CONDITIONS,
    DESCRIBE_YEARS,
    PREDICTORS,
    SLICE_YEAR,
)
from equiloan.functions.columns import portable_hash_sql, round6, sanitize_name
from equiloan.operators import compose, describe, parity, mitigate, prep, report, splits
from equiloan.plans import oracle as O
from equiloan.plans import views
from equiloan.plans.q_prep import CASCADE_SQL
from equiloan.plans.registry import register
from equiloan.sources import applications as src
from equiloan.sources.standin import rule_decision

R = O.R
W = O.with_inputs
FLAGSHIP_CTES = [
    ("long", O.attribute_long("labelled")),
    ("c", f"SELECT attribute, {O.conditional_sums()} FROM long GROUP BY attribute"),
    ("th", O.theil_per_row("labelled")),
    ("fm", f"SELECT c.attribute, {O.metric_select()} FROM c JOIN th ON TRUE"),
]


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared table with P16 bins and the T1 split column."""
    return splits.stratified_split(prep.equal_width_bins(views.labelled(spark, sf_dir)))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.labelled(spark, sf_dir)
    return parity.parity_metrics(parity.contingency(df, ATTRIBUTES))


# --- G6-G13, G18 -------------------------------------------------------------

@register("contingency", W("SELECT attribute, g, y, yhat, CAST(COUNT(*) AS BIGINT) AS n, "
                           "CAST(COUNT(*) AS DOUBLE) AS w FROM long GROUP BY attribute, g, y, yhat",
                           ("long", O.attribute_long("labelled"))))
def q_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(attribute, group, label, decision) -> rows, weight sum."""
    return parity.contingency(views.labelled(spark, sf_dir), ATTRIBUTES)


def _one_metric(sid: str, name: str, metric: str, label_only: bool):
    cols = "attribute, n_unprivileged, n_privileged, " + metric

    @register(name, W(f"SELECT {cols} FROM fm", *(
        [("long", O.attribute_long("labelled", yhat="approved")),
         ("c", f"SELECT attribute, {O.conditional_sums()} FROM long GROUP BY attribute"),
         ("th", O.theil_per_row("labelled", yhat="approved")),
         ("fm", f"SELECT c.attribute, {O.metric_select()} FROM c JOIN th ON TRUE")]
        if label_only else FLAGSHIP_CTES)))
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = views.labelled(spark, sf_dir)
        ct = parity.contingency(df, ATTRIBUTES, decision=None if label_only else "rule_decision")
        return parity.parity_metrics(ct).select("attribute", "n_unprivileged", "n_privileged", metric)

    source = "the labels" if label_only else "the scorecard decisions"
    q.__doc__ = f"{sid}: {metric.replace('_', ' ')} of {source} per attribute, from one contingency pass."
    return q


_one_metric("G7", "statistical_parity_difference", "statistical_parity_difference", True)
_one_metric("G8", "disparate_impact", "disparate_impact", True)
_one_metric("G9", "mean_difference", "mean_difference", True)
_one_metric("G11", "average_odds_difference", "average_odds_difference", False)
_one_metric("G12", "equal_opportunity_difference", "equal_opportunity_difference", False)
_one_metric("G13", "theil_index", "theil_index", False)

WEIGHT_CTES = [
    ("long", O.attribute_long("labelled", extra="application_id, ")),
    ("cells", "SELECT attribute, g, y, COUNT(*) AS n FROM long GROUP BY attribute, g, y"),
    ("wt", "SELECT attribute, g, y, n, CAST(SUM(n) OVER (PARTITION BY attribute, g) AS DOUBLE) "
           "* CAST(SUM(n) OVER (PARTITION BY attribute, y) AS DOUBLE) / NULLIF(CAST(SUM(n) OVER "
           "(PARTITION BY attribute) AS DOUBLE) * CAST(n AS DOUBLE), 0) AS weight FROM cells"),
    ("lw", "SELECT l.*, wt.weight FROM long l JOIN wt USING (attribute, g, y)"),
    ("cw", f"SELECT attribute, SUM(weight) AS sw, {O.conditional_sums('weight')} FROM lw GROUP BY attribute"),
]


@register("weighted_metrics", W(
    f"""SELECT attribute, {R('sw')} AS sum_weights,
  {R('pos_u / NULLIF(n_u, 0) - pos_p / NULLIF(n_p, 0)')} AS statistical_parity_difference,
  {R('(pos_u / NULLIF(n_u, 0)) / NULLIF(pos_p / NULLIF(n_p, 0), 0)')} AS disparate_impact,
  {R('pos_u / NULLIF(n_u, 0) - pos_p / NULLIF(n_p, 0)')} AS mean_difference
FROM cw""", *WEIGHT_CTES))
def q_weighted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parity difference, disparate impact and mean difference with
    reweighing weights (M1, fitted on the same rows): 0, 1, 0; weights sum to N."""
    df = views.labelled(spark, sf_dir)
    ct = parity.contingency(df, ATTRIBUTES, decision=None)
    weights = mitigate.weights_from_contingency(ct, [])
    wct = mitigate.weighted_contingency(ct, weights)
    m = parity.parity_metrics(wct, weighted=True, with_total=True)
    return m.select("attribute", "sum_weights", "statistical_parity_difference", "disparate_impact",
                    "mean_difference")


METRIC_COLS = ["base_rate_unprivileged", "base_rate_privileged", "statistical_parity_difference",
               "disparate_impact", "mean_difference", "decision_rate_unprivileged", "decision_rate_privileged",
               "decision_parity_difference", "decision_disparate_impact", "average_odds_difference",
               "equal_opportunity_difference", "theil_index"]
LONG_SQL = "\nUNION ALL\n".join(f"SELECT attribute, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM fm"
                                for m in METRIC_COLS)


@register("metric_by_attribute", W(LONG_SQL, *FLAGSHIP_CTES))
def q_metric_by_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric for every attribute as a long table (no driver loop)."""
    return parity.metrics_long(_metrics(spark, sf_dir), metric_names=METRIC_COLS)


@register("results_matrix", W(
    "SELECT metric, " + ", ".join(f"MAX(CASE WHEN attribute = '{a}' THEN value END) AS {a}" for a in ATTRIBUTES)
    + " FROM ml GROUP BY metric", *FLAGSHIP_CTES, ("ml", LONG_SQL)))
def q_results_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as rows, attributes as columns."""
    long = parity.metrics_long(_metrics(spark, sf_dir), metric_names=METRIC_COLS)
    return report.results_matrix(long, ATTRIBUTES)


# --- G14, G15 ------------------------------------------------------------------

SCORE_SQL = f"""SELECT split,
  {R('SUM(CASE WHEN approved = rule_decision THEN 1.0 ELSE 0.0 END) / COUNT(*)')} AS accuracy,
  {R('2.0 * SUM(CASE WHEN approved = 1 AND rule_decision = 1 THEN 1.0 ELSE 0.0 END) / NULLIF(2.0 * SUM(CASE WHEN approved = 1 AND rule_decision = 1 THEN 1.0 ELSE 0.0 END) + SUM(CASE WHEN approved = 0 AND rule_decision = 1 THEN 1.0 ELSE 0.0 END) + SUM(CASE WHEN approved = 1 AND rule_decision = 0 THEN 1.0 ELSE 0.0 END), 0)')} AS f1,
  {R('SUM(CASE WHEN approved = 1 AND rule_decision = 1 THEN 1.0 ELSE 0.0 END) / NULLIF(SUM(CASE WHEN approved = 1 THEN 1.0 ELSE 0.0 END), 0)')} AS recall,
  {R('SUM(CASE WHEN approved = 1 AND rule_decision = 1 THEN 1.0 ELSE 0.0 END) / NULLIF(SUM(CASE WHEN rule_decision = 1 THEN 1.0 ELSE 0.0 END), 0)')} AS precision
FROM splitted GROUP BY split"""


@register("classification_scores", W(SCORE_SQL, *O.split_ctes()))
def q_classification_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, F1, recall, precision of the decisions, per split."""
    return parity.binary_scores(_split(spark, sf_dir), "approved", "rule_decision", by=["split"])


@register("multiclass_accuracy", W(
    f"SELECT split, CAST(COUNT(*) AS BIGINT) AS n, {R('AVG(CASE WHEN t = p THEN 1.0 ELSE 0.0 END)')} AS accuracy "
    f"FROM (SELECT split, {CASCADE_SQL.format(d='approved')} AS t, {CASCADE_SQL.format(d='rule_decision')} AS p "
    f"FROM splitted) x GROUP BY split", *O.split_ctes()))
def q_multiclass_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows whose denial reason under the decision (P18) equals
    the one under the label (P17), per split."""
    df = prep.denial_reason_for(prep.denial_reason_final(_split(spark, sf_dir)), "rule_decision", "pred")
    return parity.multiclass_accuracy(df, "denial_reason_final", "pred", by=["split"])


# --- G1-G5, G16, J2, R2 ------------------------------------------------------------

def _describe_sql(source: str, scopes_sql: list[str], cols: list[str]) -> str:
    long = "\nUNION ALL\n".join(
        f"SELECT {scope} AS scope, '{c}' AS predictor, CAST({c} AS DOUBLE) AS value FROM {source}{where}"
        for c in cols for scope, where in scopes_sql)
    stats = (f"SELECT predictor, scope, CAST(COUNT(value) AS BIGINT) AS count, {R('AVG(value)')} AS mean, "
             f"{R('STDDEV_SAMP(value)')} AS std, {R('MIN(value)')} AS min, "
             f"{R('quantile_cont(value, 0.25)')} AS q25, {R('quantile_cont(value, 0.5)')} AS q50, "
             f"{R('quantile_cont(value, 0.75)')} AS q75, {R('MAX(value)')} AS max FROM dl GROUP BY predictor, scope")
    return long, stats


YEARS_IN = ", ".join(str(y) for y in DESCRIBE_YEARS)
DROPPED = "SELECT * FROM applications WHERE " + " AND ".join(f"{p} IS NOT NULL" for p in PREDICTORS)
YEAR_SCOPES = [("'activity_year_' || CAST(activity_year AS VARCHAR)", f" WHERE activity_year IN ({YEARS_IN})"),
               ("'All_years'", "")]
_dl, _ds = _describe_sql("dropped", YEAR_SCOPES, PREDICTORS)
DESCRIBE_CTES = [("dropped", DROPPED), ("dl", _dl), ("ds", _ds)]


@register("describe_by_year", W("SELECT * FROM ds", *DESCRIBE_CTES))
def q_describe_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 (+G2): count, mean, sample sd, min, quartiles, max per predictor,
    for each listed year and all years; after P3, before P4."""
    df = prep.drop_missing(views.applications(spark, sf_dir), PREDICTORS)
    return describe.describe_by_year(df, PREDICTORS, DESCRIBE_YEARS)


_ol, _os = _describe_sql("dropped", [("'All_years'", "")], PREDICTORS)


@register("describe_overall", W("SELECT * FROM ds", ("dropped", DROPPED), ("dl", _ol), ("ds", _os)))
def q_describe_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statistics over all years only."""
    df = prep.drop_missing(views.applications(spark, sf_dir), PREDICTORS)
    return describe.describe_overall(df, PREDICTORS)


_sl, _ss = _describe_sql("splitted", [("'all'", ""), ("split", "")], ["tract_minority_population_percent"])


@register("describe_splits", W("SELECT * FROM ds", *O.split_ctes(), ("dl", _sl), ("ds", _ss)))
def q_describe_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tract share described for all rows, train and test."""
    return describe.describe_splits(_split(spark, sf_dir), "tract_minority_population_percent")


YEAR_SCOPE_NAMES = [f"activity_year_{y}" for y in DESCRIBE_YEARS] + ["All_years"]


def _side_sql(scopes: list[str]) -> str:
    return "SELECT predictor, " + ", ".join(
        f"MAX(CASE WHEN scope = '{s}' THEN {st} END) AS {s}_{st}" for s in scopes for st in describe.STATS
    ) + " FROM ds GROUP BY predictor"


@register("side_by_side_descriptives", W(_side_sql(YEAR_SCOPE_NAMES), *DESCRIBE_CTES))
def q_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per predictor, the four year blocks and the overall block side by side."""
    return describe.side_by_side(q_describe_by_year(spark, sf_dir), YEAR_SCOPE_NAMES)


@register("transpose_describe", W(_side_sql(["All_years"]), ("dropped", DROPPED), ("dl", _ol), ("ds", _os)))
def q_transpose_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: statistics as columns (All_years_count ... All_years_max)."""
    return describe.side_by_side(q_describe_overall(spark, sf_dir), ["All_years"])


@register("condition_counts", W("\nUNION ALL\n".join(
    [f"SELECT '{sanitize_name(c + '_' + v)} == 1' AS condition, CAST(COUNT_IF({c} = '{v}') AS BIGINT) AS count "
     f"FROM sl" for c, v in CONDITIONS]
    + ["SELECT 'All conditions met' AS condition, CAST(COUNT_IF(" + " AND ".join(
        f"{c} = '{v}'" for c, v in CONDITIONS) + ") AS BIGINT) AS count FROM sl"]),
    ("sl", f"SELECT * FROM labelled WHERE activity_year = {SLICE_YEAR}")))
def q_condition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows meeting each of the eight conditions and all of them, in the
    single-year slice, counted before the exclusion."""
    return describe.condition_counts(views.labelled_year(spark, sf_dir))


@register("denial_reason_counts", O.with_inputs(
    "\nUNION ALL\n".join(
        f"SELECT '{sanitize_name(s + '_' + code)}' AS denial_reason, CAST(COUNT_IF({s} = '{code}') AS BIGINT) "
        f"AS count FROM labelled"
        for s, codes in __import__("equiloan.constants", fromlist=["DENIAL_CODES"]).DENIAL_CODES.items()
        for code in codes)))
def q_denial_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count of 1s of each of the 38 denial indicators, zeros included."""
    return describe.denial_reason_counts(views.labelled(spark, sf_dir))


N_APPS_COLS = 26
N_LABELLED_COLS = 34
EXCL_SQL = " AND ".join(f"NOT ({c} IS NOT DISTINCT FROM '{v}')" for c, v in CONDITIONS)
NOTNULL_SQL = " AND ".join(f"{p} IS NOT NULL" for p in PREDICTORS)


@register("stage_audit", W(f"""
SELECT 1 AS stage_order, 'loaded' AS stage, CAST(COUNT(*) AS BIGINT) AS rows, {N_APPS_COLS} AS columns FROM applications
UNION ALL SELECT 2, 'dropped_missing', CAST(COUNT_IF({NOTNULL_SQL}) AS BIGINT), {N_APPS_COLS} FROM applications
UNION ALL SELECT 3, 'labelled', CAST(COUNT_IF({NOTNULL_SQL} AND action_taken IN (1, 2, 3)) AS BIGINT), {N_LABELLED_COLS} FROM applications
UNION ALL SELECT 4, 'year_slice', CAST(COUNT_IF({NOTNULL_SQL} AND action_taken IN (1, 2, 3) AND activity_year = {SLICE_YEAR}) AS BIGINT), {N_LABELLED_COLS} FROM applications
UNION ALL SELECT 5, 'excluded', CAST(COUNT_IF({NOTNULL_SQL} AND action_taken IN (1, 2, 3) AND activity_year = {SLICE_YEAR} AND {EXCL_SQL}) AS BIGINT), {N_LABELLED_COLS} FROM applications
UNION ALL SELECT 6, 'model_columns', CAST(COUNT_IF({NOTNULL_SQL} AND action_taken IN (1, 2, 3) AND activity_year = {SLICE_YEAR} AND {EXCL_SQL}) AS BIGINT), 8 FROM applications
"""))
def q_stage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns after each stage of the single-year experiment,
    counted in one pass over the applications."""
    apps = views.applications(spark, sf_dir)
    labelled = views.prepare(apps)
    stages = [
        ("loaded", F.lit(True), len(apps.columns)),
        ("dropped_missing", prep.no_missing(PREDICTORS), len(apps.columns)),
        ("labelled", prep.has_valid_action(), len(labelled.columns)),
        ("year_slice", src.in_year(SLICE_YEAR), len(labelled.columns)),
        ("excluded", prep.not_excluded(apps.columns), len(labelled.columns)),
        ("model_columns", F.lit(True), len(prep.retain(labelled, PREDICTORS).columns)),
    ]
    return describe.stage_audit(apps, stages)


# --- T1-T3 ----------------------------------------------------------------------

@register("stratified_split", W("SELECT application_id, bins, split FROM splitted", *O.split_ctes()))
def q_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """75/25 split stratified on the ten tract-share bins."""
    return _split(spark, sf_dir).select("application_id", "bins", "split")


@register("random_split", W(f"SELECT application_id, CASE WHEN {portable_hash_sql('application_id', 42)} "
                            "< 0.25 * 1000003 THEN 'test' ELSE 'train' END AS split FROM labelled"))
def q_random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain seeded split by hash threshold."""
    return splits.random_split(views.labelled(spark, sf_dir)).select("application_id", "split")


@register("downsample_majority", W(
    "SELECT application_id, approved FROM (SELECT application_id, approved, ROW_NUMBER() OVER "
    f"(PARTITION BY approved ORDER BY {portable_hash_sql('application_id', 42)}, application_id) AS rn "
    "FROM labelled) r WHERE rn <= (SELECT MIN(c) FROM (SELECT COUNT(*) AS c FROM labelled GROUP BY approved) m)"))
def q_downsample_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger class sampled down to the size of the smaller."""
    return splits.downsample_majority(views.labelled(spark, sf_dir)).select("application_id", "approved")


# --- M1-M4 ----------------------------------------------------------------------

SPLIT_WEIGHT_CTES = [
    *O.split_ctes(),
    ("long", O.attribute_long("splitted", extra="split, ")),
    ("cells", "SELECT split, attribute, g, y, COUNT(*) AS n FROM long GROUP BY split, attribute, g, y"),
    ("wt", "SELECT split, attribute, g, y, n, CAST(SUM(n) OVER (PARTITION BY split, attribute, g) AS DOUBLE) "
           "* CAST(SUM(n) OVER (PARTITION BY split, attribute, y) AS DOUBLE) / NULLIF(CAST(SUM(n) OVER "
           "(PARTITION BY split, attribute) AS DOUBLE) * CAST(n AS DOUBLE), 0) AS weight FROM cells"),
]


@register("reweigh", W(f"SELECT split, attribute, g, y, CAST(n AS BIGINT) AS n, {R('weight')} AS weight FROM wt",
                       *SPLIT_WEIGHT_CTES))
def q_reweigh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: reweighing weights per (group, label) cell, fitted separately on
    the training and the test split, for every attribute."""
    w = mitigate.reweigh_weights(_split(spark, sf_dir), ATTRIBUTES, by=["split"])
    return w.select("split", "attribute", "g", "y", "n", round6("weight").alias("weight"))


@register("reweigh_rows", W(
    f"SELECT s.application_id, s.split, {R('wt.weight')} AS weight FROM splitted s JOIN wt ON wt.split = s.split "
    "AND wt.attribute = 'a50' AND wt.g = s.a50 AND wt.y = s.approved", *SPLIT_WEIGHT_CTES))
def q_reweigh_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: the weights applied: every row with the weight of its cell for a50,
    fitted on its own split."""
    df = _split(spark, sf_dir)
    weights = mitigate.reweigh_weights(df, ["a50"], by=["split"])
    out = mitigate.apply_weights(df, weights, "a50", by=["split"])
    return out.select("application_id", "split", round6("weight").alias("weight"))


@register("reweigh_report", W(f"""
SELECT b.split, b.attribute, CAST(b.n_u AS BIGINT) AS n_unprivileged, CAST(b.n_p AS BIGINT) AS n_privileged,
  {R('b.pos_u / NULLIF(b.n_u, 0) - b.pos_p / NULLIF(b.n_p, 0)')} AS statistical_parity_difference,
  {R('(b.pos_u / NULLIF(b.n_u, 0)) / NULLIF(b.pos_p / NULLIF(b.n_p, 0), 0)')} AS disparate_impact,
  {R('b.pos_u / NULLIF(b.n_u, 0) - b.pos_p / NULLIF(b.n_p, 0)')} AS mean_difference,
  {R('a.pos_u / NULLIF(a.n_u, 0) - a.pos_p / NULLIF(a.n_p, 0)')} AS statistical_parity_difference_reweighed,
  {R('(a.pos_u / NULLIF(a.n_u, 0)) / NULLIF(a.pos_p / NULLIF(a.n_p, 0), 0)')} AS disparate_impact_reweighed,
  {R('a.pos_u / NULLIF(a.n_u, 0) - a.pos_p / NULLIF(a.n_p, 0)')} AS mean_difference_reweighed
FROM b JOIN a USING (split, attribute)""",
    *SPLIT_WEIGHT_CTES,
    ("lw", "SELECT l.*, wt.weight FROM long l JOIN wt USING (split, attribute, g, y)"),
    ("b", f"SELECT split, attribute, {O.conditional_sums()} FROM lw GROUP BY split, attribute"),
    ("a", f"SELECT split, attribute, {O.conditional_sums('weight')} FROM lw GROUP BY split, attribute")))
def q_reweigh_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: label parity before and after reweighing, train and test, in one job."""
    return mitigate.reweigh_report(_split(spark, sf_dir), ATTRIBUTES, by=["split"])


REPAIR_ATTR = "a50"
_rsel, _rjoin = O.repaired_columns("rp", "s", REPAIR_ATTR, PREDICTORS)


@register("repair_disparate_impact", W(
    f"SELECT s.application_id, " + ", ".join(f"{R(f'x.{p}')} AS {p}" for p in PREDICTORS)
    + f" FROM labelled s0 JOIN (SELECT s.application_id, {_rsel} FROM labelled s {_rjoin}) x "
      f"ON x.application_id = s0.application_id JOIN labelled s ON s.application_id = s0.application_id",
    *O.repair_ctes("rp", "labelled", REPAIR_ATTR, PREDICTORS)))
def q_repair_disparate_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: the six predictors repaired (level 1) for attribute a50."""
    rep = mitigate.repair_disparate_impact(views.labelled(spark, sf_dir), PREDICTORS, REPAIR_ATTR)
    return rep.select("application_id", *[round6(p).alias(p) for p in PREDICTORS])


def _gap_sql(source: str, feats: list[str], attr: str, tag: str) -> list[tuple[str, str]]:
    long = "\nUNION ALL\n".join(f"SELECT '{f}' AS feature, CAST({attr} AS INT) AS g, CAST({f} AS DOUBLE) AS value "
                                f"FROM {source} WHERE {f} IS NOT NULL" for f in feats)
    return [
        (f"{tag}_l", long),
        (f"{tag}_m", f"SELECT feature, AVG(CASE WHEN g = 0 THEN value END) AS mu, AVG(CASE WHEN g = 1 THEN value END) "
                     f"AS mp FROM {tag}_l GROUP BY feature"),
        (f"{tag}_d", f"SELECT feature, value, COUNT_IF(g = 0) AS n0, COUNT_IF(g = 1) AS n1 FROM {tag}_l "
                     f"GROUP BY feature, value"),
        (f"{tag}_c", f"SELECT feature, SUM(n0) OVER (PARTITION BY feature ORDER BY value) AS c0, "
                     f"SUM(n1) OVER (PARTITION BY feature ORDER BY value) AS c1, "
                     f"SUM(n0) OVER (PARTITION BY feature) AS t0, SUM(n1) OVER (PARTITION BY feature) AS t1 "
                     f"FROM {tag}_d"),
        (f"{tag}_k", f"SELECT feature, MAX(ABS(CAST(c0 AS DOUBLE) / NULLIF(CAST(t0 AS DOUBLE), 0) "
                     f"- CAST(c1 AS DOUBLE) / NULLIF(CAST(t1 AS DOUBLE), 0))) AS ks FROM {tag}_c GROUP BY feature"),
    ]


REPAIRED_SQL = (f"SELECT s.application_id, s.approved, s.{REPAIR_ATTR}, {_rsel} FROM labelled s {_rjoin}")
SPD_SQL = ("SELECT AVG(CASE WHEN {a} = 0 THEN approved END) - AVG(CASE WHEN {a} = 1 THEN approved END) AS spd "
           "FROM {src}")


@register("repair_report", W(
    f"""SELECT bm.feature, {R('bm.mu')} AS mean_unprivileged_before, {R('bm.mp')} AS mean_privileged_before,
  {R('bk.ks')} AS ks_distance_before, {R('am.mu')} AS mean_unprivileged_after, {R('am.mp')} AS mean_privileged_after,
  {R('ak.ks')} AS ks_distance_after, '{REPAIR_ATTR}' AS attribute, {R('sb.spd')} AS spd_before, {R('sa.spd')} AS spd_after
FROM bf_m bm JOIN bf_k bk USING (feature) JOIN af_m am USING (feature) JOIN af_k ak USING (feature), sb, sa""",
    *O.repair_ctes("rp", "labelled", REPAIR_ATTR, PREDICTORS),
    ("repaired", REPAIRED_SQL),
    *_gap_sql("labelled", PREDICTORS, REPAIR_ATTR, "bf"),
    *_gap_sql("repaired", PREDICTORS, REPAIR_ATTR, "af"),
    ("sb", SPD_SQL.format(a=REPAIR_ATTR, src="labelled")),
    ("sa", SPD_SQL.format(a=REPAIR_ATTR, src="repaired"))))
def q_repair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: group means and KS distance of each predictor before and after
    repair, with the label parity (unchanged by repair)."""
    df = views.labelled(spark, sf_dir)
    rep = mitigate.repair_disparate_impact(df, PREDICTORS, REPAIR_ATTR)
    out = mitigate.repair_report(df, rep, PREDICTORS, REPAIR_ATTR)
    return out.withColumn("spd_before", round6("spd_before")).withColumn("spd_after", round6("spd_after"))


# --- J1, J3-J5 ------------------------------------------------------------------------

@register("append_columns", W(
    f"SELECT application_id, {', '.join(PREDICTORS)}, approved, approved AS original_approved, "
    + ", ".join(f"{a} AS {a}_approved" for a in ATTRIBUTES)
    + f", {CASCADE_SQL.format(d='approved')} AS denial_reason_final FROM labelled"))
def q_append_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived approval and denial-reason columns appended to the same
    rows (no positional glue, no duplicated predictors)."""
    df = views.labelled(spark, sf_dir)
    cols = {"original_approved": F.col("approved")}
    cols.update({f"{a}_approved": F.col(a) for a in ATTRIBUTES})
    out = prep.denial_reason_final(compose.append_columns(df, cols))
    return out.select("application_id", *PREDICTORS, "approved", "original_approved",
                      *[f"{a}_approved" for a in ATTRIBUTES], "denial_reason_final")


@register("align_predictions", W(
    "SELECT l.application_id, l.approved, t.rule_decision AS prediction_test FROM labelled l "
    "LEFT JOIN (SELECT application_id, rule_decision FROM splitted WHERE split = 'test') t USING (application_id)",
    *O.split_ctes()))
def q_align_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test-split decisions attached to the whole table by key; other rows null."""
    test = _split(spark, sf_dir).filter(F.col("split") == "test")
    return compose.align_predictions(views.labelled(spark, sf_dir).select("application_id", "approved"),
                                     test, prediction="rule_decision", out="prediction_test")


@register("aligned_metrics", W(
    f"SELECT c.attribute, {O.metric_select()}, CAST(x.n AS BIGINT) AS n_excluded FROM c JOIN th ON TRUE JOIN x ON TRUE",
    *O.split_ctes(),
    ("test", "SELECT * FROM splitted WHERE split = 'test'"),
    ("long", O.attribute_long("test")),
    ("c", f"SELECT attribute, {O.conditional_sums()} FROM long GROUP BY attribute"),
    ("th", O.theil_per_row("test")),
    ("x", "SELECT COUNT(*) AS n FROM splitted WHERE split <> 'test'")))
def q_aligned_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6-G13 over J3's output: decisions known only for the test split. Rows
    without a decision are counted apart and enter no metric."""
    df = _split(spark, sf_dir)
    test = df.filter(F.col("split") == "test").select("application_id", "rule_decision")
    aligned = compose.align_predictions(df.drop("rule_decision"), test, prediction="rule_decision", out="prediction_test")
    ct = parity.contingency(aligned, ATTRIBUTES, decision="prediction_test")
    return parity.parity_metrics(ct).join(parity.excluded_rows(ct), "attribute")


RULE_FEATURES = ["income", "loan_to_value_ratio"]


def _repaired_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared table with the scorecard's decision on features repaired
    for each attribute (``decision_scorecard_repair_<a>``): one repair fit for
    all attributes, then columns computed from the same row."""
    df = views.labelled(spark, sf_dir)
    edges = mitigate.repair_edges(df, RULE_FEATURES, ATTRIBUTES)
    for a in ATTRIBUTES:
        names = {f: f"_{f}" for f in RULE_FEATURES}
        df = mitigate.repaired_columns(df, edges, RULE_FEATURES, a, names=names)
        df = rule_decision(df, names["income"], names["loan_to_value_ratio"], f"decision_scorecard_repair_{a}").drop(
            *names.values())
    return df


def _rep_long_sql() -> list[tuple[str, str]]:
    sel, joins = O.repaired_columns("rq", "s", "", RULE_FEATURES, attr_expr="s.attribute", g_expr="s.g")
    base = "\nUNION ALL\n".join(
        f"SELECT application_id, approved, income, loan_to_value_ratio, '{a}' AS attribute, CAST({a} AS INT) AS g "
        f"FROM labelled" for a in ATTRIBUTES)
    return [
        *O.repair_ctes("rq", "labelled", ATTRIBUTES, RULE_FEATURES),
        ("lb", base),
        ("rl", f"SELECT s.application_id, s.approved, s.attribute, s.g, {sel} FROM lb s {joins}"),
        ("rd", "SELECT application_id, approved, attribute, g, CASE WHEN income > 2500 AND loan_to_value_ratio < 3 "
               "THEN 1 ELSE 0 END AS decision FROM rl"),
    ]


@register("attach_model_decisions", W(
    "SELECT l.application_id, l.approved, l.rule_decision AS decision_scorecard, " + ", ".join(
        f"p.decision_scorecard_repair_{a}" for a in ATTRIBUTES)
    + " FROM labelled l LEFT JOIN (SELECT application_id, " + ", ".join(
        f"MAX(CASE WHEN attribute = '{a}' THEN decision END) AS decision_scorecard_repair_{a}" for a in ATTRIBUTES)
    + " FROM rd GROUP BY application_id) p USING (application_id)", *_rep_long_sql()))
def q_attach_model_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of several models (the scorecard on original features,
    and on features repaired for each attribute) beside the rows: one
    projection of the same rows, no join or pivot of the table."""
    df = _repaired_decisions(spark, sf_dir)
    return df.select("application_id", "approved", F.col("rule_decision").alias("decision_scorecard"),
                     *[f"decision_scorecard_repair_{a}" for a in ATTRIBUTES])


@register("merge_result_tables", W(
    f"SELECT application_id, approved AS original_approved_orig, {CASCADE_SQL.format(d='approved')} "
    f"AS denial_reason_final_orig, rule_decision AS original_approved_rule, {CASCADE_SQL.format(d='rule_decision')} "
    f"AS denial_reason_final_rule FROM labelled"))
def q_merge_result_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two result tables (label-based and decision-based) joined on the key
    with suffixed columns."""
    df = views.labelled(spark, sf_dir)
    a = prep.denial_reason_final(df).select("application_id", F.col("approved").alias("original_approved"),
                                            "denial_reason_final")
    b = prep.denial_reason_final(df, decision="rule_decision").select(
        "application_id", F.col("rule_decision").alias("original_approved"), "denial_reason_final")
    return compose.merge_result_tables(a, b, ["application_id"], ("_orig", "_rule"))


# --- R3, R4, R6 ---------------------------------------------------------------------------

PLOT_METRICS = ["statistical_parity_difference", "disparate_impact", "decision_parity_difference",
                "decision_disparate_impact", "average_odds_difference", "equal_opportunity_difference"]
W_DEC_CTES = [
    ("longd", O.attribute_long("labelled")),
    ("cells", "SELECT attribute, g, y, COUNT(*) AS n FROM longd GROUP BY attribute, g, y"),
    ("wt", "SELECT attribute, g, y, CAST(SUM(n) OVER (PARTITION BY attribute, g) AS DOUBLE) "
           "* CAST(SUM(n) OVER (PARTITION BY attribute, y) AS DOUBLE) / NULLIF(CAST(SUM(n) OVER "
           "(PARTITION BY attribute) AS DOUBLE) * CAST(n AS DOUBLE), 0) AS weight FROM cells"),
    ("cwd", f"SELECT attribute, {O.conditional_sums('weight')} FROM longd JOIN wt USING (attribute, g, y) "
            f"GROUP BY attribute"),
    ("fw", f"SELECT cwd.attribute, {O.metric_select('cwd', counts_as_bigint=False)} FROM cwd JOIN th ON TRUE"),
]


@register("plot_series", W("\nUNION ALL\n".join(
    f"SELECT '{m}' AS chart, 'parity' AS section, 'scorecard' AS model, '{cat}' AS category, '{m}' AS metric, "
    f"CAST(substr(attribute, 2) AS INT) AS threshold, CAST({m} AS DOUBLE) AS value FROM {t}"
    for cat, t in (("original", "fm"), ("reweighed", "fw")) for m in PLOT_METRICS),
    *FLAGSHIP_CTES, *W_DEC_CTES))
def q_plot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart series (chart, section, model, category, metric, threshold,
    value) for the original and the reweighed data."""
    df = views.labelled(spark, sf_dir)
    ct = parity.contingency(df, ATTRIBUTES)
    weights = mitigate.weights_from_contingency(ct, [])
    orig = parity.metrics_long(parity.parity_metrics(ct), metric_names=PLOT_METRICS)
    rew = parity.metrics_long(parity.parity_metrics(mitigate.weighted_contingency(ct, weights), weighted=True),
                                metric_names=PLOT_METRICS)
    a = report.plot_series(orig, F.col("metric"), "parity", "scorecard", F.lit("original"))
    b = report.plot_series(rew, F.col("metric"), "parity", "scorecard", F.lit("reweighed"))
    return a.unionByName(b)


@register("approval_series", W(
    "SELECT 'label' AS model, attribute, g, CAST(COUNT(*) AS BIGINT) AS n, "
    f"{R('AVG(CAST(y AS DOUBLE))')} AS approval_rate FROM long GROUP BY attribute, g "
    "UNION ALL SELECT 'decision', attribute, g, CAST(COUNT(*) AS BIGINT), "
    f"{R('AVG(CAST(yhat AS DOUBLE))')} FROM long GROUP BY attribute, g",
    ("long", O.attribute_long("labelled"))))
def q_approval_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approval rate per model (label, decision), attribute and group."""
    return report.approval_series(parity.contingency(views.labelled(spark, sf_dir), ATTRIBUTES))


@register("approval_series_aligned", W(
    "SELECT 'label' AS model, attribute, g, CAST(COUNT(y) AS BIGINT) AS n, "
    f"{R('AVG(CAST(y AS DOUBLE))')} AS approval_rate FROM long GROUP BY attribute, g "
    "UNION ALL SELECT 'decision', attribute, g, CAST(COUNT(yhat) AS BIGINT), "
    f"{R('AVG(CAST(yhat AS DOUBLE))')} FROM long GROUP BY attribute, g",
    *O.split_ctes(),
    ("aligned", "SELECT * REPLACE (CASE WHEN split = 'test' THEN rule_decision END AS rule_decision) FROM splitted"),
    ("long", O.attribute_long("aligned"))))
def q_approval_series_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4 over J3's output: decisions known for the test split alone; a missing
    decision is no rejection."""
    df = _split(spark, sf_dir)
    test = df.filter(F.col("split") == "test").select("application_id", "rule_decision")
    aligned = compose.align_predictions(df.drop("rule_decision"), test, prediction="rule_decision", out="prediction_test")
    return report.approval_series(parity.contingency(aligned, ATTRIBUTES, decision="prediction_test"))


@register("compare_mitigations", W(
    f"""SELECT fm.attribute, fm.decision_parity_difference AS decision_parity_difference_original,
  fw.decision_parity_difference AS decision_parity_difference_reweighed,
  rp.dpd AS decision_parity_difference_repaired,
  {R('fw.decision_parity_difference - fm.decision_parity_difference')} AS change_reweighed,
  {R('rp.dpd - fm.decision_parity_difference')} AS change_repaired
FROM fm JOIN fw USING (attribute) JOIN rp USING (attribute)""",
    *FLAGSHIP_CTES, *W_DEC_CTES, *_rep_long_sql(),
    ("rp", f"SELECT attribute, {R('AVG(CASE WHEN g = 0 THEN CAST(decision AS DOUBLE) END) - AVG(CASE WHEN g = 1 THEN CAST(decision AS DOUBLE) END)')} "
           f"AS dpd FROM rd GROUP BY attribute")))
def q_compare_mitigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision parity of the scorecard on the original data, with
    reweighing weights, and on repaired features, per attribute, with the
    change each mitigation makes."""
    df = _repaired_decisions(spark, sf_dir)
    ct = parity.contingency(df, ATTRIBUTES)
    weights = mitigate.weights_from_contingency(ct, [])
    orig = parity.parity_metrics(ct)
    rew = parity.parity_metrics(mitigate.weighted_contingency(ct, weights), weighted=True)
    long = df.select("approved", F.explode(F.array(*[
        F.struct(F.lit(a).alias("attribute"), F.col(a).cast("int").alias("g"),
                 F.col(f"decision_scorecard_repair_{a}").alias("yhat")) for a in ATTRIBUTES])).alias("x"))
    rct = (long.groupBy("x.attribute", "x.g", F.col("approved").alias("y"), "x.yhat")
           .agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.col("n").cast("double")))
    rep = parity.parity_metrics(rct)
    return report.compare_mitigations({"original": orig, "reweighed": rew, "repaired": rep},
                                      "decision_parity_difference")


# --- the single-year experiment, end to end (R1 of the whole flow) ------------------

EXP_LABEL_METRICS = ["statistical_parity_difference", "disparate_impact", "mean_difference"]
EXP_DECISION_METRICS = ["average_odds_difference", "equal_opportunity_difference", "theil_index"]
EXP_SCORES = ["accuracy", "f1", "recall", "precision"]


def _exp_metric_sql(c: str) -> str:
    return f"""
  {R('pos_u / NULLIF(n_u, 0) - pos_p / NULLIF(n_p, 0)')} AS statistical_parity_difference,
  {R('(pos_u / NULLIF(n_u, 0)) / NULLIF(pos_p / NULLIF(n_p, 0), 0)')} AS disparate_impact,
  {R('pos_u / NULLIF(n_u, 0) - pos_p / NULLIF(n_p, 0)')} AS mean_difference,
  {R('0.5 * ((fp_u / NULLIF(neg_u, 0) - fp_p / NULLIF(neg_p, 0)) + (tp_u / NULLIF(pos_u, 0) - tp_p / NULLIF(pos_p, 0)))')} AS average_odds_difference,
  {R('tp_u / NULLIF(pos_u, 0) - tp_p / NULLIF(pos_p, 0)')} AS equal_opportunity_difference,
  {R('th.theil')} AS theil_index"""


_EXP_LONG = "\nUNION ALL\n".join(
    [f"SELECT attribute, '{m} (original ' || split || ')' AS metric, CAST({m} AS DOUBLE) AS value FROM mo"
     for m in EXP_LABEL_METRICS + EXP_DECISION_METRICS]
    + [f"SELECT attribute, '{m} (reweighed ' || split || ')' AS metric, CAST({m} AS DOUBLE) AS value FROM mw"
       for m in EXP_LABEL_METRICS + EXP_DECISION_METRICS]
    + [f"SELECT a.attribute, '{m} (original ' || sc.split || ')' AS metric, CAST(sc.{m} AS DOUBLE) AS value "
       f"FROM sc JOIN (SELECT DISTINCT attribute FROM mo) a ON TRUE" for m in EXP_SCORES])

PERFORMANCE_RESULTS_SQL = W(
    "SELECT metric, " + ", ".join(f"MAX(CASE WHEN attribute = '{a}' THEN value END) AS {a}" for a in ATTRIBUTES)
    + " FROM ml GROUP BY metric",
    ("sl", f"SELECT * FROM labelled WHERE activity_year = {SLICE_YEAR} AND {EXCL_SQL}"),
    *O.split_ctes("sl"),
    ("long", O.attribute_long("splitted", extra="split, ")),
    ("cells", "SELECT split, attribute, g, y, COUNT(*) AS n FROM long GROUP BY split, attribute, g, y"),
    ("wt", "SELECT split, attribute, g, y, CAST(SUM(n) OVER (PARTITION BY split, attribute, g) AS DOUBLE) "
           "* CAST(SUM(n) OVER (PARTITION BY split, attribute, y) AS DOUBLE) / NULLIF(CAST(SUM(n) OVER "
           "(PARTITION BY split, attribute) AS DOUBLE) * CAST(n AS DOUBLE), 0) AS weight FROM cells"),
    ("lw", "SELECT l.*, wt.weight FROM long l JOIN wt USING (split, attribute, g, y)"),
    ("co", f"SELECT split, attribute, {O.conditional_sums()} FROM lw GROUP BY split, attribute"),
    ("cw", f"SELECT split, attribute, {O.conditional_sums('weight')} FROM lw GROUP BY split, attribute"),
    ("th", O.theil_per_row("splitted", by="split")),
    ("mo", f"SELECT co.split, co.attribute, {_exp_metric_sql('co')} FROM co JOIN th USING (split)"),
    ("mw", f"SELECT cw.split, cw.attribute, {_exp_metric_sql('cw')} FROM cw JOIN th USING (split)"),
    ("sc", SCORE_SQL),
    ("ml", _EXP_LONG),
)


@register("performance_results", PERFORMANCE_RESULTS_SQL)
def q_performance_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single-year experiment end to end: S2 year slice -> P13 exclusion
    -> P16 bins -> T1 split -> per split, label parity before and after
    reweighing (M1 fitted per split), decision parity (AOD, EOD, Theil; the
    reweighed ones with weights) and scores of the decisions -> R1 matrix of
    metric x attribute. Weights, metrics and scores all come from one
    contingency table."""
    df = prep.exclude_where(views.labelled_year(spark, sf_dir))
    df = splits.stratified_split(prep.equal_width_bins(df))
    ct = parity.contingency(df, ATTRIBUTES, decision="rule_decision", by=["split"])
    weights = mitigate.weights_from_contingency(ct, ["split"])
    names = EXP_LABEL_METRICS + EXP_DECISION_METRICS
    orig = parity.metrics_long(parity.parity_metrics(ct, by=["split"]), by=["split"], metric_names=names)
    rew = parity.metrics_long(
        parity.parity_metrics(mitigate.weighted_contingency(ct, weights, ["split"]), by=["split"], weighted=True),
        by=["split"], metric_names=names)
    sc = parity.classification_scores(ct, by=["split"])
    scl = sc.unpivot(ids=["split", "attribute"], values=EXP_SCORES, variableColumnName="metric",
                     valueColumnName="value")

    def label(t: DataFrame, cat: str) -> DataFrame:
        return t.select("attribute", F.concat(F.col("metric"), F.lit(f" ({cat} "), F.col("split"), F.lit(")"))
                        .alias("metric"), F.col("value").cast("double").alias("value"))

    long = label(orig, "original").unionByName(label(rew, "reweighed")).unionByName(label(scl, "original"))
    return report.results_matrix(long, ATTRIBUTES)
