import math

import pytest
from pyspark.sql import functions as F

from equiloan.operators import parity


def _rows(spark, rows):
    return spark.createDataFrame(rows, "id long, g int, y int, yhat int")


def _metrics(spark, rows, weighted=False):
    df = _rows(spark, rows).withColumnRenamed("g", "a")
    ct = parity.contingency(df, ["a"], label="y", decision="yhat")
    return parity.parity_metrics(ct, rounded=False).first().asDict()


def test_hand_computed_metrics(spark):
    # unprivileged (g=0): 4 rows, labels 1,1,0,0, decisions 1,0,1,0
    # privileged (g=1): 4 rows, labels 1,1,1,0, decisions 1,1,1,1
    rows = [(1, 0, 1, 1), (2, 0, 1, 0), (3, 0, 0, 1), (4, 0, 0, 0),
            (5, 1, 1, 1), (6, 1, 1, 1), (7, 1, 1, 1), (8, 1, 0, 1)]
    m = _metrics(spark, rows)
    assert m["n_unprivileged"] == 4 and m["n_privileged"] == 4
    assert m["statistical_parity_difference"] == pytest.approx(0.5 - 0.75)
    assert m["disparate_impact"] == pytest.approx(0.5 / 0.75)
    assert m["mean_difference"] == pytest.approx(-0.25)
    assert m["decision_parity_difference"] == pytest.approx(0.5 - 1.0)
    tpr_u, tpr_p, fpr_u, fpr_p = 0.5, 1.0, 0.5, 1.0
    assert m["equal_opportunity_difference"] == pytest.approx(tpr_u - tpr_p)
    assert m["average_odds_difference"] == pytest.approx(0.5 * ((fpr_u - fpr_p) + (tpr_u - tpr_p)))
    # Theil from the per-row definition
    b = [yh - y + 1 for _, _, y, yh in rows]
    mu = sum(b) / len(b)
    t = sum((x / mu) * math.log(x / mu) for x in b if x > 0) / len(b)
    assert m["theil_index"] == pytest.approx(t)


def test_empty_group_gives_nulls_not_errors(spark):
    rows = [(1, 1, 1, 1), (2, 1, 0, 0)]
    m = _metrics(spark, rows)
    assert m["n_unprivileged"] == 0
    assert m["statistical_parity_difference"] is None
    assert m["disparate_impact"] is None


def test_all_denied_privileged_gives_null_ratio(spark):
    rows = [(1, 0, 1, 1), (2, 1, 0, 0), (3, 1, 0, 0)]
    m = _metrics(spark, rows)
    assert m["disparate_impact"] is None
    assert m["statistical_parity_difference"] == pytest.approx(1.0)


def test_perfect_decisions_have_zero_theil(spark):
    rows = [(i, i % 2, (i // 2) % 2, (i // 2) % 2) for i in range(12)]
    m = _metrics(spark, rows)
    assert m["theil_index"] == pytest.approx(0.0)
    assert m["theil_index"] >= 0


def test_swapping_groups_negates_differences_and_inverts_ratios(spark):
    rows = [(i, i % 2, int(i % 3 == 0), int(i % 4 != 0)) for i in range(40)]
    a = _metrics(spark, rows)
    b = _metrics(spark, [(i, 1 - g, y, yh) for i, g, y, yh in rows])
    assert a["statistical_parity_difference"] == pytest.approx(-b["statistical_parity_difference"])
    assert a["average_odds_difference"] == pytest.approx(-b["average_odds_difference"])
    assert a["disparate_impact"] == pytest.approx(1.0 / b["disparate_impact"])
    assert a["theil_index"] == pytest.approx(b["theil_index"])


def test_several_attributes_in_one_pass(spark):
    df = spark.createDataFrame([(i, i % 2, i % 3 == 0, int(i % 5 == 0), int(i % 7 == 0)) for i in range(50)],
                               "id long, a int, b boolean, y int, yhat int").withColumn("b", F.col("b").cast("int"))
    ct = parity.contingency(df, ["a", "b"], label="y", decision="yhat")
    assert ct.select("attribute").distinct().count() == 2
    total = {r["attribute"]: r["n"] for r in ct.groupBy("attribute").agg(F.sum("n").alias("n")).collect()}
    assert total == {"a": 50, "b": 50}


def test_classification_scores(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (0, 1), (0, 0)], "y int, yhat int")
    s = parity.binary_scores(df, "y", "yhat").first()
    assert s["accuracy"] == pytest.approx(0.6)
    assert s["precision"] == pytest.approx(2 / 3, abs=1e-6)
    assert s["recall"] == pytest.approx(2 / 3, abs=1e-6)
    assert s["f1"] == pytest.approx(2 / 3, abs=1e-6)


def test_missing_decisions_enter_no_metric(spark):
    rows = [(1, 1, 1, 1)] * 30 + [(1, 0, 0, 0)] * 30 + [(1, 1, 1, 0)] * 20 + [(1, 0, 0, 1)] * 20
    rows += [(1, 1, None, 1)] * 200 + [(1, None, 1, 0)] * 100
    df = spark.createDataFrame([(y, yh, g) for _, y, yh, g in rows], "approved int, d int, a50 int")
    ct = parity.contingency(df, ["a50"], decision="d")
    m = parity.parity_metrics(ct).first()
    assert m["theil_index"] == 0 and m["n_privileged"] == 50 and m["n_unprivileged"] == 50
    assert m["decision_rate_privileged"] == 0.6 and m["decision_rate_unprivileged"] == 0.4
    assert parity.classification_scores(ct).first()["accuracy"] == 1
    assert parity.binary_scores(df, "approved", "d").first()["accuracy"] == 1
    acc = parity.multiclass_accuracy(df, "approved", "d").first()
    assert (acc["n"], acc["accuracy"]) == (100, 1)
    assert parity.excluded_rows(ct).first()["n_excluded"] == 300
