import pytest
from pyspark.sql import functions as F

from equiloan.functions.columns import sanitize_name, sanitize_names
from equiloan.operators import describe, prep


def test_sanitize_names():
    assert sanitize_name("denial_reason-2_1.0") == "denial_reason_2_1"
    assert sanitize_name("open-end_line_of_credit") == "open_end_line_of_credit"
    assert sanitize_name("applicant_age_<25") == "applicant_age_lt25"
    with pytest.raises(ValueError):
        sanitize_names(["a-b", "a_b"])


def test_one_hot_null_gives_zeros_and_drops_source(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, c string")
    out = prep.one_hot(df, ["c"])
    assert out.columns == ["id", "c_x", "c_y"]
    rows = {r["id"]: (r["c_x"], r["c_y"]) for r in out.collect()}
    assert rows == {1: (1, 0), 2: (0, 1), 3: (0, 0)}


def test_vocabulary_cap(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        prep.collect_vocabulary(df, ["c"], cap=10)
    with pytest.raises(ValueError):
        prep.code_table(df, ["c"], cap=10)
    assert prep.code_table(df, ["c"], cap=50).count() == 50


def test_exclude_where_is_null_safe(spark):
    df = spark.createDataFrame([(1, "1"), (2, "2"), (3, None)], "id long, loan_type string")
    kept = {r[0] for r in prep.exclude_where(df, [("loan_type", "1")]).collect()}
    assert kept == {2, 3}


def test_denial_cascade_first_match(spark):
    rows = [(1, 1, "1", None, None, None), (2, 0, "4", "1", None, None), (3, 0, "4", None, None, None),
            (4, 0, "7", None, "5", None), (5, 0, "7", None, None, None), (6, 0, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, approved int, denial_reason_1 string, denial_reason_2 string, "
                                     "denial_reason_3 string, denial_reason_4 string")
    got = {r[0]: r[1] for r in prep.denial_reason_final(df).select("id", "denial_reason_final").collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5}


def test_min_max_constant_column_and_nulls(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0), (3, 5.0, None)], "id long, c double, d double")
    out = {r[0]: (r[1], r[2]) for r in prep.min_max(df, ["c", "d"]).collect()}
    assert out == {1: (0.0, 0.0), 2: (0.0, 1.0), 3: (0.0, None)}


def test_equal_width_bins_right_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 10, 10.5, 20, 100)], "tract_minority_population_percent double")
    got = [r[0] for r in prep.equal_width_bins(df).orderBy("tract_minority_population_percent").select("bins").collect()]
    assert got == [0, 0, 1, 1, 9]


def test_standardize_uses_population_sd(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    out = [r[0] for r in prep.standardize(df, ["x"]).collect()]
    assert out == pytest.approx([-1.0, 1.0])


def test_validate_labels(spark):
    df = spark.createDataFrame([(1, 0), (0, 2), (None, 1)], "approved int, a40 int")
    rep = {r["column"]: (r["n_null"], r["n_invalid"]) for r in prep.validate_labels(df, "approved", ["a40"]).collect()}
    assert rep == {"approved": (1, 0), "a40": (0, 1)}
    with pytest.raises(ValueError):
        prep.validate_labels(df, "approved", ["a50"])


def test_condition_and_denial_counts(spark):
    df = spark.createDataFrame([("1", "1", "3"), ("1", "31", "1"), ("2", "1", None)],
                               "loan_type string, loan_purpose string, denial_reason_1 string")
    c = {r[0]: r[1] for r in describe.condition_counts(df, [("loan_type", "1"), ("loan_purpose", "1")]).collect()}
    assert c == {"loan_type_1 == 1": 2, "loan_purpose_1 == 1": 2, "All conditions met": 1}
    d = {r[0]: r[1] for r in describe.denial_reason_counts(df).collect()}
    assert len(d) == 38 and d["denial_reason_1_3"] == 1 and d["denial_reason_1_1"] == 1 and d["denial_reason_2_1"] == 0


def test_stage_audit_single_pass(spark):
    df = spark.range(10).select(F.col("id"))
    out = describe.stage_audit(df, [("all", F.lit(True), 1), ("even", F.col("id") % 2 == 0, 1),
                                    ("small", F.col("id") < 5, 2)])
    assert [(r[1], r[2], r[3]) for r in out.orderBy("stage_order").collect()] == [("all", 10, 1), ("even", 5, 1),
                                                                                  ("small", 3, 2)]


def test_codes_of_wide_columns_by_ranges_and_joins(spark, monkeypatch):
    """A column of many values: codes by ranges of the vocabulary, applied by a
    join; the same as the literal map's."""
    df = spark.range(600).selectExpr("id", "CONCAT('v', pmod(id * 7919, 211)) AS wide", "CAST(id % 3 AS STRING) AS few",
                                     "IF(id % 5 = 0, NULL, CONCAT('x', id % 70)) AS gaps")
    cols = ["wide", "few", "gaps"]
    ranks = {c: {v: i for i, v in enumerate(sorted({r[0] for r in df.select(c).collect() if r[0] is not None}))} for c in cols}
    table = prep.code_table(df, cols, buckets=5)
    assert {(r["column"], r["value"]): r["code"] for r in table.collect()} == {
        (c, v): i for c in cols for v, i in ranks[c].items()}
    for limit in (50, 0, 1000):
        monkeypatch.setattr(prep, "LITERAL_VALUES", limit)
        got = prep.categorize(df, cols)
        assert got.columns == ["id", *cols, *[f"{c}_code" for c in cols]] and got.count() == 600
        assert all(r[f"{c}_code"] == (None if r[c] is None else ranks[c][r[c]]) for r in got.collect() for c in cols)
