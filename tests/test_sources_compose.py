import pytest
from pyspark.sql import functions as F

from equiloan.operators import compose, describe, prep, report
from equiloan.sources import applications as src
from equiloan.sources import sinks


def test_read_applications_parses_raw_csv(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        "activity_year,loan_amount,income,denial_reason-2,open-end_line_of_credit,total_units,extra\n"
        "2018,1000.5,Exempt,1.0,2,1,x\n"
        "2019, 250 ,42,,1111,5+,y\n"
        "2020,NA,7,10,NA,2,z\n")
    df = src.read_applications(spark, str(path), fmt="csv", missing="skip")
    assert "extra" not in df.columns
    assert dict(df.dtypes)["loan_amount"] == "double" and dict(df.dtypes)["activity_year"] == "int"
    rows = sorted(df.collect(), key=lambda r: r["activity_year"])
    assert rows[0]["income"] is None                     # 'Exempt' -> null, no failure
    assert rows[0]["denial_reason_2"] == "1"             # '1.0' -> '1'
    assert rows[0]["open_end_line_of_credit"] == "2"     # dashed name sanitised
    assert rows[1]["loan_amount"] == 250.0               # padded number parsed
    assert rows[1]["total_units"] is None                # '5+' -> null
    assert rows[2]["loan_amount"] is None                # null marker
    with pytest.raises(ValueError):
        src.read_applications(spark, str(path), fmt="csv")  # a missing column is an error by default


def test_cast_numeric_tolerant_skips_failing_columns(spark):
    df = spark.createDataFrame([("1", "a", 1), ("2.5", "b", 0)], "x string, y string, approved long")
    out = prep.cast_numeric(df)
    types = dict(out.dtypes)
    assert types["x"] == "double" and types["y"] == "string" and types["approved"] == "int"


def test_categorize_and_year_indicators(spark):
    df = spark.createDataFrame([(1, "b", 2019), (2, "a", 2018), (3, None, 2019)], "id long, c string, activity_year int")
    codes = {r["id"]: r["c_code"] for r in prep.categorize(df, ["c"]).collect()}
    assert codes == {1: 1, 2: 0, 3: None}
    y = prep.year_indicators(df)
    assert {"activity_year_2018", "activity_year_2019"} <= set(y.columns)
    assert y.filter(F.col("activity_year_2019") == 1).count() == 2


def test_merge_and_attach_decisions(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.7)], "application_id long, score double")
    b = spark.createDataFrame([(1, 1), (3, 0)], "application_id long, score int")
    m = compose.merge_result_tables(a, b, ["application_id"])
    assert m.columns == ["application_id", "score_rf", "score_nn"] and m.count() == 1
    long = spark.createDataFrame([(1, "m1", 1), (1, "m2", 0), (2, "m1", 0)], "application_id long, model_id string, decision int")
    base = spark.createDataFrame([(1,), (2,), (3,)], "application_id long")
    out = {r[0]: (r[1], r[2]) for r in compose.attach_model_decisions(base, long, ["m1", "m2"]).collect()}
    assert out == {1: (1, 0), 2: (0, None), 3: (None, None)}


def test_results_matrix_and_energy(spark):
    long = spark.createDataFrame([("m", "a40", 1.0), ("m", "a50", 2.0), ("k", "a40", 3.0)],
                                 "metric string, attribute string, value double")
    rm = {r["metric"]: (r["a40"], r["a50"]) for r in report.results_matrix(long, ["a40", "a50"]).collect()}
    assert rm == {"m": (1.0, 2.0), "k": (3.0, None)}
    e = spark.range(1).select(report.energy_kwh(F.lit(1.0)).alias("e")).first()["e"]
    assert e == pytest.approx(1.0 / 24 / 365 * 57754 / 1000)


def test_describe_approx_close_to_exact(spark):
    df = spark.range(1, 2001).select((F.col("id") * 1.5).alias("x"))
    ex = describe.describe_overall(df, ["x"]).first()
    ap = describe.describe_overall(df, ["x"], approx=True).first()
    assert ex["q50"] == pytest.approx(1500.75)
    assert ap["q50"] == pytest.approx(ex["q50"], rel=0.01)
    assert ex["count"] == 2000 and ex["std"] == pytest.approx(866.17, rel=1e-3)


@pytest.mark.parametrize("way", ["one pass", "narrowed", "given up"])
def test_describe_is_exact_with_ties_nulls_and_scopes(spark, monkeypatch, way):
    """Also where brackets have to be narrowed, or given up."""
    import numpy as np

    passes, cells = [], describe._cells
    if way == "given up":
        monkeypatch.setattr(describe, "_ranked", lambda base, brackets: None)
    else:
        monkeypatch.setattr(describe, "_all_ranked", None)
    if way == "narrowed":
        monkeypatch.setattr(describe, "SKETCH_ACCURACY", 60)
        monkeypatch.setattr(describe, "BRACKET_ROWS", 40)
        monkeypatch.setattr(describe, "_cells", lambda base, targets: passes.append(
            cells(base, targets).groupBy("c", "s", "cell").agg(F.count("value").alias("n")).agg(F.max("n")).first()[0])
            or cells(base, targets))
    rng = np.random.default_rng(3)
    rows = [(["p", "q", None][int(rng.integers(0, 3))], float(rng.integers(0, 40)), None if rng.random() < 0.3 else float(rng.normal()))
            for _ in range(3000)] + [("solo", 5.0, None)]
    df = spark.createDataFrame(rows, "s string, x double, y double")
    got = {(r["predictor"], r["scope"]): r for r in describe.describe_scopes(df, ["x", "y"], F.col("s"), "every").collect()}
    assert set(got) == {(c, s) for c in "xy" for s in ("p", "q", "solo", "every")}
    for (c, s), r in got.items():
        v = [x for k, *xy in rows for x in [xy["xy".index(c)]] if x is not None and s in (k, "every")]
        assert r["count"] == len(v)
        for name, p in (("min", 0), ("q25", 25), ("q50", 50), ("q75", 75), ("max", 100)):
            assert (r[name] is None) if not v else abs(r[name] - np.percentile(v, p)) < 2e-6
    if way == "narrowed":  # the last pass ranks no more than the limit at once
        assert passes[0] > 80 and passes[-1] <= 40
    assert describe.describe_overall(df.filter("x < 0"), ["x"]).count() == 0


def test_write_report_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("a40", 0.25, None)], "attribute string, v double, w double")
    path = str(tmp_path / "rep")
    sinks.write_report(df, path)
    back = spark.read.schema(df.schema).option("header", True).csv(path).first()
    assert back["attribute"] == "a40" and back["v"] == 0.25 and back["w"] is None


def test_checked_scan_sets_broken_rows_aside(spark, tmp_path):
    """Files with a header of their own: short and long rows, numbers that are
    none, unknown codes, nulls; and a file of nothing but the header."""
    from equiloan.sources import applications as src

    path = tmp_path / "raw.csv"
    path.write_text("application_id,income,loan_type,denial_reason-1\n1,10.5,1,3.0\n2,20\n3,30,1,2,5\n4,Exempt,7,NA\n5,NA,NA,NA\n")
    checked = src.read_applications_checked(spark, str(path), {"loan_type": ["1", "2"]})
    got = {r["application_id"]: r for r in checked.collect()}
    assert {k: r["problems"] for k, r in got.items()} == {
        1: [], 2: ["malformed"], 3: ["malformed"], 4: ["unparsed:income", "unknown:loan_type"], 5: []}
    assert got[2]["raw_record"] == "2,20" and got[2]["income"] == 20.0 and got[1]["raw_record"] is None
    assert got[1]["denial_reason_1"] == "3" and got[5]["income"] is None and got[1]["total_units"] is None
    assert {r[0]: r[1] for r in src.scan_problems(checked).collect()} == {
        "accepted": 2, "malformed": 2, "unparsed:income": 1, "unknown:loan_type": 1}
    clean = src.accepted(checked)
    assert clean.columns == [f.name for f in src.APPLICATION_SCHEMA.fields] and clean.count() == 2
    (tmp_path / "empty.csv").write_text("application_id,income\n")
    assert src.read_applications_checked(spark, str(tmp_path / "empty.csv")).count() == 0
