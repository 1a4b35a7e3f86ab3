"""The streaming monitor folds files into contingency state; its final metrics
equal the batch computation over the same rows."""

from equiloan.constants import ATTRIBUTES
from equiloan.operators import parity
from equiloan.plans import views
from equiloan.streaming import run_monitor

from conftest import SF_SMALL


def test_stream_equals_batch(spark, tmp_path):
    apps = views.applications(spark, SF_SMALL)
    src = str(tmp_path / "src")
    apps.repartition(5).write.parquet(src)   # five files -> several micro-batches
    schema = spark.read.parquet(src).schema
    out = run_monitor(spark, src, schema, str(tmp_path / "metrics"), str(tmp_path / "ckpt"), files_per_trigger=2)
    streamed = {r["attribute"]: r.asDict() for r in spark.read.parquet(out).collect()}
    batch = {r["attribute"]: r.asDict() for r in
             parity.parity_metrics(parity.contingency(views.prepare(apps), ATTRIBUTES)).collect()}
    assert streamed == batch


def test_stream_restarts_from_checkpoint(spark, tmp_path):
    apps = views.applications(spark, SF_SMALL)
    src = tmp_path / "src"
    first, second = apps.randomSplit([0.5, 0.5], seed=1)
    first.write.parquet(str(src / "a"))
    schema = spark.read.parquet(str(src / "a")).schema
    metrics, ckpt = str(tmp_path / "metrics"), str(tmp_path / "ckpt")
    run_monitor(spark, str(src / "*"), schema, metrics, ckpt)
    second.write.parquet(str(src / "b"))
    out = run_monitor(spark, str(src / "*"), schema, metrics, ckpt)   # resumes: only new files are read
    got = {r["attribute"]: r["n_unprivileged"] + r["n_privileged"] for r in spark.read.parquet(out).collect()}
    n = views.prepare(apps).count()
    assert set(got.values()) == {n}
