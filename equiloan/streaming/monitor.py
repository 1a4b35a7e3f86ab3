"""Incremental parity monitoring with Structured Streaming.

Application files arriving in a folder are read as a stream (declared
schema, ``maxFilesPerTrigger`` bounds each micro-batch the way the chunked
reads bounded memory), prepared by the same operators as the batch path, and
folded into the contingency table as streaming state. Each micro-batch
rewrites the metrics table from the complete contingency (at most 48 rows per
attribute set), so the metrics always cover every file seen so far. The
checkpoint location makes the query restartable after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from equiloan.constants import ATTRIBUTES
from equiloan.operators import parity


def contingency_stream(spark: SparkSession, source_dir: str, schema: T.StructType, fmt: str = "parquet",
                       files_per_trigger: int = 1, attributes=ATTRIBUTES,
                       decision: str = "rule_decision") -> DataFrame:
    """Streaming contingency (G6) over application files in ``source_dir``."""
    from equiloan.plans.views import prepare

    apps = (spark.readStream.schema(schema).format(fmt)
            .option("maxFilesPerTrigger", files_per_trigger).load(source_dir))
    return parity.contingency(prepare(apps), attributes, decision=decision)


def run_monitor(spark: SparkSession, source_dir: str, schema: T.StructType, metrics_path: str,
                checkpoint_path: str, fmt: str = "parquet", files_per_trigger: int = 1) -> str:
    """Process every file available now, keeping ``metrics_path`` up to date
    after each micro-batch; returns the folder of the last batch's metrics.

    Every micro-batch writes a folder of its own (``batch=<id>``, overwritten
    only by a retry of the same batch), so a reader always finds the complete
    metrics of the batch before while the next one is written."""
    ct = contingency_stream(spark, source_dir, schema, fmt, files_per_trigger)

    def write_metrics(batch: DataFrame, epoch_id: int) -> None:
        parity.parity_metrics(batch).write.mode("overwrite").parquet(f"{metrics_path}/batch={epoch_id}")

    q = (ct.writeStream.outputMode("complete").foreachBatch(write_metrics)
         .option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_metrics(spark, metrics_path)


def latest_metrics(spark: SparkSession, metrics_path: str) -> str:
    """The folder of the last batch that was written completely."""
    path = spark._jvm.org.apache.hadoop.fs.Path(metrics_path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [f.getPath() for f in fs.listStatus(path)
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return max(done, key=lambda p: int(p.getName().split("=")[1])).toString()
