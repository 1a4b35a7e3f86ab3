"""Session helpers: a configured local session for tests and the bench, and
the shared folder used to cut lineage or hand tables between jobs."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "equiloan") -> SparkSession:
    """Local session for tests and the bench. On a cluster use the session
    the platform gives you; nothing in the library depends on these values."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    shuffle_partitions = shuffle_partitions or cpus
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("EQUILOAN_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    The folder the cluster names (``spark.checkpoint.dir``, or one already set
    on the context) is used as it is. Only where none is set and the master is
    local (tests, the bench) is a fresh local folder created and set; on a
    cluster a folder of one machine would be lost to the others, so there the
    setting is required.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="equiloan-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh location under the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    app = spark.sparkContext.applicationId
    if app not in _HANDED_OUT:
        atexit.register(release, spark)
    _HANDED_OUT.setdefault(app, []).append(path)
    return path


_HANDED_OUT: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables this application has written to the
    shared folder (their DataFrames cannot be read afterwards); returns how
    many were there. Also runs when the interpreter ends with a live session."""
    try:
        paths = _HANDED_OUT.pop(spark.sparkContext.applicationId, [])
        hadoop = spark._jsc.hadoopConfiguration()
        jvm, gone = spark._jvm, 0
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            gone += bool(path.getFileSystem(hadoop).delete(path, True))
        return gone
    except Exception:  # noqa: BLE001 - the session is gone already; its folder is the platform's to clean
        return 0


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that nothing reads any
    more; without this it stays until the session ends."""
    spark = table.sparkSession
    folders = {part for f in table.inputFiles()[:1] for part in f.split("/")}
    paths = _HANDED_OUT.get(spark.sparkContext.applicationId, [])
    for p in [p for p in paths if p.rsplit("/", 1)[-1] in folders]:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        paths.remove(p)


_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_RELEASING: dict[str, list] = {}
_RELEASING_LOCK = threading.Lock()


@contextmanager
def shuffles_released(spark: SparkSession):
    """Within it, Spark deletes the shuffle files of a query when the query
    ends. Else they stay until the driver happens to collect its garbage,
    which it may not do while it only waits for the next large step. Threads
    may use it at once; the setting is put back when the last one leaves."""
    app = spark.sparkContext.applicationId
    with _RELEASING_LOCK:
        state = _RELEASING.setdefault(app, [0, None])
        if not state[0]:
            state[1] = spark.conf.get(_FILE_CLEANUP, None)
            spark.conf.set(_FILE_CLEANUP, "true")
        state[0] += 1
    try:
        yield
    finally:
        with _RELEASING_LOCK:
            state[0] -= 1
            if not state[0]:
                if state[1] is None:
                    spark.conf.unset(_FILE_CLEANUP)
                else:
                    spark.conf.set(_FILE_CLEANUP, state[1])


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the executors once per application, so that
    their Python workers can import it wherever the driver found it."""
    sc = spark.sparkContext
    with _SHIPPING:  # two steps that run at once may both come first
        if sc.applicationId in _SHIPPED:
            return
        root = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="equiloan-package-")  # the driver serves it while the application runs
        atexit.register(shutil.rmtree, folder, True)
        archive = os.path.join(folder, "equiloan_package.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for base, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(base, name)
                        z.write(full, os.path.join("equiloan", os.path.relpath(full, root)))
        sc.addPyFile(archive)
        _SHIPPED.add(sc.applicationId)


_SHIPPING = threading.Lock()
_SHIPPED: set[str] = set()


def table_version(spark: SparkSession, path: str) -> tuple:
    """(path, length, time of change) of a table's files: tells whether an
    input has changed."""
    hadoop = spark._jsc.hadoopConfiguration()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(hadoop)
    status = fs.getFileStatus(p)
    files = list(fs.listStatus(p)) if status.isDirectory() else [status]
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Settings sized for a cluster run over ``input_bytes`` of Parquet.

    Shuffle partitions start at about one per ``target_partition_bytes`` of
    input (and at least 2 waves of the cluster's cores); AQE then coalesces
    small ones and splits skewed ones, so a partition fits executor memory
    without spilling at any scale factor. Scan splits follow the same size.
    Apply with ``SparkSession.builder.config(map=...)`` or ``spark.conf.set``.
    """
    partitions = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        # Broadcasts are decided by measured sizes (AQE runtime statistics)
        # and by the library's own row-count checks, never by guesses.
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }
