"""Session and checkpoint helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: With this setting Spark deletes an execution's shuffle files when it ends; else
#: they stay until the driver happens to collect its garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_storing = {"now": 0, "before": None}

#: Paths of stored intermediate tables, with the session that wrote them.
_kept: dict[str, weakref.ref] = {}
#: Names of those that are bucketed tables of the session's catalog.
_tables: dict[str, str] = {}


def local_session(cores: int = 8, shuffle_partitions: int | None = None,
                  app: str = "wideflow") -> SparkSession:
    """A local session tuned for tests and the bench (AQE on, UI off)."""
    parts = shuffle_partitions or cores
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.files.openCostInBytes", str(256 * 1024))
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be set by the deployment (a shared file
    system every executor can reach).  Only a local-mode session without the
    setting gets a private scratch folder, as in tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                f"{CHECKPOINT_CONF} is not set; iterative operators need a shared "
                "checkpoint folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="wideflow-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative computation: the table is written
    once as Parquet into the shared checkpoint folder and read back, so a
    lost executor costs at most the current step.  (``Dataset.checkpoint``
    would compute an unpersisted plan twice: once to count, once to save.)"""
    return materialize(df)


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers, unless it is installed
    for them (on PYTHONPATH) already."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_wideflow_shipped", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="wideflow-py-"), "wideflow"),
                                  "zip", root, "wideflow")
    sc.addPyFile(archive)
    sc._wideflow_shipped = True


def scratch_path(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder; what is written there is
    deleted when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/wideflow-tables/{uuid.uuid4().hex}"
    _kept[path] = weakref.ref(spark)
    return path


@contextmanager
def _own_shuffles_only(spark: SparkSession):
    """While a table is stored (by any thread), shuffle files go with the execution
    that made them: the stored table is all that is read again."""
    with _lock:
        if not _storing["now"]:
            _storing["before"] = spark.conf.get(CLEANUP_CONF, None)
            spark.conf.set(CLEANUP_CONF, "true")
        _storing["now"] += 1
    try:
        yield
    finally:
        with _lock:
            _storing["now"] -= 1
            if not _storing["now"] and spark.sparkContext._jsc is not None:
                if _storing["before"] is None:
                    spark.conf.unset(CLEANUP_CONF)
                else:
                    spark.conf.set(CLEANUP_CONF, _storing["before"])


def dealt_out(df: DataFrame) -> DataFrame:
    """The rows over all cores, or the session's number of shuffle partitions if that is more."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism,
                              int(spark.conf.get("spark.sql.shuffle.partitions"))))


def materialize(df: DataFrame, spread: bool = False, partition_by: tuple[str, ...] = (),
                **options: str) -> DataFrame:
    """Compute ``df`` once, store it as Parquet in the shared checkpoint
    folder and return a DataFrame that scans the stored copy.

    Used where an operator reads the same intermediate table in several
    branches (e.g. counts feeding both a confusion matrix and a running sum):
    without it every branch recomputes the whole upstream plan.  One job
    writes the table; later scans prune columns and give AQE exact sizes.
    The copy lives in ``spark.checkpoint.dir``, so it survives the loss of
    the executors that computed it.

    ``spread`` deals the rows out over all cores, or the session's number of
    shuffle partitions if that is more; use it before a fan-out (e.g. one copy
    per seed), so that this does not run in a handful of tasks.
    ``partition_by``: columns by whose values readers select whole folders.
    ``options`` go to the Parquet writer.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    if spread:
        df = dealt_out(df)
    with _own_shuffles_only(spark):
        df.write.mode("overwrite").options(**options).partitionBy(*partition_by).parquet(path)
    # the schema is given, as an empty partitioned table has no file to tell it
    out = (spark.read.schema(df.schema) if partition_by else spark.read).parquet(path)
    out.wideflow_path = path
    return out


def bucketed(df: DataFrame, keys: list[str], buckets: int, **options: str) -> DataFrame:
    """``df`` stored in the shared checkpoint folder as a table of ``buckets``
    buckets by ``keys``, one sorted file each: joins and aggregations of such
    tables by their keys need no shuffle.  ``options`` go to the Parquet writer."""
    spark = df.sparkSession
    path = scratch_path(spark)
    name = f"wideflow_{os.path.basename(path)}"
    with _own_shuffles_only(spark):
        (df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").options(**options)
         .bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name))
    out = spark.table(name)
    out.wideflow_path = path
    _tables[path] = name
    return out


def release(*frames: DataFrame) -> None:
    """Delete the stored copies behind frames that :func:`materialize` returned
    and that nothing reads any more."""
    for df in frames:
        path = getattr(df, "wideflow_path", None)
        if path in _kept:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    _kept.pop(path, None)
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def release_all() -> None:
    """Delete every stored copy that is left when the application ends."""
    for path, ref in list(_kept.items()):
        spark = ref()
        if spark is None or spark.sparkContext._jsc is None:
            continue
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return
