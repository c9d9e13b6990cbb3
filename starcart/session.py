"""Session helpers: sane defaults for analytics jobs and the checkpoint folder.

Nothing here changes a session that a cluster already configured: values are
only filled in where they are unset.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults applied only when the key is unset (a cluster's own settings win).
SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "starcart") -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


# Suggested settings for a large cluster (100 TB of line items): many shuffle
# partitions that AQE coalesces to the advisory size, skew splitting on, and
# input splits that keep a task's input near the advisory size.
CLUSTER_SUGGESTIONS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
}


def scale_configs(spark: SparkSession) -> dict[str, str]:
    """Apply ``CLUSTER_SUGGESTIONS`` for keys the cluster has not set; returns what was set."""
    applied = {}
    for key, value in CLUSTER_SUGGESTIONS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
            applied[key] = value
    return applied


def apply_defaults(spark: SparkSession) -> None:
    for key, value in SCALE_DEFAULTS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage.

    Read from the running context / ``spark.checkpoint.dir``. Only a local-mode
    session (tests, bench) may get a scratch folder of its own; a cluster
    without a configured shared folder is an error, never a machine-local path.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; configure a shared folder for this cluster"
        )
    folder = tempfile.mkdtemp(prefix="starcart-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str = "stage", compression: str | None = None) -> DataFrame:
    """Write ``df`` as parquet into the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing the
    plan) and lets several consumers share one computation. Columnar and
    compressed, so re-reads prune columns; cheaper than an RDD checkpoint of rows.
    """
    return df.sparkSession.read.parquet(write_stage(df, name, compression))


def write_stage(df: DataFrame, name: str = "stage", compression: str | None = None) -> str:
    """Write ``df`` as parquet into a fresh folder of the checkpoint folder; returns the path."""
    path = stage_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path, compression=compression)
    return path


def finished(spark: SparkSession, path: str) -> bool:
    """Has a write of this folder been committed?"""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


_STAGES: dict[str, list[str]] = {}


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the checkpoint folder; it is removed when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/starcart-{name}-{uuid.uuid4().hex[:12]}"
    application = spark.sparkContext.applicationId
    if application not in _STAGES:
        _STAGES[application] = []
        _remove_at_end(spark, _STAGES[application])
    _STAGES[application].append(path)
    return path


def _remove_at_end(spark: SparkSession, paths: list[str]) -> None:
    """Delete the stage folders when the context stops (or Python exits before that)."""
    sc = spark.sparkContext
    stop = sc.stop

    def remove() -> None:
        jvm, conf = sc._jvm, sc._jsc and sc._jsc.hadoopConfiguration()
        while paths and conf:
            path = jvm.org.apache.hadoop.fs.Path(paths.pop())
            path.getFileSystem(conf).delete(path, True)

    def stop_after_removal() -> None:
        with contextlib.suppress(Exception):  # a context that is already gone cannot clean up
            remove()
        sc.stop = stop
        stop()

    sc.stop = stop_after_removal
    atexit.register(lambda: sc._jsc and sc.stop())
