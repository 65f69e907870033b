"""Spark session settings and the shared working folder.

Everything here is plain Spark configuration.  The settings that matter at
scale are adaptive execution (runtime re-planning of joins and partition
counts), skew-join splitting, and a UTC session clock so that DATE(ts) and
day windows mean the same on every executor.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings applied to every session this package creates.  Values a caller
# already set (for example on a cluster through spark-defaults) win.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "envmon",
                shuffle_partitions: int | None = None,
                conf: dict | None = None) -> SparkSession:
    """Create or reuse a session with the package defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k, v in settings.items():
        try:
            if spark.conf.get(k, None) is None:
                spark.conf.set(k, v)
        except Exception:  # static settings of an existing session
            pass
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder every executor can reach: below ``spark.checkpoint.dir``.

    On a cluster that setting names the shared file system folder and is
    read as it is.  Only when it is unset on a local master a folder of our own
    is chosen and registered; on a cluster a machine-local folder would lose
    rows, so that is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session has no local context: the conf decides
        sc = None
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and sc is not None:
        base = sc.getCheckpointDir()
    if not base:
        if sc is None or not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), f"envmon-ckpt-{uuid.uuid4().hex[:8]}")
        spark.conf.set("spark.checkpoint.dir", base)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return "/".join([base.rstrip("/"), *parts]) if parts else base


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path below the shared folder."""
    return shared_dir(spark, "work", f"{name}-{uuid.uuid4().hex[:12]}")
