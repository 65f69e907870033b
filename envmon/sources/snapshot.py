"""Full copies of all tables, restore, and the copies past retention.

A snapshot is one folder ``snapshot_ts=YYYYMMDD_HHMMSS`` below a base path
with one parquet folder per table; writing is done by executors, the
folder listing (names only) by the driver through the Hadoop file system.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from .tables import hadoop_path, load_tables, save_tables

RETENTION_DAYS = 7
_FMT = "%Y%m%d_%H%M%S"


def snapshot(tables: Mapping[str, DataFrame], base: str, at: _dt.datetime | None = None) -> str:
    """Write every table (of an opened store: every stored one) to a new time-stamped folder; returns its path."""
    at = at or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    path = f"{base.rstrip('/')}/snapshot_ts={at.strftime(_FMT)}"
    save_tables(tables, path, mode="errorifexists")
    return path


def restore(spark: SparkSession, path: str):
    """Tables of one snapshot (read lazily)."""
    return load_tables(spark, path)


def list_snapshots(spark: SparkSession, base: str) -> list[tuple[str, _dt.datetime]]:
    fs, p = hadoop_path(spark, base)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("snapshot_ts="):
            try:
                out.append((st.getPath().toString(), _dt.datetime.strptime(name.split("=", 1)[1], _FMT)))
            except ValueError:
                continue
    return sorted(out, key=lambda x: x[1])


def expired_snapshots(spark: SparkSession, base: str, now: _dt.datetime | None = None,
                      days: int = RETENTION_DAYS) -> list[str]:
    """Snapshot folders older than the retention."""
    now = now or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    return [p for p, ts in list_snapshots(spark, base) if ts < now - _dt.timedelta(days=days)]


def remove_expired(spark: SparkSession, base: str, now: _dt.datetime | None = None,
                   days: int = RETENTION_DAYS) -> list[str]:
    """Delete the snapshot folders older than the retention; returns what was deleted."""
    gone = expired_snapshots(spark, base, now, days)
    for path in gone:
        fs, p = hadoop_path(spark, path)
        fs.delete(p, True)
    return gone
