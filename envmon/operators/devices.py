"""Device statistics (A2, A2p, A16), latest status (W1), maintenance due.

Logs and maintenance records are aggregated per device separately and then
joined one row to one row.  The source joins both to the device at once,
which multiplies the two counts (kept as the ``_parity`` operator, computed
from the separate aggregates instead of materialising the product).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import as_date, count_if
from ._plan import device_dim, ordered

Tables = Mapping[str, DataFrame]

# --- fixed values: maintenance reminder -------------------------------------
MAINTENANCE_DUE_DAYS = 30
# reminder text: <device name> + PREFIX + <days> + SUFFIX; NEVER for no maintenance at all
REMINDER_PREFIX = " 设备已超过 "
REMINDER_SUFFIX = " 天未维护，需要进行巡检"
NEVER_MAINTAINED = " 设备从未维护，需要进行巡检"


def _log_counts(tables: Tables) -> DataFrame:
    return tables["device_status_logs"].groupBy("device_id").agg(
        count_if(F.col("run_status") == "FAULT").alias("faults"),
        F.count(F.lit(1)).alias("logs"),
        F.max("collected_at").alias("last_status_update"))


def _maint_counts(tables: Tables) -> DataFrame:
    return tables["maintenance_records"].groupBy("device_id").agg(
        F.count("maintenance_id").alias("maint"),
        F.max("maintenance_time").alias("last_maintenance"))


def _devices_with_region(tables: Tables) -> DataFrame:
    return device_dim(tables, "inner")


def device_fault_maintenance(tables: Tables, sort: bool = True) -> DataFrame:
    """Devices with faults: exact fault count, maintenance count, last maintenance."""
    d = _devices_with_region(tables)
    out = (d.join(_log_counts(tables), "device_id", "left").join(_maint_counts(tables), "device_id", "left")
             .filter(F.col("faults") > 0))
    out = out.select("region_name", "device_id", "device_name",
                     F.col("faults").cast("bigint").alias("fault_times"),
                     F.coalesce("maint", F.lit(0)).cast("bigint").alias("maintenance_count"),
                     "last_maintenance")
    return ordered(out, F.desc("fault_times"), F.desc("last_maintenance"), "device_id", sort=sort)


def device_fault_maintenance_parity(tables: Tables, sort: bool = True) -> DataFrame:
    """The source's numbers: faults x max(maintenance, 1) and maintenance x max(logs, 1).

    Equal to joining every log with every maintenance record of a device,
    computed from the two per-device aggregates.
    """
    d = _devices_with_region(tables)
    out = (d.join(_log_counts(tables), "device_id", "left").join(_maint_counts(tables), "device_id", "left")
             .filter(F.col("faults") > 0))
    m = F.coalesce(F.col("maint"), F.lit(0))
    n = F.coalesce(F.col("logs"), F.lit(0))
    out = out.select("region_name", "device_id", "device_name", "device_type",
                     (F.col("faults") * F.greatest(m, F.lit(1))).cast("bigint").alias("fault_count"),
                     (m * F.greatest(n, F.lit(1))).cast("bigint").alias("maintenance_count"),
                     F.col("last_maintenance").alias("last_maintenance_time"), "last_status_update")
    return ordered(out, F.desc("fault_count"), "region_name", "device_name", sort=sort)


def device_faults(tables: Tables) -> DataFrame:
    """Per device: FAULT or OFFLINE logs, first and last time (region optional)."""
    f = tables["device_status_logs"].filter(F.col("run_status").isin("FAULT", "OFFLINE")).groupBy(
        "device_id").agg(F.count(F.lit(1)).alias("fault_count"), F.min("collected_at").alias("first_fault_at"),
                         F.max("collected_at").alias("last_fault_at"))
    out = f.join(device_dim(tables, "left"), "device_id")
    return out.select("region_name", "device_id", "device_name", "device_type",
                      F.col("fault_count").cast("bigint").alias("fault_count"), "first_fault_at",
                      "last_fault_at")


def latest_device_status(tables: Tables) -> DataFrame:
    """Newest status log of every device (ties broken by the larger log_id).

    An aggregate (max of a struct led by the time), not a window: partial
    aggregation keeps one row per device and map task, whatever the skew.
    """
    logs = tables["device_status_logs"]
    latest = logs.groupBy("device_id").agg(
        F.max(F.struct("collected_at", "log_id", "run_status", "battery_percent", "signal_strength"))
         .alias("s"))
    out = latest.join(device_dim(tables, "left"), "device_id")
    return out.select("region_name", "device_id", "device_name", "device_type", "s.run_status",
                      "s.battery_percent", "s.signal_strength",
                      F.col("s.collected_at").alias("last_status_update"))


def maintenance_due(tables: Tables, as_of=None, days: int = MAINTENANCE_DUE_DAYS) -> DataFrame:
    """Every device never maintained or last maintained more than ``days`` calendar days ago.

    Returns the proposed INSPECTION record of each (result PENDING) with the
    device details and the days since the last maintenance.
    """
    ref = as_date(as_of)
    d = device_dim(tables, "left")
    last = tables["maintenance_records"].groupBy("device_id").agg(
        F.max("maintenance_time").alias("last_maintenance_time"))
    j = d.join(last, "device_id", "left")
    since_days = F.datediff(ref, F.to_date("last_maintenance_time")).cast("bigint")
    return reminders(j.filter(F.col("last_maintenance_time").isNull() | (since_days > days)), ref)


def reminders(j: DataFrame, ref) -> DataFrame:
    """The proposed records at date ``ref`` for devices (device_dim columns) with their last_maintenance_time."""
    since_days = F.datediff(ref, F.to_date("last_maintenance_time")).cast("bigint")
    j = j.withColumn("days_since_last_maintenance", since_days)
    name = F.coalesce(F.col("device_name"), F.lit(""))
    text = F.when(F.col("last_maintenance_time").isNull(), F.concat(name, F.lit(NEVER_MAINTAINED))) \
            .otherwise(F.concat(name, F.lit(REMINDER_PREFIX),
                                F.col("days_since_last_maintenance").cast("string"), F.lit(REMINDER_SUFFIX)))
    return j.select("device_id", "device_name", "device_type", "region_name", "last_maintenance_time",
                    "days_since_last_maintenance", F.lit("INSPECTION").alias("maintenance_type"),
                    ref.cast("timestamp_ntz").alias("maintenance_time"), text.alias("content"),
                    F.lit("PENDING").alias("result"))
