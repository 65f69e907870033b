"""Enrichment joins (J1-J6, J8): facts with the names of their dimensions.

Dimensions go through ``small`` (broadcast only under the size limit); a
fact row is never multiplied, because every dimension join is on its key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import text_equals
from ._plan import device_dim, ordered

Tables = Mapping[str, DataFrame]


def _user_names(tables: Tables, id_col: str, name_col: str) -> DataFrame:
    u = tables["users"].select(F.col("user_id").alias(id_col), F.col("real_name").alias(name_col))
    return u


def region_sensors(tables: Tables) -> DataFrame:
    """Every region with its sensors; regions without sensors kept once with NULLs.

    Written as sensors joined to their region (the big side streamed, regions
    broadcast) plus the regions that have no sensor, instead of a left join
    from regions: there a region holding most sensors would be one buffered
    join group that adaptive execution cannot split.
    """
    cols = ["region_id", "region_name", "region_type", "sensor_id", "model", "monitor_type",
            "install_time", "sensor_status"]
    r = tables["regions"].select("region_id", "region_name", "region_type")
    s = tables["sensors"].select("region_id", "sensor_id", "model", "monitor_type", "install_time",
                                 F.col("status").alias("sensor_status"))
    with_sensors = s.join(r, "region_id").select(*cols)
    used = s.select("region_id").dropDuplicates()
    empty = r.join(used, "region_id", "left_anti").select(
        "region_id", "region_name", "region_type", F.lit(None).cast("bigint").alias("sensor_id"),
        F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("monitor_type"),
        F.lit(None).cast("timestamp_ntz").alias("install_time"),
        F.lit(None).cast("string").alias("sensor_status"))
    return with_sensors.unionByName(empty)


def sensors_by_region_name(tables: Tables, region_name: str, collation: str | None = None, sort: bool = True) -> DataFrame:
    """All sensor columns of the sensors in the region of that name (``collation``: e.g. CI_AI)."""
    r = tables["regions"].filter(text_equals("region_name", region_name, collation)).select(
        "region_id", "region_name")
    return ordered(tables["sensors"].join(r, "region_id"), "sensor_id", sort=sort)


def active_alerts(tables: Tables) -> DataFrame:
    """Alerts PENDING or PROCESSING with region, rule type and severity, handler name."""
    a = tables["alerts"].filter(F.col("status").isin("PENDING", "PROCESSING"))
    r = tables["regions"].select("region_id", "region_name")
    ru = tables["alert_rules"].select("rule_id", "alert_type", "severity_level")
    out = (a.join(r, "region_id").join(ru, "rule_id")
            .join(_user_names(tables, "handler_id", "handler_name"), "handler_id", "left"))
    return out.select("alert_id", "region_name", "alert_type", "severity_level", "triggered_at",
                      "content", "status", "handler_name")


def resource_change_log(tables: Tables, sort: bool = True) -> DataFrame:
    """Changes with resource, region and operator name, newest first per resource."""
    c = tables["resource_changes"]
    base = tables["resources"].select("resource_id", "region_id", "resource_type", "species_name")
    r = tables["regions"].select("region_id", "region_name")
    res = base.join(r, "region_id")
    out = (c.join(res, "resource_id")
            .join(_user_names(tables, "operator_id", "operator_name"), "operator_id", "left"))
    out = out.select("change_id", "resource_id", "region_name", "resource_type", "species_name",
                     "change_type", "change_reason", "change_amount", "change_area", "changed_at",
                     "operator_name")
    return ordered(out, "resource_id", F.desc("changed_at"), F.desc("change_id"), sort=sort)


def maintenance_log(tables: Tables, sort: bool = True) -> DataFrame:
    """Maintenance with device, region and maintainer name, newest first."""
    m = tables["maintenance_records"]
    d = device_dim(tables, "left")
    out = (m.join(d, "device_id")
            .join(_user_names(tables, "maintainer_id", "maintainer_name"), "maintainer_id", "left"))
    out = out.select("maintenance_id", "device_id", "device_name", "device_type", "region_name",
                     "maintenance_type", "maintenance_time", "maintainer_name", "content", "result")
    return ordered(out, F.desc("maintenance_time"), F.desc("maintenance_id"), sort=sort)


def alert_notifications_detail(tables: Tables, alert_ids: DataFrame | None = None, sort: bool = True) -> DataFrame:
    """Notifications with the alert text and the receiver name (NULL -> empty text)."""
    n = tables["notifications"]
    if alert_ids is not None:
        n = n.join(alert_ids.select("alert_id").dropDuplicates(), "alert_id", "left_semi")
    a = tables["alerts"].select("alert_id", F.col("content").alias("alert_content"))
    u = _user_names(tables, "receiver_id", "receiver_name")
    out = n.join(a, "alert_id").join(u, "receiver_id")
    out = out.select("notification_id", "alert_id", "receiver_id", "channel", "sent_at", "receive_status",
                     F.coalesce("alert_content", F.lit("")).alias("alert_content"),
                     F.coalesce("receiver_name", F.lit("")).alias("receiver_name"))
    return ordered(out, "alert_id", F.desc("sent_at"), F.desc("notification_id"), sort=sort)


def device_timeline(tables: Tables, device_ids: DataFrame | None = None, sort: bool = True) -> DataFrame:
    """Status changes and maintenance of each device as one time line, newest first.

    One row per event (a union of two event shapes) rather than the
    every-log-with-every-maintenance join of the source query, which grows
    with the product of both counts per device.
    """
    d = tables["devices"].select("device_id", "device_name")
    if device_ids is not None:
        d = d.join(device_ids.select("device_id").dropDuplicates(), "device_id", "left_semi")
    logs = tables["device_status_logs"].select(
        "device_id", F.col("collected_at").alias("event_time"), F.lit("STATUS").alias("event_kind"),
        "run_status", "battery_percent", "signal_strength",
        F.lit(None).cast("bigint").alias("maintenance_id"), F.lit(None).cast("string").alias("maintenance_type"),
        F.lit(None).cast("string").alias("maintainer_name"), F.lit(None).cast("string").alias("content"),
        F.lit(None).cast("string").alias("result"))
    named = tables["maintenance_records"].join(_user_names(tables, "maintainer_id", "maintainer_name"), "maintainer_id", "left")
    m = named.select(
        "device_id", F.col("maintenance_time").alias("event_time"), F.lit("MAINTENANCE").alias("event_kind"),
        F.lit(None).cast("string").alias("run_status"), F.lit(None).cast("int").alias("battery_percent"),
        F.lit(None).cast("int").alias("signal_strength"), "maintenance_id", "maintenance_type",
        "maintainer_name", "content", "result")
    out = logs.unionByName(m).join(d, "device_id").select("device_id", "device_name", "event_time", "event_kind", "run_status",
                     "battery_percent", "signal_strength", "maintenance_id", "maintenance_type",
                     "maintainer_name", "content", "result")
    return ordered(out, "device_id", F.desc("event_time"), "event_kind", sort=sort)
