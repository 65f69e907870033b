"""List, lookup and range operators.

Every list call of the source is optional equality filters joined with AND
and an ORDER BY; here that is ``apply_filters`` + ``orderBy``.  The filters
reach the parquet scan as pushed predicates.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import apply_filters, contains_ci, with_day_pruning, text_keys
from ._plan import ordered

Tables = Mapping[str, DataFrame]


def list_regions(tables: Tables, region_type: str | None = None,
                 name_contains: str | None = None, sort: bool = True) -> DataFrame:
    r = apply_filters(tables["regions"], {"region_type": region_type})
    return ordered(r.filter(contains_ci("region_name", name_contains)), "region_name", "region_id", sort=sort)


def list_sensors(tables: Tables, region_id=None, monitor_type=None, status=None, sort: bool = True) -> DataFrame:
    s = apply_filters(tables["sensors"],
                      {"region_id": region_id, "monitor_type": monitor_type, "status": status})
    return ordered(s, "sensor_id", sort=sort)


def list_alert_rules(tables: Tables, alert_type=None, is_active=None, severity_level=None,
                     in_use: bool = False, sort: bool = True) -> DataFrame:
    """Rules by type, active flag, severity; ``in_use`` keeps rules some alert refers to."""
    r = apply_filters(tables["alert_rules"], {"alert_type": alert_type, "is_active": is_active,
                                              "severity_level": severity_level})
    if in_use:
        r = r.join(tables["alerts"].select("rule_id").dropDuplicates(), "rule_id", "left_semi")
    return ordered(r, "rule_id", sort=sort)


def list_resources(tables: Tables, region_id=None, resource_type=None, growth_stage=None,
                   species_contains: str | None = None, sort: bool = True) -> DataFrame:
    r = apply_filters(tables["resources"], {"region_id": region_id, "resource_type": resource_type,
                                            "growth_stage": growth_stage})
    return ordered(r.filter(contains_ci("species_name", species_contains)), "resource_id", sort=sort)


def list_devices(tables: Tables, device_type=None, region_id=None, sort: bool = True) -> DataFrame:
    d = apply_filters(tables["devices"], {"device_type": device_type, "install_region_id": region_id})
    return ordered(d, "device_id", sort=sort)


def list_report_templates(tables: Tables, dimension=None, is_active=None, sort: bool = True) -> DataFrame:
    t = apply_filters(tables["report_templates"], {"dimension": dimension, "is_active": is_active})
    return ordered(t, "template_id", sort=sort)


def list_reports(tables: Tables, template_id=None, cycle: str | None = None, sort: bool = True) -> DataFrame:
    """Reports of a template and/or of templates with a cycle (DAY/WEEK/MONTH), newest first."""
    r = apply_filters(tables["reports"], {"template_id": template_id})
    if cycle is not None:
        t = tables["report_templates"].filter(F.col("cycle") == cycle).select("template_id")
        r = r.join(t, "template_id", "left_semi")
    return ordered(r, F.desc("generated_at"), F.desc("report_id"), sort=sort)


def list_roles(tables: Tables, in_use: bool = False, sort: bool = True) -> DataFrame:
    """All roles by id; ``in_use`` keeps roles held by at least one user."""
    r = tables["roles"]
    if in_use:
        r = r.join(tables["user_roles"].select("role_id").dropDuplicates(), "role_id", "left_semi")
    return ordered(r, "role_id", sort=sort)


def lookup_keys(df: DataFrame, keys: DataFrame, key: str, collation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` is in ``keys`` and the requested keys that match nothing.

    Both are joins, not a loop of single-row reads: ``left_semi`` for the
    found rows, ``left_anti`` for the missing keys.  The key set is
    de-duplicated first so that a repeated request key cannot multiply rows.  With a
    ``collation`` (e.g. ``CI_AI``) text keys are equal as it says, case and accents aside; of requested keys that
    are equal under it the smallest stands for all.
    """
    if collation is None:
        k = keys.select(key).dropDuplicates()
        return df.join(k, key, "left_semi"), k.join(df.select(key), key, "left_anti")
    k = keys.select(text_keys(keys, [key], collation)[key].alias("__key"), key).groupBy("__key").agg(F.min(key).alias(key))
    held = df.withColumn("__key", text_keys(df, [key], collation)[key])
    return (held.join(k.select("__key"), "__key", "left_semi").drop("__key").select(*df.columns),
            k.join(held.select("__key"), "__key", "left_anti").select(key))


def readings_in_range(tables: Tables, start, end, sensor_ids: Iterable | DataFrame | None = None
                      , sort: bool = True) -> DataFrame:
    """Readings with collected_at BETWEEN start AND end (both ends inclusive), oldest first."""
    r = tables["sensor_readings"].filter(
        F.col("collected_at").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    r = with_day_pruning(r, "collected_at", lo=start, hi=end)
    r = _restrict(r, "sensor_id", sensor_ids)
    return ordered(r, "collected_at", "reading_id", sort=sort)


def status_logs_in_range(tables: Tables, start, end, device_ids=None, sort: bool = True) -> DataFrame:
    logs = tables["device_status_logs"].filter(
        F.col("collected_at").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    logs = _restrict(logs, "device_id", device_ids)
    out = logs.select("log_id", "device_id", "collected_at", "run_status", "battery_percent", "signal_strength")
    return ordered(out, "collected_at", "log_id", sort=sort)


def status_logs_of_device(tables: Tables, device_ids=None, sort: bool = True) -> DataFrame:
    """Status logs of the given devices, newest first per device."""
    logs = _restrict(tables["device_status_logs"], "device_id", device_ids)
    out = logs.select("log_id", "device_id", "collected_at", "run_status", "battery_percent", "signal_strength")
    return ordered(out, "device_id", F.desc("collected_at"), F.desc("log_id"), sort=sort)


def _restrict(df: DataFrame, key: str, ids) -> DataFrame:
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key).dropDuplicates(), key, "left_semi")
    return df.filter(F.col(key).isin(list(ids)))
