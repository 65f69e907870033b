"""Alerts that have a reading of a given status within +-5 minutes.

A plain range condition between two large tables plans as a nested loop
(every alert against every reading).  Here it is an equi-join on minute
buckets, and the reading side is first reduced to one row per minute
(and region, for J7b) holding the first and last reading time:

* a window [t - 5 min, t + 5 min] is 600 s wide, so its two ends always
  fall into different minute buckets (11 buckets in all);
* every reading of an inner bucket lies inside the window;
* a reading of the first bucket qualifies iff it is >= t - 5 min, which
  holds for some reading iff that bucket's *last* time does; symmetric for
  the last bucket with its *first* time.

So "bucket.max_ts >= lo AND bucket.min_ts <= hi" over the 11 buckets is
exactly "some reading in [lo, hi]", inclusive at both ends.  The reading
summary is built with partial aggregation (a minute holding a third of all
readings is combined map-side), is unique per join key, and its size is
bounded by the number of minutes covered, not by the number of readings.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import apply_filters
from ..functions.domain import UNKNOWN_ALERT_TYPE, UNKNOWN_SEVERITY
from ._plan import ordered, rollup_through, sensor_dim

Tables = Mapping[str, DataFrame]
HALF_WINDOW_MINUTES = 5


def _half_window() -> Column:
    return F.expr(f"INTERVAL {HALF_WINDOW_MINUTES} MINUTES")


def minute_index(ts: Column) -> Column:
    """Minutes since 1970-01-01 00:00 from the fields of a (zone-less) timestamp."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 1440 + F.hour(ts).cast("bigint") * 60 + F.minute(ts).cast("bigint")


def reading_minutes(tables: Tables, status: str, by_region: bool) -> DataFrame:
    """(minute[, region_id], min_ts, max_ts) over readings with ``status``."""
    r = tables["sensor_readings"].filter(F.col("data_status") == status)
    if not by_region:
        return r.groupBy(minute_index(F.col("collected_at")).alias("minute")).agg(
            F.min("collected_at").alias("min_ts"), F.max("collected_at").alias("max_ts"))
    return rollup_through(
        r, "sensor_id", sensor_dim(tables), [minute_index(F.col("collected_at")).alias("minute")],
        ["region_id"], [("min_ts", "min", F.col("collected_at")), ("max_ts", "max", F.col("collected_at"))])


def alerts_near_readings(alerts: DataFrame, tables: Tables, status: str,
                         same_region: bool = False) -> DataFrame:
    """``alerts`` rows with a reading of ``status`` in [t - 5 min, t + 5 min]."""
    summary = reading_minutes(tables, status, same_region)
    keys = ["alert_id"] + (["region_id"] if same_region else [])
    a = alerts.select(*keys, (F.col("triggered_at") - _half_window()).alias("lo"),
                      (F.col("triggered_at") + _half_window()).alias("hi"))
    a = a.withColumn("minute", F.explode(F.sequence(minute_index(F.col("lo")), minute_index(F.col("hi")))))
    on = ["minute"] + (["region_id"] if same_region else [])
    s = summary
    cond = [a[k] == s[k] for k in on] + [s["max_ts"] >= a["lo"], s["min_ts"] <= a["hi"]]
    matched = a.join(s, cond, "left_semi").select("alert_id").dropDuplicates()
    return alerts.join(matched, "alert_id", "left_semi")


def list_alerts(tables: Tables, alerts: DataFrame | None = None, region_id=None, status=None,
                validity: str | None = None, same_region: bool = False, sort: bool = True) -> DataFrame:
    """Alerts with rule type and severity (unknown rule -> fixed labels), newest first.

    ``validity`` keeps alerts that have a reading of that status nearby (from
    any region as the source does, or from the alert's region with
    ``same_region``).  Without it readings cannot change the result and are
    not read at all.
    """
    a = alerts if alerts is not None else tables["alerts"]
    a = apply_filters(a, {"region_id": region_id, "status": status})
    if validity is not None:
        a = alerts_near_readings(a, tables, validity, same_region)
    rules = tables["alert_rules"].select("rule_id", "alert_type", "severity_level")
    out = a.join(rules, "rule_id", "left").select(
        "alert_id", "rule_id", "region_id", "triggered_at", "content", "status", "handler_id",
        "handle_result", F.coalesce("alert_type", F.lit(UNKNOWN_ALERT_TYPE)).alias("alert_type"),
        F.coalesce("severity_level", F.lit(UNKNOWN_SEVERITY)).alias("severity_level"))
    return ordered(out, F.desc("triggered_at"), F.desc("alert_id"), sort=sort)
