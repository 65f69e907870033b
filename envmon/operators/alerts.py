"""Alert statistics (A1, A9, A12, A13), set-based alert trigger (R2), rule texts.

Notifications are always aggregated per alert before they meet alerts, so
an alert with a huge number of notifications is combined map-side instead
of landing whole in one join task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import count_if, since, with_day_pruning
from ..functions.domain import triggered_alert_type
from ..functions.rules import RULE_VARIABLES, parsed_rules, variable_column
from ._plan import ordered, rollup_through, sensor_dim
from .rule_index import rows_with_rules

Tables = Mapping[str, DataFrame]


def notification_counts(tables: Tables) -> DataFrame:
    """Per alert_id: total, delivered and failed notifications.

    Joined to a few alerts, Spark's runtime filter passes their ids to this side's scan.
    """
    return tables["notifications"].groupBy("alert_id").agg(
        F.count("notification_id").alias("total_notifications"),
        count_if(F.col("receive_status") == "DELIVERED").alias("delivered_count"),
        count_if(F.col("receive_status") == "FAILED").alias("failed_count"))


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)


# -- A1 ----------------------------------------------------------------------
def region_alert_stats(tables: Tables, days: int = 30, as_of=None, sort: bool = True) -> DataFrame:
    """Per region (all regions): sensors, alerts of the last N days, their notifications."""
    regions = tables["regions"].select("region_id", "region_name")
    sensors = tables["sensors"].groupBy("region_id").agg(F.count("sensor_id").alias("sensors"))
    recent = tables["alerts"].filter(since("triggered_at", as_of, days)).select("alert_id", "region_id")
    # one row per alert meets one row per alert: a hot alert is combined before the join
    sent = tables["notifications"].groupBy("alert_id").agg(F.count(F.lit(1)).alias("sent"))
    alerts = recent.join(sent, "alert_id", "left").groupBy("region_id").agg(
        F.count("alert_id").alias("alerts"), F.sum("sent").alias("notifications_sent"))
    out = regions.join(sensors, "region_id", "left").join(alerts, "region_id", "left")
    out = out.select("region_name", _zero("sensors"), _zero("alerts"), _zero("notifications_sent"))
    return ordered(out, F.desc("alerts"), F.desc("notifications_sent"), "region_name", sort=sort)


# -- A9 ----------------------------------------------------------------------
def _fire_alerts(tables: Tables, days: int, region: str | None, as_of) -> DataFrame:
    rules = tables["alert_rules"].filter(F.col("alert_type") == "FIRE").select(
        "rule_id", "alert_type", "severity_level")
    regions = tables["regions"].select("region_id", "region_name")
    if region is not None:
        regions = regions.filter(F.col("region_name") == region)
    a = tables["alerts"].filter(since("triggered_at", as_of, days))
    return a.join(rules, "rule_id").join(regions, "region_id")


def fire_alerts(tables: Tables, days: int = 7, region: str | None = None, as_of=None, sort: bool = True) -> DataFrame:
    """FIRE alerts of the last N days (one region or all): notifications sent and delivered."""
    a = _fire_alerts(tables, days, region, as_of)
    out = a.join(notification_counts(tables), "alert_id", "left").select(
        "region_name", "alert_id", "triggered_at", "severity_level", "status", "handler_id",
        "handle_result", _zero("total_notifications").alias("notifications_sent"),
        _zero("delivered_count").alias("delivered_count"))
    return ordered(out, F.desc("triggered_at"), F.desc("alert_id"), sort=sort)


def fire_alerts_detail(tables: Tables, days: int = 7, region: str | None = None, as_of=None, sort: bool = True) -> DataFrame:
    """The analyst form: adds rule type and the handler's name; notification count."""
    a = _fire_alerts(tables, days, region, as_of)
    users = tables["users"].select(F.col("user_id").alias("handler_id"), F.col("real_name").alias("handler_name"))
    out = a.join(notification_counts(tables), "alert_id", "left").join(users, "handler_id", "left").select(
        "region_name", "alert_id", "alert_type", "severity_level", "triggered_at",
        F.col("status").alias("alert_status"), "handler_id", "handler_name", "handle_result",
        _zero("total_notifications").alias("notification_count"))
    return ordered(out, F.desc("triggered_at"), F.desc("alert_id"), sort=sort)


# -- A12 ---------------------------------------------------------------------
def alert_notification_summary(tables: Tables) -> DataFrame:
    """Per alert with known region and rule: total, delivered and failed notifications."""
    regions = tables["regions"].select("region_id", "region_name")
    rules = tables["alert_rules"].select("rule_id", "severity_level")
    a = tables["alerts"].join(regions, "region_id").join(rules, "rule_id")
    out = a.join(notification_counts(tables), "alert_id", "left")
    return out.select("alert_id", "region_name", "triggered_at", "severity_level", "content", "status",
                      _zero("total_notifications"), _zero("delivered_count"), _zero("failed_count"))


# -- A13 ---------------------------------------------------------------------
def alert_stats(tables: Tables) -> DataFrame:
    """Per day, region, alert type and severity: alerts and closed alerts."""
    rules = tables["alert_rules"].select("rule_id", "alert_type", "severity_level")
    a = tables["alerts"].join(rules, "rule_id")
    regions = tables["regions"].select("region_id", "region_name")
    agg = rollup_through(
        a, "region_id", regions,
        [F.to_date("triggered_at").alias("date"), F.col("alert_type"), F.col("severity_level")],
        ["region_name"],
        [("alert_count", "count", F.lit(1)),
         ("closed_count", "sum", F.when(F.col("status") == "CLOSED", 1).otherwise(0))])
    return agg.select("date", "region_name", "alert_type", "severity_level",
                      F.col("alert_count").cast("bigint").alias("alert_count"),
                      F.col("closed_count").cast("bigint").alias("closed_count"))


# -- R2 ----------------------------------------------------------------------
def raises_alert() -> Column:
    """A VALID reading over a fixed threshold."""
    return (F.col("data_status") == "VALID") & triggered_alert_type().isNotNull()


def alerts_from_readings(readings: DataFrame, tables: Tables, keep: tuple[str, ...] = ()) -> DataFrame:
    """PENDING alerts for VALID readings over a fixed threshold (batch or stream).

    TEMPERATURE above 35 is FIRE, HUMIDITY below 20 DROUGHT.  The rule is the
    smallest active rule_id of that type (no active rule -> no alert).  One
    alert per reading, stamped with the reading's own time.  Both joins are
    with bounded tables: the rule map has at most one row per alert type.
    """
    r = readings.filter(raises_alert()).withColumn("alert_type", triggered_alert_type())
    rule_of_type = (tables["alert_rules"].filter(F.col("is_active"))
                    .groupBy("alert_type").agg(F.min("rule_id").alias("rule_id")))
    s = tables["sensors"].select("sensor_id", "region_id")
    out = r.join(rule_of_type, "alert_type").join(s, "sensor_id")
    content = F.concat(F.lit("Region "), F.col("region_id").cast("string"), F.lit(" sensor "),
                       F.col("sensor_id").cast("string"), F.lit(" triggered alert: "),
                       F.col("numeric_value").cast("string"), F.lit(" matches rule "),
                       F.col("rule_id").cast("string"))
    extra = [c for c in keep if c in out.columns]
    return out.select("reading_id", "rule_id", "region_id", F.col("collected_at").alias("triggered_at"),
                      content.alias("content"), F.lit("PENDING").alias("status"), *extra)


def trigger_alerts(tables: Tables, now, lookback: str = "5 minutes") -> DataFrame:
    """New alerts for the readings newer than ``now - lookback`` (the polled procedure).

    The source walks a cursor row by row; here it is one filter and two
    joins over the look-back window.
    """
    lo = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {lookback}")
    r = tables["sensor_readings"].filter(F.col("collected_at") > lo)
    return alerts_from_readings(with_day_pruning(r, "collected_at", lo=lo), tables)


# -- R3 ----------------------------------------------------------------------
def rule_checks(rules: DataFrame) -> DataFrame:
    """Per rule: whether its text is evaluable and why not."""
    return parsed_rules(rules, "rule_id").select("rule_id", F.col("reason").isNull().alias("evaluable"), "reason")


def measurement_buckets(tables: Tables, minutes: int = 5) -> DataFrame:
    """Per region and time bucket: mean of every rule variable's reading type (VALID only)."""
    r = tables["sensor_readings"].filter(F.col("data_status") == "VALID")
    types = sorted(set(RULE_VARIABLES.values()))
    parts = []
    for t in types:
        v = F.when(F.col("reading_type") == t, F.col("numeric_value"))
        parts += [(f"s_{t}", "sum", v), (f"n_{t}", "count", v)]
    bucket = F.window("collected_at", f"{minutes} minutes").start.alias("bucket_start")
    agg = rollup_through(r, "sensor_id", sensor_dim(tables), [bucket], ["region_id"], parts)
    return agg.select("region_id", "bucket_start", *[
        (F.col(f"s_{t}").cast("double") / F.nullif(F.col(f"n_{t}"), F.lit(0))).alias(variable_column(t))
        for t in types])


def evaluate_rules(tables: Tables, minutes: int = 5) -> DataFrame:
    """(region, bucket, rule) for every active, evaluable rule that holds in that bucket.

    Rules are rows: their texts are read on the executors and become boxes, which meet the buckets in a band
    index (``rule_index``).  Nothing about a rule comes to the driver, and the plan does not depend on how many there are.
    """
    fields = ["rule_id", "alert_type", "severity_level"]
    rules = parsed_rules(tables["alert_rules"].filter(F.col("is_active")), *fields).where("reason IS NULL")
    names = [variable_column(t) for t in sorted(set(RULE_VARIABLES.values()))]
    return rows_with_rules(measurement_buckets(tables, minutes), ["region_id", "bucket_start"], names, rules, fields)
