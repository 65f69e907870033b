"""Report data (A17, A19-A22), export (S7) and the report registry."""

from __future__ import annotations

import datetime as _dt
import re
import functools
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import as_date, since
from .alerts import notification_counts

Tables = Mapping[str, DataFrame]

# --- fixed values: report units, registry texts ------------------------------
UNIT_REGION = "个"
UNIT_TIME = "条"
UNIT_TYPE = "%"
DAILY_PATH_PREFIX = "/reports/daily_"
DAILY_PATH_SUFFIX = ".pdf"
DAILY_SOURCE = "Auto generated: Daily environmental monitoring data summary"
TIME_REPORT_DAYS = 30
REPORT_COLUMNS = ["id", "name", "type", "value", "unit", "time"]


def period_range(period: str) -> tuple[_dt.date, _dt.date]:
    """[first day, day after the last) of a period label: YYYY-MM-DD, YYYY-Www (ISO week) or YYYY-MM."""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", period):
        d = _dt.date.fromisoformat(period)
        return d, d + _dt.timedelta(days=1)
    m = re.fullmatch(r"(\d{4})-W(\d{2})", period)
    if m:
        d = _dt.date.fromisocalendar(int(m.group(1)), int(m.group(2)), 1)
        return d, d + _dt.timedelta(days=7)
    m = re.fullmatch(r"(\d{4})-(\d{2})", period)
    if m:
        y, mo = int(m.group(1)), int(m.group(2))
        return _dt.date(y, mo, 1), (_dt.date(y + 1, 1, 1) if mo == 12 else _dt.date(y, mo + 1, 1))
    raise ValueError(f"unsupported period label: {period}")


def _in_period(col: str, period: str | None):
    if period is None:
        return F.lit(True)
    lo, hi = period_range(period)
    c = F.col(col)
    return (c >= F.lit(lo.isoformat()).cast("timestamp_ntz")) & (c < F.lit(hi.isoformat()).cast("timestamp_ntz"))


def report_template_usage(tables: Tables) -> DataFrame:
    """Every template with its number of reports and the last generation time."""
    per = tables["reports"].groupBy("template_id").agg(
        F.count("report_id").alias("generated_reports_count"), F.max("generated_at").alias("last_generated_at"))
    t = tables["report_templates"]
    out = t.join(per, "template_id", "left")
    return out.select("template_id", "template_name", "dimension", "metrics", "cycle", "is_active", "created_at",
                      F.coalesce("generated_reports_count", F.lit(0)).cast("bigint").alias("generated_reports_count"),
                      "last_generated_at")


def report_region(tables: Tables, as_of=None) -> DataFrame:
    """REGION dimension: sensors per region (regions without sensors: 0)."""
    per = tables["sensors"].groupBy("region_id").agg(F.count("sensor_id").alias("sensor_count"))
    r = tables["regions"].select("region_id", "region_name", "region_type")
    return r.join(per, "region_id", "left").select(
        "region_id", "region_name", "region_type",
        F.coalesce("sensor_count", F.lit(0)).cast("bigint").alias("sensor_count"),
        F.lit(UNIT_REGION).alias("unit"), as_date(as_of).alias("date"))


def report_time(tables: Tables, as_of=None, days: int = TIME_REPORT_DAYS, period: str | None = None) -> DataFrame:
    """TIME dimension: alerts of the last N days (by date) with their notification count.

    With ``period`` the alerts of that period are taken instead of the last N
    days.  The alert type comes from the alert's rule (alerts have no type column).
    """
    a = tables["alerts"]
    a = a.filter(_in_period("triggered_at", period)) if period is not None else \
        a.filter(since(F.to_date("triggered_at"), as_of, days))
    r = tables["regions"].select("region_id", "region_name")
    ru = tables["alert_rules"].select("rule_id", "alert_type")
    counts = notification_counts(tables).select("alert_id", "total_notifications")
    out = (a.join(r, "region_id", "left").join(ru, "rule_id", "left")
            .join(counts, "alert_id", "left"))
    return out.select("alert_id", "region_name", "alert_type",
                      F.coalesce("total_notifications", F.lit(0)).cast("bigint").alias("notification_count"),
                      F.lit(UNIT_TIME).alias("unit"), "triggered_at")


def report_type(tables: Tables, as_of=None, period: str | None = None) -> DataFrame:
    """TYPE dimension: mean battery per device, a missing value counting as 0 (logs of ``period`` only if given)."""
    per = tables["device_status_logs"].filter(_in_period("collected_at", period)).groupBy("device_id").agg(
        F.sum(F.coalesce(F.col("battery_percent"), F.lit(0)).cast("bigint")).alias("s"),
        F.count(F.lit(1)).alias("n"))
    d = tables["devices"].select("device_id", "device_name", "device_type")
    out = d.join(per, "device_id", "left")
    avg = F.when(F.col("n").isNull(), F.lit(0.0)).otherwise(F.col("s").cast("double") / F.col("n"))
    return out.select("device_id", "device_name", "device_type", avg.alias("avg_battery"),
                      F.lit(UNIT_TYPE).alias("unit"), as_date(as_of).alias("date"))


def _as_report(df: DataFrame, cols: list[str]) -> DataFrame:
    i, n, t, v, u, tm = cols
    return df.select(F.col(i).cast("bigint").alias("id"), F.col(n).cast("string").alias("name"),
                     F.col(t).cast("string").alias("type"), F.col(v).cast("double").alias("value"),
                     F.col(u).alias("unit"), F.col(tm).cast("timestamp_ntz").alias("time"))


def report_data(tables: Tables, dimension: str, as_of=None, period: str | None = None) -> DataFrame:
    """Rows of one dimension in the common six-column shape (optionally restricted to ``period``)."""
    if dimension == "REGION":
        return _as_report(report_region(tables, as_of),
                          ["region_id", "region_name", "region_type", "sensor_count", "unit", "date"])
    if dimension == "TIME":
        return _as_report(report_time(tables, as_of, period=period),
                          ["alert_id", "region_name", "alert_type", "notification_count", "unit", "triggered_at"])
    if dimension == "TYPE":
        return _as_report(report_type(tables, as_of, period=period),
                          ["device_id", "device_name", "device_type", "avg_battery", "unit", "date"])
    raise ValueError(f"unsupported report dimension: {dimension}")


def generate_reports(tables: Tables, as_of=None, period: str | None = None,
                     templates: DataFrame | None = None, restrict_to_period: bool = False,
                     template_id: int | None = None) -> DataFrame:
    """Report rows of every active template: (template_id, period) + the six columns.

    ``period`` is a label by default (as in the source); with
    ``restrict_to_period`` the TIME and TYPE rows only use data of that period.

    ``template_id`` restricts the run to one template.  Only the dimensions that
    some template asks for (at most three values reach the driver) are computed,
    each once; its rows take their templates from a list computed by a scalar
    subquery, so no join runs on the three-valued dimension.
    """
    t = templates if templates is not None else tables["report_templates"].filter(F.col("is_active"))
    t = t.select("template_id", "dimension").filter(F.col("dimension").isin(REPORT_DIMENSIONS))
    if template_id is not None:
        t = t.filter(F.col("template_id") == template_id)
    only = period if restrict_to_period else None
    per = F.lit(period) if period is not None else F.date_format(as_date(as_of), "yyyy-MM-dd")
    asked = [r["dimension"] for r in t.select("dimension").distinct().collect()]
    parts = []
    for dim in sorted(asked) or REPORT_DIMENSIONS[:1]:
        ids = t.filter(F.col("dimension") == dim).agg(F.collect_list("template_id").alias("ids")).scalar()
        parts.append(report_data(tables, dim, as_of, only).select(
            F.explode(ids).alias("template_id"), per.alias("period"), *REPORT_COLUMNS))
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


REPORT_DIMENSIONS = ["REGION", "TIME", "TYPE"]


def rejected_templates(tables: Tables) -> DataFrame:
    """Active templates whose dimension has no report form (the source answers them with an error)."""
    t = tables["report_templates"].filter(F.col("is_active"))
    return t.filter(F.col("dimension").isNull() | ~F.col("dimension").isin(REPORT_DIMENSIONS)).select(
        "template_id", "template_name", "dimension", F.lit("unsupported report dimension").alias("reason"))


def export_report(report: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write report rows below ``path``, one folder per (template_id, period).

    Executors write the files, the driver only commits; csv gets a header.
    Appends, so earlier periods stay.
    """
    w = report.write.mode("append").partitionBy("template_id", "period").format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    w.save(path)
    return path


def daily_report_entry(tables: Tables, as_of=None, day=None) -> DataFrame:
    """The registry row of a daily report (one row).

    Period is ``day`` (default: the day before ``as_of``) as YYYY-MM-DD, the
    template the smallest id with cycle DAY, the id one above the largest
    report id.
    """
    ref = as_date(as_of)
    d = as_date(day) if day is not None else F.date_sub(ref, 1)
    period = F.date_format(d, "yyyy-MM-dd")
    # one aggregate over both inputs (no join): largest report id, smallest DAY template
    ids = tables["reports"].select(F.col("report_id").alias("rid"), F.lit(None).cast("bigint").alias("tid"))
    tmpl = tables["report_templates"].filter(F.col("cycle") == "DAY").select(
        F.lit(None).cast("bigint").alias("rid"), F.col("template_id").alias("tid"))
    row = ids.unionByName(tmpl).agg((F.coalesce(F.max("rid"), F.lit(0)) + 1).alias("report_id"),
                                    F.min("tid").alias("template_id"))
    return row.select("report_id", "template_id", period.alias("period"),
                      ref.cast("timestamp_ntz").alias("generated_at"),
                      F.concat(F.lit(DAILY_PATH_PREFIX), period, F.lit(DAILY_PATH_SUFFIX)).alias("file_path"),
                      F.lit(DAILY_SOURCE).alias("data_source"))


def register_report(tables: Tables, entry: DataFrame) -> DataFrame:
    """The reports table with ``entry`` appended."""
    cols = ["report_id", "template_id", "period", "generated_at", "file_path", "data_source"]
    return tables["reports"].select(*cols).unionByName(entry.select(*cols))
