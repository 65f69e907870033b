"""Hand-made mini data set: fixed dates, a few rows per table, every edge the operators must handle."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from envmon.schemas import conform
from tests import seed

T0 = dt.datetime(2024, 1, 20, 12, 0, 0)
AS_OF = "2024-01-31"
MIN5 = dt.timedelta(minutes=5)
US = dt.timedelta(microseconds=1)


def ts(day, h=0, m=0, s=0):
    return dt.datetime(2024, 1, day, h, m, s)


def _df(spark, table, ddl, rows):
    return conform(spark.createDataFrame(rows, ddl), table)


def mini_tables(spark):
    t = {}
    t["regions"] = _df(spark, "regions", "region_id BIGINT, region_name STRING, region_type STRING", [
        (1, "North Forest", "FOREST"), (2, "South Grass", "GRASSLAND"), (3, "Empty Forest", "FOREST")])
    t["sensors"] = _df(spark, "sensors", "sensor_id BIGINT, region_id BIGINT, monitor_type STRING, status STRING", [
        (10, 1, "TEMPERATURE", "ACTIVE"), (11, 1, "HUMIDITY", "ACTIVE"), (12, 2, "TEMPERATURE", "ACTIVE"),
        (13, 2, "OTHER", "INACTIVE"), (14, 1, "TEMPERATURE", "ACTIVE")])
    raw = [
        # id, sensor, time, type, value, unit, caller status (overwritten by R1)
        (1, 10, ts(20, 1), "TEMPERATURE", D("-50.00"), "C", "INVALID"),
        (2, 10, ts(20, 2), "TEMPERATURE", D("50.00"), "C", "INVALID"),
        (3, 10, ts(20, 3), "TEMPERATURE", D("-50.01"), "C", "VALID"),
        (4, 10, ts(20, 4), "TEMPERATURE", D("50.01"), "C", "VALID"),
        (5, 11, ts(20, 5), "HUMIDITY", D("0.00"), "%", None),
        (6, 11, ts(20, 6), "HUMIDITY", D("100.00"), "%", None),
        (7, 11, ts(20, 7), "HUMIDITY", D("-0.01"), "%", None),
        (8, 11, ts(20, 8), "HUMIDITY", D("100.01"), "%", None),
        (9, 10, ts(20, 9), "TEMPERATURE", None, "C", "INVALID"),
        (10, 10, ts(22, 9), "TEMPERATURE", D("35.00"), "C", None),
        (11, 10, ts(22, 10), "TEMPERATURE", D("35.01"), "C", None),
        (12, 11, ts(22, 11), "HUMIDITY", D("20.00"), "%", None),
        (13, 11, ts(22, 12), "HUMIDITY", D("19.99"), "%", None),
        # around the alert at T0 in region 1: exactly -5 min (INVALID), -5 min - 1 us (INVALID)
        (14, 14, T0 - MIN5, "TEMPERATURE", D("90.00"), "C", None),
        (15, 14, T0 - MIN5 - US, "TEMPERATURE", D("91.00"), "C", None),
        # +5 min exactly, in region 2 only (J7 keeps it, J7b does not)
        (16, 12, T0 + MIN5 + dt.timedelta(hours=1), "TEMPERATURE", D("-99.00"), "C", None),
        (17, 11, ts(21, 3), "PM25", D("24.50"), "ug/m3", None),
        (18, 11, ts(21, 4), "PM25", D("25.00"), "ug/m3", None),
        (19, 11, ts(23, 4), "PM25", D("150.00"), "ug/m3", None),
        (20, 14, ts(25), "TEMPERATURE", D("95.00"), "C", None),
    ]
    t["raw_readings"] = _df(
        spark, "raw_readings",
        "reading_id BIGINT, sensor_id BIGINT, collected_at TIMESTAMP_NTZ, reading_type STRING, "
        "numeric_value DECIMAL(10,2), value_unit STRING, data_status STRING", raw)
    from envmon.operators.quality import validate_readings
    t["sensor_readings"] = validate_readings(t["raw_readings"])
    t["alert_rules"] = seed.alert_rules(spark)
    t["alerts"] = _df(spark, "alerts",
                      "alert_id BIGINT, rule_id BIGINT, region_id BIGINT, triggered_at TIMESTAMP_NTZ, status STRING", [
                          (100, 1, 1, T0, "PENDING"),                            # INVALID reading exactly -5 min
                          (101, 2, 2, T0 + dt.timedelta(hours=1), "CLOSED"),     # +5 min, region 2 reading
                          (102, 9, 1, T0 + dt.timedelta(hours=1), "PENDING"),    # unknown rule; reading is region 2
                          (103, 4, 2, ts(5), "PROCESSING"),                      # nothing nearby, no notifications
                          (104, 1, 1, ts(25) + MIN5 + US, "PENDING"),            # 1 us outside reading 20
                          (105, 1, 1, ts(25) - MIN5, "PENDING")])                # exactly inside (other end)
    t["notifications"] = _df(spark, "notifications",
                             "notification_id BIGINT, alert_id BIGINT, receiver_id BIGINT, receive_status STRING", [
                                 (1, 100, 1, "DELIVERED"), (2, 100, 2, "FAILED"), (3, 101, 1, "SENT")])
    t["devices"] = _df(spark, "devices", "device_id BIGINT, device_name STRING, device_type STRING, "
                       "install_region_id BIGINT", [
                           (1, "dev-a", "SENSOR", 1), (2, "dev-b", "CAMERA", 1), (3, "dev-c", "ALERTER", 2),
                           (4, "dev-d", "OTHER", None)])
    t["device_status_logs"] = _df(spark, "device_status_logs",
                                  "log_id BIGINT, device_id BIGINT, collected_at TIMESTAMP_NTZ, run_status STRING, "
                                  "battery_percent INT", [
                                      (1, 1, ts(1), "FAULT", 50), (2, 1, ts(2), "FAULT", None),
                                      (3, 1, ts(3), "NORMAL", 80),
                                      (4, 2, ts(5), "NORMAL", 10), (5, 2, ts(5), "OFFLINE", 20)])
    t["maintenance_records"] = _df(spark, "maintenance_records",
                                   "maintenance_id BIGINT, device_id BIGINT, maintenance_time TIMESTAMP_NTZ", [
                                       (1, 1, ts(1)), (2, 1, ts(2)), (3, 1, ts(3)),      # 30 days before 2024-02-02
                                       (4, 2, dt.datetime(2024, 1, 2, 23, 0)),           # 31 calendar days
                                   ])
    t["resources"] = _df(spark, "resources", "resource_id BIGINT, resource_type STRING, region_id BIGINT, "
                         "species_name STRING, quantity INT, area DECIMAL(12,2), growth_stage STRING", [
                             (1, "TREE", 1, "pine", 10, None, "SEEDLING"),
                             (2, "GRASS", 1, "fescue", None, D("5.50"), "GROWING"),
                             (3, "TREE", 2, "oak", 7, D("1.00"), "MATURE")])
    t["resource_changes"] = _df(spark, "resource_changes", "change_id BIGINT, resource_id BIGINT, change_type STRING, "
                                "change_amount INT, change_area DECIMAL(12,2)", [
                                    (1, 1, "ADD", 5, None), (2, 1, "REDUCE", 2, None),
                                    (3, 1, "STATUS_UPDATE", None, None)])
    t["users"] = _df(spark, "users", "user_id BIGINT, real_name STRING", [(1, "Ann"), (2, "Bo"), (3, "Cy")])
    t["roles"] = seed.roles(spark)
    t["permissions"] = seed.permissions(spark)
    t["role_permissions"] = seed.role_permissions(spark)
    t["user_roles"] = _df(spark, "user_roles", "user_id BIGINT, role_id BIGINT", [(1, 1), (2, 4), (2, 4), (9, 2)])
    t["report_templates"] = _df(spark, "report_templates", "template_id BIGINT, template_name STRING, dimension STRING, "
                                "cycle STRING, is_active BOOLEAN", [
                                    (1, "daily regions", "REGION", "DAY", True), (2, "weekly", "TIME", "WEEK", True),
                                    (3, "monthly", "TYPE", "MONTH", True), (4, "old", "REGION", "DAY", False),
                                    (5, "bad", "SPACE", "DAY", True)])
    t["reports"] = _df(spark, "reports", "report_id BIGINT, template_id BIGINT, period STRING", [(7, 1, "2024-01-01")])
    return t


def login_rows():
    """(event_id, user_id, ts, success) runs of the lock rule."""
    rows = []
    eid = 0

    def add(user, t, ok):
        nonlocal eid
        eid += 1
        rows.append((eid, user, t, ok))
    # user 1: 4 failures then success -> never locked
    for i in range(4):
        add(1, ts(1, 10, i), False)
    add(1, ts(1, 10, 5), True)
    # user 2: 5 failures -> locked; a try (even correct) during the lock is refused;
    # after the lock one failure does not lock again
    for i in range(5):
        add(2, ts(1, 10, i), False)
    add(2, ts(1, 10, 30), True)          # refused (locked until 11:04)
    add(2, ts(1, 11, 4), False)          # lock ended exactly now: counts as 1
    add(2, ts(1, 11, 5), True)
    # user 3: equal time stamps ordered by event id
    add(3, ts(2, 9), False)
    add(3, ts(2, 9), True)
    return rows
