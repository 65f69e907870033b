"""Operator tests on the hand-made mini data set (edges, NULLs, ties, boundaries, invariants)."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from envmon.functions.domain import aqi, aqi_level
from envmon.functions.rules import compile_rule
from envmon.operators import (access, alerts, devices, enrich, filters, interval, lifecycle, quality,
                              reports, resources, stats)
from tests.mini import AS_OF, login_rows


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_validity_boundaries(mini):
    got = dict((r["reading_id"], r["data_status"]) for r in mini["sensor_readings"].collect())
    assert [got[i] for i in range(1, 10)] == ["VALID", "VALID", "INVALID", "INVALID", "VALID", "VALID",
                                              "INVALID", "INVALID", "VALID"]
    assert got[17] == "VALID"  # other types are always valid


def test_validity_is_idempotent(mini):
    once = quality.validate_readings(mini["raw_readings"])
    twice = quality.validate_readings(once)
    assert rows(once, "reading_id", "data_status") == rows(twice, "reading_id", "data_status")


def test_anomaly_classes(mini):
    a = stats.anomaly_data(mini, days=30, as_of=AS_OF)
    got = {r["sensor_id"] * 1000 + int(r["value"]): r["anomaly_type"] for r in a.collect()}
    assert set(got.values()) <= {"HIGH", "LOW", "OUT_OF_RANGE"}
    assert got[11 * 1000 + 100] == "HIGH" and got[10 * 1000 - 50] == "LOW"
    assert got[14 * 1000 + 90] == "OUT_OF_RANGE"


def test_interval_join_exact_ends(mini):
    near = interval.alerts_near_readings(mini["alerts"], mini, "INVALID")
    assert rows(near, "alert_id") == [(100,), (101,), (102,), (105,)]
    same = interval.alerts_near_readings(mini["alerts"], mini, "INVALID", same_region=True)
    assert rows(same, "alert_id") == [(100,), (101,), (105,)]


def test_interval_join_matches_brute_force(spark):
    from envmon.sources.driver import driver_tables
    t = driver_tables(spark, "/root/testdata/sf0.001")
    la = t["live_alerts"]
    fast = {r["alert_id"] for r in interval.alerts_near_readings(la, t, "VALID").collect()}
    rd = [r["collected_at"] for r in t["sensor_readings"].filter("data_status = 'VALID'").collect()]
    five = dt.timedelta(minutes=5)
    slow = {r["alert_id"] for r in la.collect()
            if any(r["triggered_at"] - five <= x <= r["triggered_at"] + five for x in rd)}
    assert fast == slow and len(fast) > 0


def test_list_alerts_unknown_rule(mini):
    out = {r["alert_id"]: (r["alert_type"], r["severity_level"]) for r in interval.list_alerts(mini).collect()}
    assert out[102] == ("未知类型", "未知")
    assert out[100] == ("FIRE", "SEVERE")


def test_trigger_alert_thresholds(mini):
    out = alerts.trigger_alerts(mini, now="2024-01-31 00:00:00", lookback="30 days")
    got = rows(out, "reading_id", "rule_id")
    assert got == [(2, 1), (5, 4), (11, 1), (13, 4)]  # 35.00 and 20.00 are not enough; rule 3 inactive
    content = out.filter("reading_id = 11").first()["content"]
    assert content == "Region 1 sensor 10 triggered alert: 35.01 matches rule 1"


@pytest.mark.parametrize("text", ["abs(temperature) > 3", "temperature > (SELECT 1)", "wind > 3",
                                  "temperature > 'x'", "temperature > 3; DROP TABLE x", ""])
def test_rule_texts_refused(spark, text):
    expr, reason = compile_rule(text)
    assert expr is None and reason


@pytest.mark.parametrize("text", ["temperature > 35 AND humidity < 20", "temp>=38 AND humidity<=20",
                                  "NOT (pm25 > 10) OR co2 = 400", "temperature > -5"])
def test_rule_texts_accepted(spark, text):
    expr, reason = compile_rule(text)
    assert expr is not None and reason is None


def test_rule_evaluation_mini(mini):
    out = alerts.evaluate_rules(mini)
    # humidity 19.99 alone in its bucket -> rule 4 (humidity < 20); no temperature there -> rules 1, 2 unknown
    assert ("DROUGHT", 4) in rows(out, "alert_type", "rule_id")
    assert all(r["rule_id"] in (1, 2, 4) for r in out.collect())


def test_aqi_levels(spark):
    vals = [24.5, 25.0, 49.5, 50.0, 74.5, 75.0, 99.5, 100.0, 149.5, 150.0]
    df = spark.createDataFrame([(v,) for v in vals], "pm25 DOUBLE").select("pm25", aqi(F.col("pm25")).alias("aqi"))
    df = df.withColumn("level", aqi_level(F.col("aqi")))
    got = [(r["aqi"], r["level"]) for r in df.orderBy("pm25").collect()]
    assert [a for a, _ in got] == [49, 50, 99, 100, 149, 150, 199, 200, 299, 300]
    assert [lv for _, lv in got] == ["优", "良", "良", "轻度污染", "轻度污染", "中度污染", "中度污染", "重度污染",
                                     "重度污染", "严重污染"]


def test_air_quality_missing_is_zero(mini):
    aq = stats.air_quality(mini, days=30, as_of=AS_OF)
    r = aq.filter("time = DATE'2024-01-21'").first()
    assert r["pm25"] == pytest.approx(24.75) and r["co2"] == 0.0 and r["aqi"] == 49


def test_sensor_summary_keeps_sensors_without_readings(mini):
    s = {r["sensor_id"]: r for r in stats.sensor_data_summary(mini).collect()}
    assert s[13]["total_readings"] == 0 and s[13]["valid_readings"] == 0 and s[13]["avg_value"] is None


def test_validity_counts_add_up(mini):
    for r in stats.sensor_validity(mini, days=None).collect():
        assert r["valid_readings"] + r["invalid_readings"] == r["total_readings"]


def test_trend_previous_present_day(mini):
    tr = stats.trend_analysis(mini).filter("region_name = 'North Forest' AND reading_type = 'TEMPERATURE'")
    got = [(r["date"], r["prev_avg_value"]) for r in tr.orderBy("date").collect()]
    assert got[0][1] is None
    assert got[1][0] == dt.date(2024, 1, 22) and got[1][1] is not None  # day 21 missing: previous is day 20


def test_latest_status_tie_break(mini):
    s = {r["device_id"]: r for r in devices.latest_device_status(mini).collect()}
    assert s[2]["run_status"] == "OFFLINE"  # two logs at the same time: larger log_id wins
    assert s[1]["run_status"] == "NORMAL" and s[1]["region_name"] == "North Forest"


def test_fault_parity_not_below_exact(mini):
    exact = {r["device_id"]: r for r in devices.device_fault_maintenance(mini).collect()}
    par = {r["device_id"]: r for r in devices.device_fault_maintenance_parity(mini).collect()}
    assert exact[1]["fault_times"] == 2 and exact[1]["maintenance_count"] == 3
    assert par[1]["fault_count"] == 6 and par[1]["maintenance_count"] == 9


def test_maintenance_due_calendar_days(mini):
    due = {r["device_id"]: r for r in devices.maintenance_due(mini, as_of="2024-02-02").collect()}
    assert 1 not in due                    # exactly 30 days ago: not due
    assert due[2]["days_since_last_maintenance"] == 31
    assert due[3]["last_maintenance_time"] is None and "从未" in due[3]["content"]


def test_capture_changes(mini, spark):
    old = mini["resources"]
    new = old.select("resource_id", "resource_type", "region_id", "species_name",
                     F.when(F.col("resource_id") == 1, 12).otherwise(F.col("quantity")).alias("quantity"),
                     F.when(F.col("resource_id") == 3, F.lit(D("0.50"))).otherwise(F.col("area"))
                      .cast("decimal(12,2)").alias("area"),
                     F.when(F.col("resource_id") == 3, "SEEDLING").otherwise(F.col("growth_stage")).alias("growth_stage"))
    new = new.unionByName(spark.createDataFrame(
        [(9, "TREE", 1, "new", 4, None, "SEEDLING")],
        "resource_id BIGINT, resource_type STRING, region_id BIGINT, species_name STRING, quantity INT, "
        "area DECIMAL(12,2), growth_stage STRING"))
    ch = resources.capture_resource_changes(old, new, changed_at="2024-01-31 00:00:00")
    got = rows(ch, "resource_id", "change_type", "change_amount", "change_area")
    assert got == [(1, "ADD", 2, None), (3, "REDUCE", None, D("0.50")), (3, "STATUS_UPDATE", None, None),
                   (9, "ADD", 4, None)]  # resource 2 (NULL quantity) gives no quantity row


def test_net_change_counts_status_update(mini):
    r = {x["species_name"]: x for x in resources.resource_net_change(mini).collect()}
    assert r["pine"]["net_quantity_change"] == 3 and r["pine"]["change_count"] == 3
    assert r["fescue"]["change_count"] == 0 and r["fescue"]["net_quantity_change"] == 0


def test_summary_parity_inflates(mini):
    ex = {r["resource_type"] + r["region_name"]: r for r in resources.resource_summary(mini).collect()}
    pa = {r["resource_type"] + r["region_name"]: r for r in resources.resource_summary_parity(mini).collect()}
    assert ex["TREENorth Forest"]["current_quantity"] == 10 and pa["TREENorth Forest"]["current_quantity"] == 30


def test_region_alert_stats_keeps_empty_regions(mini):
    out = {r["region_name"]: r for r in alerts.region_alert_stats(mini, days=30, as_of=AS_OF).collect()}
    assert out["Empty Forest"]["sensors"] == 0 and out["Empty Forest"]["alerts"] == 0
    assert out["North Forest"]["notifications_sent"] == 2


def test_notification_summary_zero(mini):
    s = {r["alert_id"]: r for r in alerts.alert_notification_summary(mini).collect()}
    assert s[103]["total_notifications"] == 0 and s[103]["delivered_count"] == 0
    assert 102 not in s  # unknown rule: inner join drops it


def test_rights(mini):
    perms = access.user_permissions(mini)
    assert perms.filter("user_id = 1").count() == 20
    req = mini["users"].select("user_id", F.lit("alerts").alias("resource"), F.lit("manage").alias("action"))
    got = {r["user_id"]: r["allowed"] for r in access.check_permissions(mini, req).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_lockouts_runs(spark):
    ev = spark.createDataFrame(login_rows(), "event_id BIGINT, user_id BIGINT, ts TIMESTAMP_NTZ, success BOOLEAN")
    out = {r["event_id"]: (r["outcome"], r["failed_attempts"]) for r in access.login_lockouts(ev).collect()}
    assert [out[i][0] for i in range(1, 6)] == ["FAILURE"] * 4 + ["SUCCESS"]
    assert [out[i][0] for i in range(6, 14)] == ["FAILURE"] * 4 + ["LOCKED", "REFUSED", "FAILURE", "SUCCESS"]
    assert out[12][1] == 1  # the count restarted when the lock ended
    assert out[14][0] == "FAILURE" and out[15][0] == "SUCCESS"


def test_upsert_and_unmatched(mini, spark):
    ch = spark.createDataFrame([(1, 99), (42, 5)], "resource_id BIGINT, quantity INT")
    out, miss = lifecycle.upsert_snapshot(mini["resources"], ch, "resource_id")
    q = {r["resource_id"]: r["quantity"] for r in out.collect()}
    assert q == {1: 99, 2: None, 3: 7} and rows(miss, "resource_id") == [(42,)]


def test_upsert_last_change_wins(mini, spark):
    ch = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "resource_id BIGINT, quantity INT, seq INT")
    out, _ = lifecycle.upsert_snapshot(mini["resources"], ch.select("resource_id", "quantity", "seq"),
                                       "resource_id", order_by="seq")
    assert out.filter("resource_id = 1").first()["quantity"] == 6


def test_insert_ignore_twice_is_once(mini):
    base = mini["user_roles"].select("user_id", "role_id").dropDuplicates()
    new = mini["users"].select("user_id", F.lit(4).cast("bigint").alias("role_id"))
    once = lifecycle.insert_ignore(base, new, ["user_id", "role_id"])
    twice = lifecycle.insert_ignore(once, new, ["user_id", "role_id"])
    assert rows(once, "user_id", "role_id") == rows(twice, "user_id", "role_id")
    assert (3, 4) in rows(once, "user_id", "role_id")


def test_cascade_leaves_no_orphans(mini, spark):
    keys = spark.createDataFrame([(1,)], "region_id BIGINT")
    rem, counts = lifecycle.cascade_delete(mini, "regions", keys)
    c = dict((r["table_name"], r["removed"]) for r in counts.collect())
    assert c["regions"] == 1 and c["sensors"] == 3 and c["devices"] == 2
    sensors = {r["sensor_id"] for r in rem["sensors"].collect()}
    assert all(r["sensor_id"] in sensors for r in rem["sensor_readings"].collect())
    devs = {r["device_id"] for r in rem["devices"].collect()}
    assert all(r["device_id"] in devs for r in rem["maintenance_records"].collect())


def test_constraint_violations(mini):
    v = lifecycle.constraint_violations(mini)
    got = {(r["table_name"], r["kind"], r["key_value"]) for r in v.collect()}
    assert ("user_roles", "DUPLICATE_KEY", "2,4") in got
    assert ("user_roles", "ORPHAN", "9") in got
    assert ("report_templates", "NOT_ALLOWED", "SPACE") in got


def test_constraints_of_a_shared_key_in_one_aggregation(spark):
    """A key that repeats and is referred to, orphans of two tables, one value in both, nulls; no join but with the names."""
    ids = lambda name, *values: spark.createDataFrame([(v,) for v in values], f"{name} BIGINT")
    t = {"users": ids("user_id", 1, 1, 2, None, None),
         "regions": spark.createDataFrame([(1, "a", 1), (2, "a", 7), (2, None, 7), (3, "b", None)], "region_id BIGINT, region_name STRING, manager_id BIGINT"),
         "sensors": spark.createDataFrame([(1, 2, "x"), (2, 9, None), (3, None, "ACTIVE")], "sensor_id BIGINT, region_id BIGINT, status STRING"),
         "user_roles": spark.createDataFrame([(7, 1), (7, 1), (2, 1), (2, None), (2, None)], "user_id BIGINT, role_id BIGINT")}
    found = lifecycle.constraint_violations(t)
    assert sorted(tuple(r) for r in found.collect()) == sorted([
        ("users", "(user_id)", "DUPLICATE_KEY", "1", 2), ("regions", "(region_id)", "DUPLICATE_KEY", "2", 2),
        ("regions", "(region_name)", "DUPLICATE_UNIQUE", "a", 2), ("regions", "manager_id->users.user_id", "ORPHAN", "7", 2),
        ("sensors", "region_id->regions.region_id", "ORPHAN", "9", 1), ("sensors", "status", "NOT_ALLOWED", "x", 1),
        ("user_roles", "(user_id,role_id)", "DUPLICATE_KEY", "7,1", 2), ("user_roles", "user_id->users.user_id", "ORPHAN", "7", 2)])
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_reports(mini):
    with pytest.raises(ValueError):
        reports.report_data(mini, "SPACE")
    r = reports.generate_reports(mini, as_of="2024-01-31")
    assert {x["template_id"] for x in r.collect()} == {1, 2, 3}
    t = {x["device_id"]: x["avg_battery"] for x in reports.report_type(mini).collect()}
    assert t[1] == pytest.approx(130 / 3) and t[3] == 0.0
    e = reports.daily_report_entry(mini, as_of="2024-02-01").first()
    assert (e["report_id"], e["template_id"], e["period"]) == (8, 1, "2024-01-31")
    assert e["file_path"] == "/reports/daily_2024-01-31.pdf"


def test_export_report(mini, spark, tmp_dir):
    r = reports.generate_reports(mini, as_of="2024-01-31")
    for fmt in ("parquet", "json", "csv"):
        p = reports.export_report(r, f"{tmp_dir}/{fmt}", fmt)
        back = spark.read.format(fmt).option("header", "true").load(p)
        assert back.count() == r.count()


def test_lists_and_lookup(mini, spark):
    assert rows(filters.list_regions(mini, "FOREST", "forest"), "region_id") == [(1,), (3,)]
    found, missing = filters.lookup_keys(mini["sensors"], spark.createDataFrame([(10,), (10,), (99,)], "sensor_id BIGINT"),
                                         "sensor_id")
    assert rows(found, "sensor_id") == [(10,)] and rows(missing, "sensor_id") == [(99,)]
    rr = filters.readings_in_range(mini, "2024-01-20 01:00:00", "2024-01-20 02:00:00")
    assert rows(rr, "reading_id") == [(1,), (2,)]  # both ends inclusive


def test_region_sensors_keeps_empty_region(mini):
    out = enrich.region_sensors(mini)
    assert out.filter("region_id = 3").count() == 1 and out.filter("region_id = 3").first()["sensor_id"] is None


def test_device_timeline_one_row_per_event(mini):
    tl = enrich.device_timeline(mini)
    assert tl.filter("device_id = 1").count() == 3 + 3


def test_latest_readings_single_sensor_path(mini):
    one = stats.latest_readings(mini, n=3, sensor_ids=[10])
    many = stats.latest_readings(mini, n=3).filter("sensor_id = 10")
    cols = ("rank", "reading_id")
    assert rows(one, *cols) == rows(many, *cols) and len(rows(one, *cols)) == 3


def test_period_range():
    import datetime as dt
    assert reports.period_range("2025-01-02") == (dt.date(2025, 1, 2), dt.date(2025, 1, 3))
    assert reports.period_range("2025-W01") == (dt.date(2024, 12, 30), dt.date(2025, 1, 6))
    assert reports.period_range("2024-12") == (dt.date(2024, 12, 1), dt.date(2025, 1, 1))
    with pytest.raises(ValueError):
        reports.period_range("Q1-2024")


@pytest.mark.parametrize("op", ["region_daily_averages", "monthly_stats", "air_quality", "alert_stats",
                                "evaluate_rules", "list_alerts_same_region", "sensor_validity"])
def test_large_table_path_equals_broadcast_path(spark, mini, op):
    """With broadcasts off the operators pre-aggregate per key before joining; same rows."""
    def run():
        if op == "list_alerts_same_region":
            df = interval.list_alerts(mini, validity="INVALID", same_region=True)
        elif op == "alert_stats":
            df = alerts.alert_stats(mini)
        elif op == "evaluate_rules":
            df = alerts.evaluate_rules(mini)
        elif op in ("monthly_stats",):
            df = getattr(stats, op)(mini)
        elif op == "sensor_validity":
            df = stats.sensor_validity(mini, days=None)
        else:
            df = getattr(stats, op)(mini, days=30, as_of=AS_OF)
        return sorted(tuple(r) for r in df.collect())
    small_path = run()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big_path = run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
    assert small_path == big_path and small_path


def test_rule_checks_report(mini):
    got = {r["rule_id"]: (r["evaluable"], r["reason"]) for r in alerts.rule_checks(mini["alert_rules"]).collect()}
    assert got[1] == (True, None) and got[4] == (True, None)
    assert got[5][0] is False and "unknown name" in got[5][1]
    assert got[6][0] is False


def test_register_report_appends(mini):
    e = reports.daily_report_entry(mini, as_of="2024-02-01")
    out = reports.register_report(mini, e)
    assert out.count() == mini["reports"].count() + 1 and out.filter("report_id = 8").count() == 1


def test_name_equality_collation(mini):
    from envmon.functions.common import CI_AI
    assert enrich.sensors_by_region_name(mini, "north forest").count() == 0  # binary by default
    assert enrich.sensors_by_region_name(mini, "nörth FOREST", collation=CI_AI).count() == 3


def test_a_listing_can_be_left_unsorted(spark, mini):
    sorted_plan = filters.list_sensors(mini)._jdf.queryExecution().optimizedPlan().toString()
    bulk = filters.list_sensors(mini, sort=False)
    plan = bulk._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" in sorted_plan and "Sort" not in plan
    assert sorted(r["sensor_id"] for r in bulk.collect()) == [10, 11, 12, 13, 14]


def test_rejected_templates(mini):
    rej = reports.rejected_templates(mini)
    assert [(r["template_id"], r["dimension"]) for r in rej.collect()] == [(5, "SPACE")]


def test_keys_under_the_source_collation(spark):
    from envmon.functions.common import CI_AI
    roles = spark.createDataFrame([(1, "Admin"), (2, "admin"), (3, "Ádmin"), (4, "User"), (5, None), (6, None)], "role_id BIGINT, role_name STRING")
    assert lifecycle.constraint_violations({"roles": roles}).count() == 0  # binary by default
    got = lifecycle.constraint_violations({"roles": roles}, collation=CI_AI).collect()
    assert [(r.kind, r.key_value, r.n) for r in got] == [("DUPLICATE_UNIQUE", "Admin", 3)]
    asked = spark.createDataFrame([("ADMIN",), ("admín",), ("üser",), ("guest",), ("GUEST",), (None,)], "role_name STRING")
    found, missing = filters.lookup_keys(roles, asked, "role_name", collation=CI_AI)
    assert rows(found, "role_id") == [(1,), (2,), (3,), (4,)]
    assert {r.role_name for r in missing.collect()} == {"GUEST", None}
    assert filters.lookup_keys(roles, asked, "role_name")[0].count() == 0
