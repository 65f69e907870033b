"""The monitoring tables as projections of the benchmark parquet files.

The benchmark folder holds TPC-H-like tables plus an ``events`` table.  The
operators of this package know nothing about them: they take monitoring
tables.  This module maps one onto the other (the mapping is the test
fixture described in FIXTURES.md), lazily, one table at a time, so a query
reads only the files and columns it uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import conform

# What tells the rows of one (order, line number) apart, in this order.
LINE_COLUMNS = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                "l_linestatus", "l_shipdate"]

# Fixed evaluation dates of the fixture data.
READINGS_AS_OF = "2024-01-31"   # readings, live alerts, logins
HISTORY_AS_OF = "2001-08-02"    # alerts, notifications, logs, maintenance, changes, reports


class DriverTables(dict):
    """dict of table name -> DataFrame, built on first access."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def src(self, name: str) -> DataFrame:
        cache = self.__dict__.setdefault("_src", {})
        if name not in cache:
            cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return cache[name]

    def __contains__(self, key) -> bool:
        return dict.__contains__(self, key) or hasattr(self, f"_t_{key}")

    def __missing__(self, key: str) -> DataFrame:
        fn = getattr(self, f"_t_{key}", None)
        if fn is None:
            raise KeyError(key)
        df = fn()
        self[key] = df
        return df

    # -- dimensions ---------------------------------------------------------
    def _t_regions(self):
        n = self.src("nation")
        return conform(n.select(
            n.n_nationkey.cast("bigint").alias("region_id"),
            n.n_name.alias("region_name"),
            F.when(n.n_regionkey % 2 == 0, "FOREST").otherwise("GRASSLAND").alias("region_type"),
            n.n_nationkey.cast("bigint").alias("manager_id")), "regions")

    def _t_sensors(self):
        c = self.src("customer")
        seg = c.c_mktsegment
        return conform(c.select(
            c.c_custkey.alias("sensor_id"),
            (c.c_nationkey % 20).cast("bigint").alias("region_id"),  # regions 20 and up have no sensor
            c.c_name.alias("model"),
            F.when(seg == "BUILDING", "TEMPERATURE").when(seg == "MACHINERY", "HUMIDITY")
             .when(seg == "AUTOMOBILE", "IMAGE").otherwise("OTHER").alias("monitor_type"),
            F.when(c.c_acctbal < 0, "INACTIVE").otherwise("ACTIVE").alias("status")), "sensors")

    def _t_alert_rules(self):
        """One rule per nation; every third text names something no reading measures."""
        n = self.src("nation")
        k = n.n_nationkey
        wet = F.concat(F.lit("humidity < "), (k % 7 + 20).cast("string"))
        return conform(n.select(
            (k + 1).cast("bigint").alias("rule_id"),
            F.when(n.n_regionkey % 4 == 0, "FIRE").when(n.n_regionkey % 4 == 1, "DROUGHT")
             .when(n.n_regionkey % 4 == 2, "PEST").otherwise("OTHER").alias("alert_type"),
            F.when(k % 3 == 0, F.concat(F.lit("temperature > "), (k % 10 + 25).cast("string"), F.lit(" AND "), wet))
             .when(k % 3 == 1, wet).otherwise('other_sensor = "pest_detected"').alias("condition_expr"),
            F.when(k % 4 == 0, "SEVERE").when(k % 4 == 1, "MODERATE").when(k % 4 == 2, "GENERAL")
             .otherwise("CRITICAL").alias("severity_level"),
            (k % 5 != 2).alias("is_active")), "alert_rules")

    def _t_devices(self):
        s = self.src("supplier")
        k = s.s_suppkey % 4
        return conform(s.select(
            s.s_suppkey.alias("device_id"), s.s_name.alias("device_name"),
            F.when(k == 0, "SENSOR").when(k == 1, "CAMERA").when(k == 2, "ALERTER")
             .otherwise("OTHER").alias("device_type"),
            F.when(s.s_suppkey % 10 == 9, F.lit(None).cast("bigint"))
             .otherwise(s.s_nationkey.cast("bigint")).alias("install_region_id")), "devices")

    def _t_report_templates(self):
        r = self.src("region")
        k = r.r_regionkey % 3
        return conform(r.select(
            (r.r_regionkey + 1).cast("bigint").alias("template_id"),
            r.r_name.alias("template_name"),
            F.when(k == 0, "REGION").when(k == 1, "TIME").otherwise("TYPE").alias("dimension"),
            F.when(k == 0, "DAY").when(k == 1, "WEEK").otherwise("MONTH").alias("cycle"),
            (r.r_regionkey != 3).alias("is_active")), "report_templates")

    def _t_users(self):
        c = self.src("customer")
        return conform(c.select(c.c_custkey.alias("user_id"), c.c_name.alias("real_name")), "users")

    def _t_roles(self):
        r = self.src("region")
        return conform(r.select((r.r_regionkey + 1).cast("bigint").alias("role_id"), r.r_name.alias("role_name")), "roles")

    def _t_permissions(self):
        n = self.src("nation")
        pick = lambda k, values: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
        return conform(n.select(
            (n.n_nationkey + 1).cast("bigint").alias("permission_id"), n.n_name.alias("permission_name"),
            pick(n.n_nationkey % 5, ["alerts", "reports", "sensors", "regions", "devices"]).alias("resource"),
            pick(F.floor(n.n_nationkey / 5), ["manage", "view", "create", "update", "delete"]).alias("action")), "permissions")

    def _t_role_permissions(self):
        n = self.src("nation")
        held = F.array_distinct(F.array((n.n_regionkey + 1).cast("bigint"), (n.n_nationkey * 2 % 5 + 1).cast("bigint")))
        return conform(n.select(F.explode(held).alias("role_id"),
                                (n.n_nationkey + 1).cast("bigint").alias("permission_id")), "role_permissions")

    def _t_user_roles(self):
        c = self.src("customer")
        seg = c.c_mktsegment
        first = c.select(
            c.c_custkey.alias("user_id"),
            F.when(seg == "AUTOMOBILE", 1).when(seg == "BUILDING", 2).when(seg == "FURNITURE", 3)
             .when(seg == "HOUSEHOLD", 4).otherwise(5).cast("bigint").alias("role_id"))
        second = c.filter((c.c_custkey % 3 == 0) & (seg != "HOUSEHOLD")).select(
            c.c_custkey.alias("user_id"), F.lit(4).cast("bigint").alias("role_id"))
        return conform(first.unionByName(second), "user_roles")

    # -- facts --------------------------------------------------------------
    def _t_raw_readings(self):
        e = self.src("events")
        t = e.event_type
        return conform(e.select(
            e.event_id.alias("reading_id"), e.user_id.alias("sensor_id"), e.ts.alias("collected_at"),
            F.when(t == "view", "TEMPERATURE").when(t == "click", "HUMIDITY")
             .when(t == "purchase", "PM25").when(t == "signup", "PM10").otherwise("CO2")
             .alias("reading_type"),
            F.when(t == "view", e.value - 60).otherwise(e.value).cast("decimal(10,2)")
             .alias("numeric_value"),
            F.when(t == "view", "C").when(t == "click", "%").when(t == "error", "ppm")
             .otherwise("ug/m3").alias("value_unit")), "raw_readings").drop("data_status")

    def _t_sensor_readings(self):
        from ..operators.quality import validate_readings
        return validate_readings(self["raw_readings"])

    def _t_login_events(self):
        e = self.src("events")
        return e.select("event_id", "user_id", "ts", e.event_type.isin("view", "purchase").alias("success"))

    def _t_alerts(self):
        o = self.src("orders")
        c = self.src("customer").select("c_custkey", "c_nationkey")
        j = o.join(c, o.o_custkey == c.c_custkey)
        st = j.o_orderstatus
        return conform(j.select(
            j.o_orderkey.alias("alert_id"), (F.lit(1) + j.o_orderkey % 6).cast("bigint").alias("rule_id"),
            j.c_nationkey.cast("bigint").alias("region_id"), j.o_orderdate.alias("triggered_at"),
            j.o_orderpriority.alias("content"),
            F.when(st == "P", "PENDING").when(st == "O", "PROCESSING").otherwise("CLOSED").alias("status"),
            F.when(st == "P", F.lit(None).cast("bigint")).otherwise(j.o_custkey).alias("handler_id")),
            "alerts")

    def _t_live_alerts(self):
        """Events of the kind ``error`` are the alerts; the other kinds are readings only."""
        e = self.src("events")
        c = self.src("customer").select("c_custkey", "c_nationkey")
        j = e.filter(e.event_type == "error").join(c, e.user_id == c.c_custkey)
        return conform(j.select(
            j.event_id.alias("alert_id"), (F.lit(1) + j.event_id % 7).cast("bigint").alias("rule_id"),
            j.c_nationkey.cast("bigint").alias("region_id"), j.ts.alias("triggered_at"),
            F.when(j.event_id % 2 == 0, "PENDING").otherwise("CLOSED").alias("status")), "alerts")

    def _t_lines(self):
        """Every lineitem row with an id of its own; lineitem repeats (order, line number),
        so the rows of one such pair are numbered over all their columns."""
        li = self.src("lineitem")
        nth = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*[
            F.col(c).asc_nulls_last() for c in LINE_COLUMNS]))
        return li.select(
            ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000 + nth).cast("bigint").alias("line_id"), "l_orderkey",
            F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), F.col("l_quantity").alias("qty"),
            F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("rflag"),
            F.col("l_linestatus").alias("lstatus"), F.col("l_shipdate").alias("shipdate"))

    def _t_notifications(self):
        x = self["lines"]
        return conform(x.select(
            x.line_id.alias("notification_id"), x.l_orderkey.alias("alert_id"),
            x.suppkey.alias("receiver_id"),
            F.when(x.lstatus == "O", "SMS").otherwise("SYSTEM").alias("channel"),
            x.shipdate.alias("sent_at"),
            F.when(x.rflag == "R", "DELIVERED").when(x.rflag == "A", "SENT").otherwise("FAILED")
             .alias("receive_status")), "notifications")

    def _t_resources(self):
        p = self.src("part")
        even = p.p_size % 2 == 0
        k = p.p_size % 3
        return conform(p.select(
            p.p_partkey.alias("resource_id"),
            F.when(even, "TREE").otherwise("GRASS").alias("resource_type"),
            (p.p_partkey % 20).alias("region_id"), p.p_name.alias("species_name"),
            F.when(even, p.p_size).alias("quantity"),
            F.when(p.p_size % 2 == 1, p.p_retailprice.cast("decimal(12,2)")).alias("area"),
            F.when(k == 0, "SEEDLING").when(k == 1, "GROWING").otherwise("MATURE").alias("growth_stage")),
            "resources")

    def _t_resources_next(self):
        """A later version of resources (input of change capture and upserts)."""
        r = self["resources"]
        mx = r.agg(F.max("resource_id").alias("mx"))
        changed = r.select(
            "resource_id", "resource_type", "region_id", "species_name",
            F.when(r.resource_id % 5 == 0, r.quantity + 1).otherwise(r.quantity).alias("quantity"),
            F.when(r.resource_id % 7 == 0, r.area - 1).otherwise(r.area).cast("decimal(12,2)").alias("area"),
            F.when(r.resource_id % 11 == 0,
                   F.when(r.growth_stage == "SEEDLING", "GROWING").when(r.growth_stage == "GROWING", "MATURE")
                    .otherwise("SEEDLING")).otherwise(r.growth_stage).alias("growth_stage"))
        added = mx.select(F.explode(F.sequence(F.col("mx") + 1, F.col("mx") + 10)).alias("resource_id")) \
            .select("resource_id", F.lit("TREE").alias("resource_type"),
                    (F.col("resource_id") % 20).alias("region_id"),
                    F.concat(F.lit("new planting "), F.col("resource_id").cast("string")).alias("species_name"),
                    (F.col("resource_id") % 50).cast("int").alias("quantity"),
                    F.lit(None).cast("decimal(12,2)").alias("area"),
                    F.lit("SEEDLING").alias("growth_stage"))
        return conform(changed.unionByName(added), "resources")

    def _t_resource_changes(self):
        x = self["lines"]
        return conform(x.select(
            x.line_id.alias("change_id"), x.partkey.alias("resource_id"),
            F.when(x.rflag == "A", "ADD").when(x.rflag == "R", "REDUCE").otherwise("STATUS_UPDATE")
             .alias("change_type"),
            F.when(x.rflag != "N", x.qty.cast("int")).alias("change_amount"),
            F.when(x.rflag != "N", x.price.cast("decimal(12,2)")).alias("change_area"),
            x.shipdate.alias("changed_at"), x.suppkey.alias("operator_id")), "resource_changes")

    def _t_device_status_logs(self):
        x = self["lines"]
        return conform(x.select(
            x.line_id.alias("log_id"), x.suppkey.alias("device_id"), x.shipdate.alias("collected_at"),
            F.when(x.rflag == "N", "NORMAL").when(x.rflag == "R", "FAULT").otherwise("OFFLINE")
             .alias("run_status"),
            F.when(x.lstatus == "O", x.qty.cast("int") * 2).alias("battery_percent"),
            x.qty.cast("int").alias("signal_strength")), "device_status_logs")

    def _t_maintenance_records(self):
        o = self.src("orders")
        dev = F.floor(o.o_custkey / 15).cast("bigint")
        dev = F.when(dev % 10 == 0, dev + 1).otherwise(dev)  # devices 0, 10, 20, ... have no record
        st = o.o_orderstatus
        return conform(o.select(
            o.o_orderkey.alias("maintenance_id"), dev.alias("device_id"),
            F.when(st == "P", "INSPECTION").when(st == "O", "REPAIR").otherwise("REPLACE")
             .alias("maintenance_type"),
            o.o_orderdate.alias("maintenance_time"), o.o_custkey.alias("maintainer_id"),
            o.o_orderpriority.alias("content")), "maintenance_records")

    def _t_reports(self):
        o = self.src("orders")
        return conform(o.select(
            o.o_orderkey.alias("report_id"), (F.lit(1) + o.o_orderkey % 4).cast("bigint").alias("template_id"),
            o.o_orderdate.cast("date").cast("string").alias("period"),
            o.o_orderdate.alias("generated_at")), "reports")


def driver_tables(spark: SparkSession, sf_dir: str) -> DriverTables:
    return DriverTables(spark, sf_dir)
