"""Streams against the batch operators, over several micro-batches in mixed order."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from envmon.operators import interval
from envmon.streaming import nearby
from envmon.streaming.streams import run_to_end

T0 = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)


def write_files(spark, folder, ddl, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{folder}/b{i}")
        time.sleep(0.05)


def stream_of(spark, folder, ddl):
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


READINGS = "reading_id BIGINT, sensor_id BIGINT, region_id BIGINT, collected_at TIMESTAMP_NTZ, data_status STRING"
ALERTS = "alert_id BIGINT, rule_id BIGINT, region_id BIGINT, triggered_at TIMESTAMP_NTZ, content STRING, status STRING, handler_id BIGINT, handle_result STRING"


@pytest.mark.parametrize("same_region", [False, True])
def test_alerts_near_readings_of_two_streams(spark, tmp_dir, same_region):
    rng, half_hour = random.Random(4), dt.timedelta(minutes=30)
    batches = 6
    dealt = {"r": [[] for _ in range(batches)], "a": [[] for _ in range(batches)]}

    def deal(kind, at, row):  # up to four minutes late
        k = int((at + dt.timedelta(seconds=rng.randint(0, 240)) - T0) / half_hour)
        dealt[kind][min(k, batches - 1)].append(row)

    for i in range(1500):
        at = T0 + dt.timedelta(seconds=rng.randint(0, 10799), microseconds=rng.randint(0, 999999))
        region = rng.randint(1, 3)
        deal("r", at, (i, region, region, at, "INVALID" if rng.random() < 0.02 else "VALID"))
    bad = [r for rows in dealt["r"] for r in rows if r[4] == "INVALID"]
    for i in range(300):
        at = T0 + dt.timedelta(seconds=rng.randint(0, 10799))
        if i < 60:  # exactly at the edges of a window
            r = rng.choice(bad)
            at = r[3] + rng.choice([-1, 1]) * dt.timedelta(minutes=5, microseconds=rng.choice([0, 1]))
        if T0 <= at < T0 + 6 * half_hour:
            deal("a", at, (i, 1, rng.randint(1, 3), at, None, "PENDING", None, None))
    every_r, every_a = [r for b in dealt["r"] for r in b], [r for b in dealt["a"] for r in b]
    write_files(spark, f"{tmp_dir}/r", READINGS, [*dealt["r"], [(-1, 1, 1, T0 + DAY, "VALID")], [(-2, 1, 1, T0 + 2 * DAY, "VALID")]])
    write_files(spark, f"{tmp_dir}/a", ALERTS, [*dealt["a"], [(-1, 1, 1, T0 + DAY, None, "x", None, None)], [(-2, 1, 1, T0 + 2 * DAY, None, "x", None, None)]])
    q = nearby.start_alerts_near_readings(stream_of(spark, f"{tmp_dir}/a", ALERTS), stream_of(spark, f"{tmp_dir}/r", READINGS), "INVALID",
                                          f"{tmp_dir}/sink", f"{tmp_dir}/ckpt", same_region=same_region)
    run_to_end(q)
    got = sorted(r.alert_id for r in spark.read.parquet(f"{tmp_dir}/sink").collect())
    sensors = spark.createDataFrame([(i, i, "m", "TEMPERATURE") for i in (1, 2, 3)], "sensor_id BIGINT, region_id BIGINT, model STRING, monitor_type STRING")
    tables = {"sensor_readings": spark.createDataFrame(every_r, READINGS).drop("region_id"), "sensors": sensors,
              "regions": spark.createDataFrame([(i, f"r{i}") for i in (1, 2, 3)], "region_id BIGINT, region_name STRING")}
    alerts = spark.createDataFrame(every_a, ALERTS)
    want = sorted(r.alert_id for r in interval.alerts_near_readings(alerts, tables, "INVALID", same_region).collect())
    near = lambda a, r: abs(a[3] - r[3]) <= dt.timedelta(minutes=5) and (not same_region or a[2] == r[2])
    assert got == want == sorted(a[0] for a in every_a if any(near(a, r) for r in bad)) and 30 < len(got) < len(every_a)
    held = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
    assert max(held) < 11 * len(every_a) and held[-1] < 20  # what is kept is forgotten behind the watermark


# -- R4 ------------------------------------------------------------------------
VERSIONS = "resource_id BIGINT, version BIGINT, quantity INT, area DECIMAL(12,2), growth_stage STRING"


def test_resource_changes_between_versions(spark, tmp_dir):
    """Versions 1 to 4 in four files: one late, one repeated, an older one after a newer one; nulls on either side."""
    from decimal import Decimal as D

    from envmon.operators import resources
    from envmon.streaming import keyed
    rng = random.Random(8)
    rows = {v: [(i, v, rng.choice([None, 1, 2]), rng.choice([None, D("1.50"), D("2.25")]), rng.choice([None, "A", "B"]))
                for i in range(40) if v > 1 or i < 30] for v in (1, 2, 3, 4)}
    files = [rows[1], rows[2] + rows[1][:10], rows[3][:20] + rows[2] + rows[3][20:] + rows[3][:5],
             rows[4] + [(99, None, 1, None, "A"), (None, 5, 1, None, "A")], rows[2] + rows[4]]
    write_files(spark, f"{tmp_dir}/v", VERSIONS, files)
    run_to_end(keyed.start_resource_changes(stream_of(spark, f"{tmp_dir}/v", VERSIONS), f"{tmp_dir}/sink", f"{tmp_dir}/ckpt"))
    out = spark.read.parquet(f"{tmp_dir}/sink")
    names = ["resource_id", "change_type", "change_reason", "change_amount", "change_area"]
    for v in (2, 3, 4):
        old, new = (spark.createDataFrame(rows[x], VERSIONS).drop("version") for x in (v - 1, v))
        want = resources.capture_resource_changes(old, new).select(*names).collect()
        assert sorted(map(str, out.where(F.col("version") == v).select(*names).collect())) == sorted(map(str, want)) and want
    assert out.where("version = 1").count() == 30 and out.where("version = 1 AND change_type <> 'ADD'").count() == 0


def test_resources_share_a_fixed_number_of_state_keys(spark, tmp_dir):
    """500 resources in 8 buckets over three files: the changes are the batch operator's, the state is 8 rows."""
    from decimal import Decimal as D

    from envmon.operators import resources
    from envmon.streaming import keyed
    rng = random.Random(9)
    rows = {v: [(i * 7919 - 100000, v, rng.choice([None, 1, 2]), rng.choice([None, D("1.50")]), rng.choice([None, "A", 'é"']))
                for i in range(500)] for v in (1, 2, 3)}
    write_files(spark, f"{tmp_dir}/v", VERSIONS, [rows[1][:300], rows[2][:300] + rows[1][300:], rows[2][300:] + rows[3] + rows[1]])
    q = keyed.start_resource_changes(stream_of(spark, f"{tmp_dir}/v", VERSIONS), f"{tmp_dir}/sink", f"{tmp_dir}/ckpt", buckets=8)
    run_to_end(q)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 8
    out = spark.read.parquet(f"{tmp_dir}/sink")
    names = ["resource_id", "change_type", "change_reason", "change_amount", "change_area"]
    for v in (2, 3):
        old, new = (spark.createDataFrame(rows[x], VERSIONS).drop("version") for x in (v - 1, v))
        want = resources.capture_resource_changes(old, new).select(*names).collect()
        assert sorted(map(str, out.where(F.col("version") == v).select(*names).collect())) == sorted(map(str, want)) and want
    assert out.where("version = 1").count() == 500


# -- R5 ------------------------------------------------------------------------
def test_maintenance_timers_at_every_stop_equal_the_batch_operator(spark, tmp_dir, mini):
    """Records in mixed order; the stream stops after each file and the standing reminders are those of its date."""
    from envmon.operators import devices
    from envmon.streaming import keyed
    rng, records = random.Random(2), "maintenance_id BIGINT, device_id BIGINT, maintenance_time TIMESTAMP_NTZ"
    ids = list(range(1, 9))
    placed = spark.createDataFrame([(i, f"d{i}", "SENSOR", 1) for i in ids], "device_id BIGINT, device_name STRING, device_type STRING, install_region_id BIGINT")
    tables = {"devices": placed, "regions": mini["regions"]}
    placed.select("device_id").coalesce(1).write.parquet(f"{tmp_dir}/d")
    batches = []
    for month in range(5):
        rows = [(100 * month + k, rng.choice(ids[:7] + [77]), T0 + (40 * month + rng.randint(-60, 30)) * DAY + dt.timedelta(hours=rng.choice([0, 0, 13])))
                for k in range(4)]
        batches.append(rows + [(100 * month + 50, None, T0 + 40 * month * DAY), (100 * month + 51, 1, None),
                               (100 * month + 52, 7, T0 + 40 * month * DAY)])
    seen = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, records).coalesce(1).write.parquet(f"{tmp_dir}/r/b{n}")
        seen += rows
        reads = [spark.readStream.schema(s).option("recursiveFileLookup", "true").parquet(f"{tmp_dir}/{p}")
                 for p, s in (("d", "device_id BIGINT"), ("r", records))]
        q = keyed.start_maintenance_news(*reads, f"{tmp_dir}/sink", f"{tmp_dir}/ckpt")
        run_to_end(q)
        at = keyed.watermark_date(q)
        assert at == max(t for _, d, t in seen if d is not None and t is not None).date()
        got = keyed.devices_due(spark.read.parquet(f"{tmp_dir}/sink"), tables, at)
        want = devices.maintenance_due({**tables, "maintenance_records": spark.createDataFrame(seen, records)}, as_of=at)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert 8 in {r.device_id for r in got.collect()}
    assert {r.news for r in spark.read.parquet(f"{tmp_dir}/sink").collect()} == {"DUE", "DONE"}
