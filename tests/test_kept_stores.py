"""Kept statistics, key indexes and clustered readings: batches, failures and what is read."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from envmon.operators import lifecycle, stats
from envmon.sources import clustered, ingest, key_index, summary, versioned

READINGS = ("reading_id BIGINT, sensor_id BIGINT, collected_at TIMESTAMP_NTZ, reading_type STRING, numeric_value DECIMAL(10,2), "
            "value_unit STRING, data_status STRING")
T0 = dt.datetime(2024, 1, 1)


def readings(rng, n, first, days, start=0):
    return [(first + i, rng.choice([10, 10, 10, 11, 12, 13, 99]), T0 + dt.timedelta(days=start + rng.randint(0, days - 1), seconds=rng.randint(0, 86399)),
             rng.choice(["TEMPERATURE", "HUMIDITY", "PM25"]), rng.choice([None, D("1.10"), D("-3.00"), D("99.99")]), rng.choice(["C", "%", None]),
             rng.choice(["VALID", "VALID", "INVALID"])) for i in range(n)]


def same(a, b):
    return a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_kept_statistics_after_late_and_repeated_batches(spark, mini, tmp_dir, monkeypatch):
    rng, path, seen = random.Random(1), f"{tmp_dir}/s", []
    batches = [readings(rng, 200, 0, 5, 3), readings(rng, 100, 1000, 2, 0), readings(rng, 50, 2000, 1, 9) + [(5000, 10, None, "TEMPERATURE", D("5.00"), "C", "VALID")],
               readings(rng, 120, 3000, 4, 2)]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, READINGS)
        before = versioned.state(spark, path).parts
        touched = summary.merge_batch(df, path, f"b{i}")
        seen += rows
        after = versioned.state(spark, path).parts
        assert set(touched) == {r[2] and r[2].date() for r in rows}
        assert all(after[d] == before[d] for d in before if d not in set(map(versioned.part_name, touched)))  # other days keep their version
        assert summary.merge_batch(df, path, f"b{i}") == [] and versioned.state(spark, path).parts == after
        kept, t = summary.read_summary(spark, path), {**mini, "sensor_readings": spark.createDataFrame(seen, READINGS)}
        assert same(summary.region_daily_averages(kept, t, 30, "2024-01-20"), stats.region_daily_averages(t, 30, as_of="2024-01-20"))
        assert same(summary.environment_trend(kept, t, 12, "2024-01-20"), stats.environment_trend(t, 12, as_of="2024-01-20"))
        assert same(summary.monthly_stats(kept, t), stats.monthly_stats(t))
        assert same(summary.sensor_data_summary(kept, t), stats.sensor_data_summary(t))


def test_a_merge_that_fails_before_its_commit_is_done_again(spark, mini, tmp_dir, monkeypatch):
    from pyspark.sql import DataFrameWriter
    rng, path, write = random.Random(2), f"{tmp_dir}/s", DataFrameWriter.parquet
    one, two = (spark.createDataFrame(readings(rng, 80, 1000 * i, 3), READINGS) for i in range(2))
    summary.merge_batch(one, path, "one")

    def crash(self, at, *a, **k):
        if "_manifest" in at:
            raise OSError("lost")
        return write(self, at, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", crash)
    with pytest.raises(OSError):
        summary.merge_batch(two, path, "two")
    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    t = {**mini, "sensor_readings": one}
    assert same(summary.monthly_stats(summary.read_summary(spark, path), t), stats.monthly_stats(t))
    assert summary.merge_batch(two, path, "two")
    t = {**mini, "sensor_readings": one.unionByName(two)}
    assert same(summary.monthly_stats(summary.read_summary(spark, path), t), stats.monthly_stats(t))
    assert summary.read_summary(spark, f"{tmp_dir}/none").count() == 0


def test_batch_check_equals_the_full_check(spark, tmp_dir):
    ddl = "alert_id BIGINT, rule_id BIGINT, region_id BIGINT, status STRING"
    regions, rules = spark.range(1, 5).toDF("region_id"), spark.range(1, 4).toDF("rule_id")
    base = spark.createDataFrame([(i, i % 3 + 1, i % 4 + 1, "PENDING") for i in range(500)], ddl)
    more = spark.createDataFrame([(i, 1, 1, "CLOSED") for i in range(500, 520)], ddl)
    batch = spark.createDataFrame([(7, 1, 1, "PENDING"), (7, 1, 1, "PENDING"), (510, 1, 1, "CLOSED"), (900, 9, 1, "OPEN"), (901, 9, 77, None),
                                   (902, None, None, "PENDING"), (903, 1, 1, "CLOSED"), (903, 1, 1, "CLOSED"), (None, 1, 1, "PENDING")], ddl)
    full = lambda a: lifecycle.constraint_violations({"alerts": a, "regions": regions, "alert_rules": rules},
                                                     {"alerts": ["alert_id", "rule_id", "region_id", "status"], "regions": ["region_id"], "alert_rules": ["rule_id"]})
    indexes = {(n, (k,)): key_index.build_index(df, [k], f"{tmp_dir}/{n}", buckets=4)
               for n, df, k in (("alerts", base, "alert_id"), ("regions", regions, "region_id"), ("alert_rules", rules, "rule_id"))}
    assert full(base.unionByName(more)).count() == 0
    assert key_index.batch_violations(more, "alerts", indexes).count() == 0
    key_index.add_to_index(more, indexes["alerts", ("alert_id",)])
    got = key_index.batch_violations(batch, "alerts", indexes)
    assert same(got, full(base.unionByName(more).unionByName(batch))) and got.count() == 6
    # opened anew, as a later session does
    a = indexes["alerts", ("alert_id",)]
    spark.sql(f"DROP TABLE {a.name}")
    again = key_index.open_index(spark, a.path, {"alert_id": "BIGINT"}, 4)
    got = key_index.batch_violations(batch, "alerts", indexes | {("alerts", ("alert_id",)): again})
    assert got.count() == 6
    with pytest.raises(KeyError):
        key_index.batch_violations(batch, "alerts", {})


def test_batch_check_shuffles_the_batch_only(spark, tmp_dir):
    base = spark.range(0, 200_000).toDF("alert_id")
    index = key_index.build_index(base, ["alert_id"], f"{tmp_dir}/a", buckets=4)
    for name, value in (("autoBroadcastJoinThreshold", "-1"), ("adaptive.enabled", "false")):
        spark.conf.set(f"spark.sql.{name}", value)
    try:
        batch = spark.range(199_990, 200_010).toDF("alert_id")
        got = key_index.batch_violations(batch, "alerts", {("alerts", ("alert_id",)): index}, columns=["alert_id"])
        assert got.count() == 10

        def above_scan(plan, names=()):
            """Names of the operators between the join and the scan of the index."""
            name = plan.nodeName()
            if "parquet" in name:
                return names
            kids = [plan.children().apply(i) for i in range(plan.children().size())]
            return next((x for k in kids if (x := above_scan(k, () if "Join" in name else (*names, name))) is not None), None)

        path = above_scan(got._jdf.queryExecution().executedPlan())
        assert path is not None and not any("Exchange" in n for n in path), path
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def rows_scanned(df):
    """Rows that the file scans of a finished query gave out."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    leaves = [plan.executedPlan()] if "AdaptiveSparkPlan" in plan.getClass().getName() else [plan]
    while leaves:
        p = leaves.pop()
        if "QueryStage" in p.getClass().getName():
            leaves.append(p.plan())
        elif "FileSourceScan" in p.getClass().getName():
            total += p.metrics().apply("numOutputRows").value()
        kids = p.children()
        leaves += [kids.apply(i) for i in range(kids.size())]
    return total


def test_clustered_readings_are_pruned(spark, tmp_dir):
    rows = spark.range(0, 200_000).select(
        F.col("id").alias("reading_id"), F.pmod(F.hash(F.col("id") * 3 + 1), F.lit(200)).cast("bigint").alias("sensor_id"),
        (F.lit(T0) + F.make_dt_interval(secs=F.pmod(F.hash("id"), F.lit(10 * 86400)))).cast("timestamp_ntz").alias("collected_at"),
        F.lit("TEMPERATURE").alias("reading_type"), F.lit(D("1.00")).cast("decimal(10,2)").alias("numeric_value"), F.lit("C").alias("value_unit"),
        F.lit("VALID").alias("data_status"))
    plain = ingest.ingest_readings(rows, f"{tmp_dir}/plain", start=1, files_per_day=8)
    apart = clustered.write_clustered(rows, f"{tmp_dir}/apart", files=80)
    want = [r.reading_id for r in stats.latest_readings({"sensor_readings": rows}, 700, [17]).orderBy("rank").collect()]
    got = clustered.latest_of_sensor(spark, apart, 17, 700)
    assert [r.reading_id for r in got.orderBy("rank").collect()] == want and len(want) == 700
    one = lambda p: spark.read.parquet(p).where("sensor_id = 17")
    assert one(plain).count() == one(apart).count()
    before, after = rows_scanned(one(plain)), rows_scanned(one(apart))
    files = [spark.read.parquet(p).where("sensor_id = 17").select(F.input_file_name()).distinct().count() for p in (plain, apart)]
    assert after * 5 < before and files[1] * 2 < files[0], (before, after, files)  # 200,000 rows in 28 files, 22,212 in 10
    assert clustered.latest_of_sensor(spark, apart, -1, 10).count() == 0
    few = clustered.latest_of_sensor(spark, apart, 17, 20)
    assert rows_scanned(few) < after  # the newest day was enough


def test_upsert_reads_and_writes_touched_parts_only(spark, tmp_dir):
    ddl, path = "id BIGINT, name STRING, amount INT", f"{tmp_dir}/t"
    base = spark.createDataFrame([(i, f"n{i}", i) for i in range(200)] + [(None, "lost", 1)], ddl)
    versioned.create(base, path, ["id"], parts=16)
    want = {r.id: (r.name, r.amount) for r in base.collect()}
    for changes in ([(3, 30, 1), (3, 31, 2), (3, 29, 0), (999, 1, 1), (None, 5, 1)], [(7, None, 1)], [(888, 1, 1)], []):
        before = versioned.state(spark, path)
        df = spark.createDataFrame(changes, "id BIGINT, amount INT, seq INT")
        unmatched = versioned.upsert(df, path, ddl, ["id"], parts=16, order_by="seq")
        whole, missing = lifecycle.upsert_snapshot(spark.createDataFrame([(k, *v) for k, v in want.items()], ddl), df, "id", order_by="seq")
        now = versioned.open_table(spark, path, ddl)
        assert same(now, whole) and same(unmatched, missing)
        want = {r.id: (r.name, r.amount) for r in now.collect()}
        after = versioned.state(spark, path)
        assert sum(after.parts[p] != v for p, v in before.parts.items()) <= len({c[0] for c in changes}) and set(after.parts) == set(before.parts)
    assert want[3] == ("n3", 31) and want[7] == ("n7", None) and want[None] == ("lost", 1)
