"""Tests in the shape of the source's own test suite: rights, error paths, cascades, timing,
plus stream semantics (late and repeated readings)."""

import datetime as dt
import time
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from envmon.operators import access, filters, lifecycle, stats
from envmon.operators.lifecycle import CASCADE
from envmon.schemas import FOREIGN_KEYS, PRIMARY_KEYS, conform
from envmon.session import new_path
from envmon.sources import ingest
from envmon.sources.driver import driver_tables
from envmon.streaming import streams
from tests.conftest import SF_SMALL


def test_five_roles_and_rights_order(mini):
    assert [r["role_name"] for r in filters.list_roles(mini).collect()] == [
        "SYSTEM_ADMIN", "DATA_ADMIN", "FOREST_GUARD", "PUBLIC_USER", "INSPECTOR"]
    n = {r["role_id"]: r["n"] for r in access.role_permissions(mini).groupBy("role_id").count()
         .withColumnRenamed("count", "n").collect()}
    assert n[2] > n[4]  # DATA_ADMIN has more rights than PUBLIC_USER


def test_error_paths_are_reported_not_raised(mini, spark):
    found, missing = filters.lookup_keys(mini["sensors"], spark.createDataFrame([(404,)], "sensor_id BIGINT"),
                                         "sensor_id")
    assert found.count() == 0 and [r["sensor_id"] for r in missing.collect()] == [404]
    out, unmatched = lifecycle.upsert_snapshot(mini["regions"], spark.createDataFrame(
        [(404, "nowhere")], "region_id BIGINT, region_name STRING"), "region_id")
    assert out.count() == mini["regions"].count() and unmatched.count() == 1


@pytest.mark.parametrize("parent", sorted(CASCADE))
def test_cascade_every_parent(mini, spark, parent):
    if parent not in mini:
        pytest.skip("table not in the mini set")
    pk = PRIMARY_KEYS[parent][0]
    keys = mini[parent].select(pk).dropDuplicates().limit(1)  # delete one parent row
    rem, counts = lifecycle.cascade_delete(mini, parent, keys)
    assert dict((r["table_name"], r["removed"]) for r in counts.collect())[parent] == 1
    # no remaining child row refers to a removed parent
    for child, fk, pkey in CASCADE[parent]:
        if child not in rem:
            continue
        gone = mini[parent].join(rem[parent], PRIMARY_KEYS[parent], "left_anti").select(F.col(pkey).alias(fk))
        assert rem[child].join(gone, fk, "left_semi").count() == 0


def test_foreign_key_map_covers_cascades():
    for parent, edges in CASCADE.items():
        for child, fk, pkey in edges:
            assert (fk, parent, pkey) in [(f, p, k) for f, p, k, _ in FOREIGN_KEYS[child]]


def test_timing_limits(spark):
    """Batch insert of 100 readings < 5 s; newest 1,000 readings of one sensor < 3 s (warm)."""
    t = driver_tables(spark, SF_SMALL)
    batch = t["raw_readings"].limit(100).withColumn("reading_id", F.lit(None).cast("bigint"))
    batch = spark.createDataFrame(batch.collect(), batch.schema)
    best_ins, best_read = 1e9, 1e9
    for _ in range(2):
        t0 = time.perf_counter()
        ingest.ingest_readings(batch, new_path(spark, "ingest-test"), base=t["raw_readings"])
        best_ins = min(best_ins, time.perf_counter() - t0)
        t0 = time.perf_counter()
        stats.latest_readings(t, n=1000, sensor_ids=[1]).collect()
        best_read = min(best_read, time.perf_counter() - t0)
    assert best_ins < 5.0 and best_read < 3.0


def test_stream_drops_repeats_and_late_readings(spark, tmp_dir, mini):
    """Second micro-batch repeats an alerting reading; a third one brings a reading older than the watermark."""
    ddl = ("reading_id BIGINT, sensor_id BIGINT, collected_at TIMESTAMP_NTZ, reading_type STRING, "
           "numeric_value DECIMAL(10,2), value_unit STRING")
    t0 = dt.datetime(2024, 1, 20, 12, 0, 0)
    first = [(1, 10, t0, "TEMPERATURE", D("40.00"), "C"),                       # FIRE
             (2, 11, t0 + dt.timedelta(minutes=10), "HUMIDITY", D("10.00"), "%"),  # DROUGHT, watermark -> 12:05
             (3, 10, t0 + dt.timedelta(minutes=1), "TEMPERATURE", D("20.00"), "C")]
    second = [(1, 10, t0, "TEMPERATURE", D("40.00"), "C"),                      # repeat: dropped
              (5, 10, t0 + dt.timedelta(minutes=12), "TEMPERATURE", D("41.00"), "C")]  # on time: kept
    # late rows are filtered with the previous batch's watermark (Spark >= 3.4), so the
    # too-late reading comes in a third batch, when 12:05 already applies
    third = [(4, 10, t0 - dt.timedelta(hours=1), "TEMPERATURE", D("45.00"), "C")]  # too late: dropped
    src = f"{tmp_dir}/src"
    for name, rows in (("b1", first), ("b2", second), ("b3", third)):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{src}/{name}")
        time.sleep(1.1)
    raw = (spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
           .parquet(src))
    from envmon.operators.quality import validate_readings
    readings = validate_readings(conform(raw, "raw_readings").drop("data_status"))
    sink, ckpt = new_path(spark, "sink"), new_path(spark, "ckpt")
    streams.run_to_end(streams.start_alerts(readings, mini, sink, ckpt))
    got = sorted(r["reading_id"] for r in spark.read.parquet(sink).collect())
    assert got == [1, 2, 5]


def test_stream_lock_state_times_out(spark, tmp_dir):
    ddl = "event_id BIGINT, user_id BIGINT, ts TIMESTAMP_NTZ, success BOOLEAN"
    d1 = dt.datetime(2024, 1, 1, 10, 0, 0)
    batches = [
        [(i, 7, d1 + dt.timedelta(minutes=i), False) for i in range(5)]      # user 7 locked until 11:04
        + [(10, 8, d1, False)],                                              # user 8: one pending failure
        [(20, 9, d1 + dt.timedelta(days=2), True)],                          # moves event time two days on
    ]
    src = f"{tmp_dir}/logins"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{src}/b{i}")
        time.sleep(1.1)
    ev = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    sink, ckpt = new_path(spark, "sink"), new_path(spark, "ckpt")
    streams.run_to_end(streams.start_lockouts(ev, sink, ckpt))
    # only user 8 (a failure) and user 9 (its attempt still waits) keep a state: the lock of user 7 has ended
    from envmon.streaming import lockout_stream as L
    assert sorted((r.user_id, r.failures, r.locked_until) for r in L.user_states(spark, ckpt).collect()) == [(8, 1, None), (9, 0, None)]
    assert [r.event_id for r in L.waiting_attempts(spark, ckpt).collect()] == [20]
    streams.finish_lockouts(spark, sink, ckpt)
    out = {r["event_id"]: r["outcome"] for r in streams.read_lockouts(spark, sink).collect()}
    assert out[4] == "LOCKED" and out[20] == "SUCCESS"


def _shuffled_events(spark, folder, files):
    from pyspark.sql import functions as F
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for i in range(files):  # mixed times in every file
        src.where(F.pmod(F.xxhash64("event_id"), F.lit(files)) == i).coalesce(1).write.mode("append").parquet(
            f"{folder}/events.parquet")
        time.sleep(0.02)
    for t in ("customer", "nation"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")


@pytest.mark.parametrize("options", [{}, {"maxFilesPerTrigger": "1"}])
def test_stream_lockouts_lose_no_attempt(spark, tmp_dir, options):
    from envmon.operators.access import login_lockouts
    _shuffled_events(spark, tmp_dir, 5)
    t = streams.StreamTables(spark, tmp_dir, options)
    sink, ckpt = new_path(spark, "sink"), new_path(spark, "ckpt")
    streams.run_to_end(streams.start_lockouts(t["login_events"], sink, ckpt))
    streams.finish_lockouts(spark, sink, ckpt)
    rows = streams.read_lockouts(spark, sink).collect()
    late = {r.event_id for r in rows if r.outcome == "LATE"}
    out = {r.event_id: (r.outcome, r.failed_attempts) for r in rows if r.outcome != "LATE"}
    assert bool(late) == bool(options)
    from envmon.sources.driver import driver_tables
    every = driver_tables(spark, "/root/testdata/sf0.001")["login_events"]
    assert len(rows) == every.count() and late | set(out) == {r.event_id for r in every.collect()}
    on_time = every.where(~every.event_id.isin(list(late)))
    assert out == {r.event_id: (r.outcome, r.failed_attempts) for r in login_lockouts(on_time).collect()}


def test_stream_reads_a_folder_of_part_files(spark, tmp_dir):
    _shuffled_events(spark, tmp_dir, 8)
    t = streams.StreamTables(spark, tmp_dir)
    sink, ckpt = new_path(spark, "sink"), new_path(spark, "ckpt")
    streams.run_to_end(streams.start_validation(t["raw_readings"], sink, ckpt))
    assert spark.read.parquet(sink).count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_snapshot_of_an_opened_store(spark, mini, tmp_dir):
    from envmon.sources import snapshot as S
    from envmon.sources.tables import load_tables, save_tables
    save_tables({t: mini[t] for t in ("regions", "sensors", "alerts")}, f"{tmp_dir}/store")
    store = load_tables(spark, f"{tmp_dir}/store")
    assert list(store) == ["regions", "sensors", "alerts"] and len(store) == 3
    old = S.snapshot(store, f"{tmp_dir}/copies", dt.datetime(2024, 1, 1))
    new = S.snapshot(load_tables(spark, f"{tmp_dir}/store"), f"{tmp_dir}/copies", dt.datetime(2024, 1, 20))
    back = S.restore(spark, new)
    for t in store:
        assert sorted(map(str, back[t].collect())) == sorted(map(str, store[t].collect()))
    gone = S.remove_expired(spark, f"{tmp_dir}/copies", dt.datetime(2024, 1, 21))
    assert len(gone) == 1 and gone[0].endswith(old.rsplit("/", 1)[1])
    assert [p.endswith("20240120_000000") for p, _ in S.list_snapshots(spark, f"{tmp_dir}/copies")] == [True]
    with pytest.raises(ValueError):
        S.snapshot(load_tables(spark, f"{tmp_dir}/nothing"), f"{tmp_dir}/copies")


def test_constraints_of_an_opened_store_and_keys_with_commas(spark, mini, tmp_dir):
    from envmon.sources.tables import load_tables, save_tables
    twice = mini["regions"].unionByName(mini["regions"].limit(1))
    save_tables({"regions": twice}, f"{tmp_dir}/store")
    found = lifecycle.constraint_violations(load_tables(spark, f"{tmp_dir}/store")).collect()
    assert {(r.kind, r.n) for r in found if r.constraint_name == "(region_id)"} == {("DUPLICATE_KEY", 2)}
    p = spark.createDataFrame([(1, "x", "a,b", "c"), (2, "y", "a", "b,c")],
                              "permission_id BIGINT, permission_name STRING, resource STRING, action STRING")
    assert lifecycle.constraint_violations({"permissions": p}).count() == 0


def test_trend_over_two_units_is_one_row_per_day(spark, mini):
    from envmon.operators import stats
    rows = [(1, 10, dt.datetime(2024, 1, 1, 8), "TEMPERATURE", 10.0, "C", "VALID"),
            (2, 10, dt.datetime(2024, 1, 1, 9), "TEMPERATURE", 50.0, "F", "VALID"),
            (3, 10, dt.datetime(2024, 1, 2, 9), "TEMPERATURE", 20.0, "C", "VALID")]
    r = spark.createDataFrame(rows, "reading_id BIGINT, sensor_id BIGINT, collected_at TIMESTAMP_NTZ, reading_type STRING, "
                                    "numeric_value DOUBLE, value_unit STRING, data_status STRING")
    r = r.withColumn("numeric_value", r.numeric_value.cast("decimal(10,2)"))
    got = stats.trend_analysis({**mini, "sensor_readings": r}).collect()
    assert sorted((str(x.date), x.avg_value, x.change_value) for x in got) == [
        ("2024-01-01", 30.0, None), ("2024-01-02", 20.0, -10.0)]


def test_report_of_one_template(mini):
    from envmon.operators import reports
    every = reports.generate_reports(mini, as_of="2024-02-01")
    some = {r.template_id for r in every.collect()}
    one = min(some)
    got = reports.generate_reports(mini, as_of="2024-02-01", template_id=one)
    assert {r.template_id for r in got.collect()} == {one}
    assert got.count() == every.where(every.template_id == one).count()
    assert reports.generate_reports(mini, as_of="2024-02-01", template_id=999).count() == 0


def test_ingest_goes_on_from_the_kept_mark(spark, tmp_dir):
    from envmon.sources import ingest
    ddl = "reading_id BIGINT, sensor_id BIGINT, collected_at TIMESTAMP_NTZ, reading_type STRING, numeric_value DECIMAL(10,2)"
    batch = [(None, 1, dt.datetime(2024, 1, 1 + i), "TEMPERATURE", None) for i in range(3)]
    base = spark.createDataFrame([(41,)], "reading_id BIGINT")
    for _ in range(2):
        ingest.ingest_readings(spark.createDataFrame(batch, ddl), f"{tmp_dir}/r", base=base)
    assert sorted(r.reading_id for r in spark.read.parquet(f"{tmp_dir}/r").collect()) == [42, 43, 44, 45, 46, 47]
    assert ingest.high_water(spark, f"{tmp_dir}/r") == 47


def test_an_ingest_that_fails_hands_no_id_out_twice(spark, tmp_dir, monkeypatch):
    """The rows of a batch are written, or not, after its ids are reserved; the next batch goes on behind them."""
    from pyspark.sql import DataFrameWriter
    from envmon.sources import ingest
    ddl = "reading_id BIGINT, sensor_id BIGINT, collected_at TIMESTAMP_NTZ, reading_type STRING, numeric_value DECIMAL(10,2)"
    batch = lambda *ids: spark.createDataFrame([(i, 1, dt.datetime(2024, 1, 1), "TEMPERATURE", None) for i in ids], ddl)
    path, write = f"{tmp_dir}/r", DataFrameWriter.parquet

    def crash(after):
        def parquet(self, at, *a, **k):
            if at == path and not after:
                raise OSError("lost")
            out = write(self, at, *a, **k)
            if at == path:
                raise OSError("lost")
            return out
        return parquet

    ingest.ingest_readings(batch(None, None, 10), path)
    for after in (False, True):  # before and after the rows of the batch are there
        monkeypatch.setattr(DataFrameWriter, "parquet", crash(after))
        with pytest.raises(OSError):
            ingest.ingest_readings(batch(None, None), path)
        monkeypatch.setattr(DataFrameWriter, "parquet", write)
    ingest.ingest_readings(batch(None, None), path)
    assert sorted(r.reading_id for r in spark.read.parquet(path).collect()) == [10, 11, 12, 15, 16, 17, 18]
    assert ingest.high_water(spark, path) == 18
    write(batch(1).write, f"{tmp_dir}/old")
    with pytest.raises(ValueError):
        ingest.ingest_readings(batch(None), f"{tmp_dir}/old")
