"""Login lockouts in DataFrame code against the plain loop: long chains, one hot user, ties, nulls, carried state."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from envmon.operators._ranges import in_ranges
from envmon.operators.lockouts import LoginState, login_lockouts

DDL = "event_id BIGINT, user_id BIGINT, ts TIMESTAMP_NTZ, success BOOLEAN"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small inputs in several ranges, so that what ranges pass on to each other is used."""
    name, n = "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"
    before = spark.conf.get(name), spark.conf.get(n)
    spark.conf.set(name, "false")
    spark.conf.set(n, "7")
    yield
    spark.conf.set(name, before[0])
    spark.conf.set(n, before[1])


def brute(rows, m=5, secs=3600, carried=()):
    """Outcome, counter and lock end of every placed attempt, one after the other."""
    states = {u: LoginState(f, end) for u, f, end in carried}
    out = []
    for eid, user, ts, ok in sorted((r for r in rows if r[1] is not None and r[2] is not None),
                                    key=lambda r: (r[1], r[2], r[0], bool(r[3]))):
        st = states.setdefault(user, LoginState())
        what = st.step(ts, bool(ok), m, dt.timedelta(seconds=secs))
        out.append((eid, user, ts, bool(ok), what, st.failures, st.locked_until))
    return sorted(out, key=str) + [(r[0], r[1], r[2], bool(r[3]), "UNPLACED", None, None) for r in rows if r[1] is None or r[2] is None]


def run(spark, rows, **kw):
    got = login_lockouts(spark.createDataFrame(rows, DDL), **kw).collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.mark.parametrize("seed,m,secs,fail", [(1, 5, 3600, 0.75), (2, 3, 7, 0.9), (3, 1, 1, 0.5), (4, 2, 60, 0.3)])
def test_random_attempts(spark, seed, m, secs, fail):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 400), rng.choice([1, 1, 1, 2, 3, 4]), T0 + dt.timedelta(seconds=rng.randint(0, secs * 40 + 600)),
             rng.random() > fail) for _ in range(700)]
    rows += rows[:20] + [(7, None, T0, False), (8, 1, None, True), (9, 2, T0, None)]
    assert run(spark, rows, max_failures=m, lock_seconds=secs) == sorted(brute(rows, m, secs), key=str)


def test_long_chain_of_one_user(spark):
    """Failures every ten minutes for 40 days: hundreds of locks, each leading to the next."""
    rows = [(i, 1, T0 + dt.timedelta(minutes=10 * i), False) for i in range(5760)]
    want = brute(rows)
    assert sum(r[4] == "LOCKED" for r in want) > 500
    assert run(spark, rows) == sorted(want, key=str)


def test_carried_state(spark):
    hour = dt.timedelta(hours=1)
    carried = [(1, 3, None), (2, 5, T0 + hour), (3, 4, None), (9, 2, None)]
    rows = [(i, u, T0 + dt.timedelta(minutes=15 * i), ok) for u in (1, 2, 3, 4)
            for i, ok in enumerate([False, False, False, u == 3, False, False, False, False, False, False, True, False])]
    table = spark.createDataFrame(carried, "user_id BIGINT, failures INT, locked_until TIMESTAMP_NTZ")
    assert run(spark, rows, carried=table) == sorted(brute(rows, carried=carried), key=str)


def test_empty_table_and_bad_parameters(spark):
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        login_lockouts(spark.createDataFrame([], DDL), lock_seconds=0)


def test_a_user_with_most_attempts_is_spread_and_no_python_runs(spark):
    """One user's 30,000 attempts fill several ranges, and no operator of the plan is a Python one."""
    rows = spark.range(30000).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"),
                                     F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 97 % 2000000)").alias("ts"),
                                     (F.col("id") % 7 == 0).alias("success"))
    spread = in_ranges(rows.withColumn("carry", F.lit(1)), "test-ranges", "user_id", "carry", "ts", "event_id", "success")
    assert spread.select("part").distinct().count() > 1
    got = login_lockouts(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert {tuple(r) for r in got.collect()} == set(brute([tuple(r) for r in rows.collect()]))


# -- the stream ----------------------------------------------------------------
def write_files(spark, folder, batches, start=0):
    import time
    for i, rows in enumerate(batches, start):
        spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(f"{folder}/b{i}")
        time.sleep(1.1)  # the file source takes files by time


def stream_of(spark, folder):
    return spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def outcomes(df):
    return sorted(((r.event_id, r.user_id, r.ts, r.success, r.outcome, r.failed_attempts, r.locked_until) for r in df.collect()), key=str)


def test_stream_with_disorder_restart_nulls_and_late_attempts(spark, tmp_dir):
    """Five micro-batches in mixed order, a stop after three, rows without time or user, one attempt behind the watermark."""
    from envmon.streaming import lockout_stream as L
    rng, n = random.Random(6), 0
    batches = []
    for hour in range(5):
        rows = []
        for _ in range(60):
            n += 1
            at = T0 + dt.timedelta(hours=2 * hour, seconds=rng.randint(0, 9000))  # up to half an hour into the next batch's time
            rows.append((n, rng.choice([1, 1, 2, 3]), at, rng.random() > 0.85))
        rng.shuffle(rows)
        batches.append(rows)
    batches[1] += [(901, 1, None, True), (902, None, T0, False), (903, None, None, None)]
    batches[4] += [(904, 1, T0, True)]
    src, sink, ckpt = f"{tmp_dir}/src", f"{tmp_dir}/sink", f"{tmp_dir}/ckpt"
    write_files(spark, src, batches[:3])
    from envmon.streaming.streams import run_to_end
    run_to_end(L.start_lockouts(stream_of(spark, src), sink, ckpt, lateness_s=3600))
    L.finish_lockouts(spark, sink, ckpt)
    early = [r for b in batches[:3] for r in b]
    assert outcomes(L.read_lockouts(spark, sink)) == sorted(brute(early), key=str)
    write_files(spark, src, batches[3:], start=3)
    run_to_end(L.start_lockouts(stream_of(spark, src), sink, ckpt, lateness_s=3600))  # goes on from its checkpoint
    L.finish_lockouts(spark, sink, ckpt)
    every = [r for b in batches for r in b if r[0] != 904]
    want = sorted([*brute(every), (904, 1, T0, True, "LATE", None, None)], key=str)
    assert outcomes(L.read_lockouts(spark, sink)) == want
    assert {r[4] for r in want} == {"SUCCESS", "FAILURE", "LOCKED", "REFUSED", "UNPLACED", "LATE"}


def test_stream_forgets_idle_users(spark, tmp_dir):
    from envmon.streaming import lockout_stream as L
    from envmon.streaming.streams import run_to_end
    many = [[(100 * d + u, 1000 * d + u, T0 + dt.timedelta(days=d, minutes=u % 7), True) for u in range(50)]
            + [(9000 + 10 * d + i, 7, T0 + dt.timedelta(days=d, minutes=i), False) for i in range(6)] for d in range(4)]
    src, sink, ckpt = f"{tmp_dir}/src", f"{tmp_dir}/sink", f"{tmp_dir}/ckpt"
    write_files(spark, src, many)
    run_to_end(L.start_lockouts(stream_of(spark, src), sink, ckpt))
    kept = {r.user_id for r in L.user_states(spark, ckpt).collect()}
    assert kept == {3000 + u for u in range(50)} | {7}  # the last day's attempts wait; the other 150 users are gone
    L.finish_lockouts(spark, sink, ckpt)
    assert outcomes(L.read_lockouts(spark, sink)) == sorted(brute([r for b in many for r in b]), key=str)
