"""Login lockouts of a stream (S-3) on Spark's own keyed state.

State per user: the attempts the watermark has not passed yet (a list), the counter (failures in a row,
lock end) and the time the user's timer is set to.  An attempt waits until the
watermark, ``lateness_s`` behind the newest attempt, has passed it; then the user's
waiting attempts are replayed in order of time and id, whatever order they came in.
A timer in event time wakes a user when an attempt becomes due or a lock ends; a user
with no waiting attempt, no lock and no failure keeps no state.

Every attempt comes out once: with its outcome; as LATE (no outcome, no effect) if
the watermark had passed it when it came; as UNPLACED if it has no time or no user.
State, timers and the watermark live in the checkpoint, so a restarted stream goes on
where it was.  :func:`finish_lockouts` reads that state and gives the outcomes of the
attempts that still wait when an input has ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.lockouts import LOCKOUT_SCHEMA, UNPLACED, LoginState, login_lockouts
from ._state import micros, micros_of, read_state, start_append, state_store, time_of, zoneless

LOGIN_LATENESS_S = 3600  # attempts wait this long behind the newest one
LATE = "LATE"


class Lockouts(StatefulProcessor):
    """Times are microseconds of the zone-less clock; timers and the watermark are milliseconds of it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counter = handle.getValueState("counter", "failures INT, locked_until LONG, wake LONG")
        self.waiting = handle.getListState("waiting", "event_id LONG, ts LONG, success BOOLEAN")

    def _frame(self, user: int, rows: list[tuple]) -> pd.DataFrame:
        """Output rows from (event_id, ts, success, outcome, failures, lock end)."""
        ids, times, oks, outcomes, counts, ends = zip(*rows)
        return pd.DataFrame({"event_id": pd.Series(ids, dtype="Int64"), "user_id": user, "ts": pd.to_datetime([time_of(t) for t in times]),
                             "success": oks, "outcome": outcomes, "failed_attempts": pd.Series(counts, dtype="Int32"),
                             "locked_until": pd.to_datetime(pd.Series(ends, dtype="object"))})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new, late = [], []
        for pdf in rows:
            for event_id, ts, ok in zip(pdf["event_id"], pdf["ts"], pdf["success"]):
                event_id = None if pd.isna(event_id) else int(event_id)
                if int(ts) < passed:
                    late.append((event_id, int(ts), bool(ok), LATE, None, None))
                else:
                    new.append((event_id, int(ts), bool(ok)))
        if late:
            yield self._frame(key[0], late)
        if new:
            self.waiting.appendList(new)
            failures, locked_until, wake = self.counter.get() or (0, None, None)
            due = min(ts for _, ts, _ in new) // 1000 + 1
            due = due if wake is None else min(wake, due)
            if due != wake:
                self._set_timer(wake, due)
                self.counter.update((failures, locked_until, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Outcomes of the user's attempts that the watermark has passed; then the state that is left, and the next timer."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        failures, locked_until, _ = self.counter.get() or (0, None, None)
        held = list(self.waiting.get())
        ready = sorted((r for r in held if r[1] < passed), key=lambda r: (r[1], r[0] is not None, r[0] or 0, r[2]))
        rest = [r for r in held if r[1] >= passed]
        state, out = LoginState(failures, time_of(locked_until)), []
        for event_id, ts, ok in ready:
            outcome = state.step(time_of(ts), ok)
            out.append((event_id, ts, ok, outcome, state.failures, state.locked_until))
        end = micros_of(state.locked_until)
        if end is not None and end < passed:  # the lock is over for every attempt that can still come
            state, end = LoginState(), None
        times = [r[1] for r in rest] + ([end] if end is not None else [])
        due = min(times) // 1000 + 1 if times else None
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if due is None and not state.failures:
            self.counter.clear()
        else:
            self.counter.update((state.failures, end, due))
        self._set_timer(None, due)  # the one that woke this user is gone
        if out:
            yield self._frame(key[0], out)

    def _set_timer(self, old: int | None, new: int | None) -> None:
        if old is not None:
            self.handle.deleteTimer(old)
        if new is not None:
            self.handle.registerTimer(new)

    def close(self) -> None:
        pass


def lockout_stream(events: DataFrame, lateness_s: int = LOGIN_LATENESS_S) -> DataFrame:
    """Outcomes of a stream of (event_id, user_id, ts, success), append mode."""
    e = events.select(F.col("event_id").cast("bigint").alias("event_id"), F.col("user_id").cast("bigint").alias("user_id"),
                      F.col("ts").cast("timestamp_ntz").alias("ts"), F.coalesce(F.col("success").cast("boolean"), F.lit(False)).alias("success"))
    placed = F.col("ts").isNotNull() & F.col("user_id").isNotNull()
    # event time: the zone-less clock read as UTC, in any session zone
    seen = e.where(placed).withColumn("event_time", F.timestamp_micros(micros(F.col("ts")))).withWatermark("event_time", f"{lateness_s} seconds")
    # the processor sees times as numbers: rows behind the watermark reach it and come out as LATE
    rows = seen.select("event_id", "user_id", F.unix_micros("event_time").alias("ts"), "success")
    schema = StructType.fromDDL(LOCKOUT_SCHEMA)
    done = rows.groupBy("user_id").transformWithStateInPandas(Lockouts(), schema, outputMode="Append", timeMode="EventTime")
    lost = e.where(~placed).select("*", F.lit(UNPLACED).alias("outcome"), F.lit(None).cast("int").alias("failed_attempts"),
                                   F.lit(None).cast("timestamp_ntz").alias("locked_until"))
    return done.unionByName(lost)


def start_lockouts(events: DataFrame, sink: str, checkpoint: str, available_now: bool = True,
                   lateness_s: int = LOGIN_LATENESS_S) -> StreamingQuery:
    """Write the outcomes below ``sink``; :func:`read_lockouts` reads them."""
    return start_append(lockout_stream(events, lateness_s), f"{sink}/done", checkpoint, available_now)


def waiting_attempts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(event_id, user_id, ts, success) of the attempts that still wait, from a stopped stream's checkpoint."""
    s = read_state(spark, checkpoint, "waiting")
    ts = zoneless(F.col("list_element.ts"))
    return s.select("list_element.event_id", "key.user_id", ts.alias("ts"), "list_element.success")


def user_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(user_id, failures, locked_until) of the users that keep a state."""
    s = read_state(spark, checkpoint, "counter")
    return s.select("key.user_id", "value.failures", zoneless(F.col("value.locked_until")).alias("locked_until"))


def finish_lockouts(spark: SparkSession, sink: str, checkpoint: str) -> None:
    """Outcomes of the attempts that still wait at the end of an input, by the batch operator from the kept state.

    The checkpoint is only read: a stream that goes on gives these attempts again, and the next
    call replaces what this one wrote.
    """
    with state_store(spark):
        rest = login_lockouts(waiting_attempts(spark, checkpoint), carried=user_states(spark, checkpoint))
        rest.write.mode("overwrite").parquet(f"{sink}/rest")


def read_lockouts(spark: SparkSession, sink: str) -> DataFrame:
    """All outcomes below ``sink``: those of the stream, and those of its last :func:`finish_lockouts`."""
    from ..sources.tables import hadoop_path
    done = spark.read.schema(LOCKOUT_SCHEMA).parquet(f"{sink}/done")
    fs, rest = hadoop_path(spark, f"{sink}/rest")
    return done.unionByName(spark.read.schema(LOCKOUT_SCHEMA).parquet(f"{sink}/rest")) if fs.exists(rest) else done
