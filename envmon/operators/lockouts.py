"""Login lockouts (R6): every attempt's outcome, with one user's attempts spread over tasks.

The rule is sequential: the fifth failure in a row locks for an hour, a try
before the lock's end is refused and not counted, and once it has ended the count
starts anew.  It is computed without walking the attempts:

1. All attempts are sorted by (user, time, id) into ranges and numbered throughout, so that
   a user's attempts have consecutive numbers.  A user may fill many ranges; what
   one range must know of the others (the last success before it, the first after it) comes
   from one row per range and edge user, at most two a range.
2. Numbers alone tell how many failures in a row end at an attempt (``n - last success``)
   and how many follow.  Every failure with at least five in a row behind it could be a lock.
3. A possible lock leads to the next one: the first attempt at or after its end is found by sorting ends
   among the attempts, and from there the next run of failures that is long enough gives
   the lock.  That is a jump per possible lock.
4. The first run of five starts a user's chain of locks.  The locks that come about are those
   the chain reaches, found by pointer doubling: with jumps of 1, 2, 4, ... the reached part
   doubles in each round, so a chain of k locks takes log2(k) joins on unique numbers.
5. The last lock at or before an attempt and its last success give the outcome.

Nothing needs a user's attempts in one task, and all of it is DataFrame code.

Defined results: attempts without a time or a user have no place in the order; they are returned
with outcome UNPLACED and nulls, and change nothing.  A null ``success`` counts as a
failure.  Attempts of one user and time go by event_id, then failures first; repeated rows are attempts of their own.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._ranges import in_ranges, offsets, ranges_after, ranges_before, table

# --- fixed values: login lock rule ------------------------------------------
MAX_FAILURES = 5
LOCK_SECONDS = 3600

LOCKOUT_SCHEMA = ("event_id BIGINT, user_id BIGINT, ts TIMESTAMP_NTZ, success BOOLEAN, outcome STRING, "
                  "failed_attempts INT, locked_until TIMESTAMP_NTZ")
UNPLACED = "UNPLACED"


class LoginState:
    """Counter state of one user, one attempt at a time (the streaming form and the tests' brute force)."""

    __slots__ = ("failures", "locked_until")

    def __init__(self, failures: int = 0, locked_until=None):
        self.failures = failures
        self.locked_until = locked_until

    def step(self, ts, success: bool, max_failures: int = MAX_FAILURES,
             lock: _dt.timedelta = _dt.timedelta(seconds=LOCK_SECONDS)) -> str:
        """Apply one attempt; returns the outcome.

        A try while locked is refused and not counted.  When a lock has ended
        the counter starts again from 0.  Success resets the counter; the
        ``max_failures``-th failure in a row locks for ``lock``.
        """
        if self.locked_until is not None:
            if ts < self.locked_until:
                return "REFUSED"
            self.locked_until = None
            self.failures = 0
        if success:
            self.failures = 0
            return "SUCCESS"
        self.failures += 1
        if self.failures >= max_failures:
            self.locked_until = ts + lock
            return "LOCKED"
        return "FAILURE"


def _edges(df: DataFrame, *aggs: Column) -> DataFrame:
    """``aggs`` per range and user, for the two users a range may share with others."""
    edge = (F.col("user_id") == F.col("first_key")) | (F.col("user_id") == F.col("last_key"))
    return df.where(edge).groupBy("user_id", "part").agg(*aggs)


def _numbered(attempts: DataFrame) -> DataFrame:
    """Attempts with their number ``n``, that of the success before (``ok``) and of the next one (``next_ok``).

    Before a user's first attempt, and after the last, a success is assumed.  A row carried over from
    earlier (``carry``) stands before a user's attempts; its failures count as already made.
    """
    rows = in_ranges(attempts, "lockout-attempts", "user_id", "carry", "ts", "event_id", "success")
    rows = rows.join(offsets(rows, "user_id"), "part").withColumn("n", F.col("offset") + F.col("at"))
    passed = F.when(F.col("carry") == 0, F.col("n") - F.col("failures")).when(F.col("success"), F.col("n"))
    rows = rows.withColumn("ok_at", passed)
    good = F.when(F.col("success"), F.col("n"))
    edges = _edges(rows, F.max("ok_at").alias("ok"), F.min(good).alias("good"), F.min("n").alias("first"), F.max("n").alias("last"))
    whole = Window.partitionBy("user_id")
    before, after = ranges_before("user_id"), ranges_after("user_id")
    edges = edges.select("user_id", "part", F.max("ok").over(before).alias("ok_before"), F.min("good").over(after).alias("ok_after"),
                         F.min("first").over(whole).alias("first"), F.max("last").over(whole).alias("last"))
    here = Window.partitionBy("user_id", "part")
    up = here.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    down = here.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("user_id", "part", "n", "carry", "ts", "event_id", "success", "failures", "locked_until",
                       F.max("ok_at").over(up).alias("ok_here"), F.min("n").over(up).alias("first_here"),
                       F.min(good).over(down).alias("ok_next"), F.max("n").over(down).alias("last_here"))
    rows = rows.join(edges, ["user_id", "part"], "left")
    first, last = F.coalesce("first", "first_here"), F.coalesce("last", "last_here")
    return table(rows.select(
        "user_id", "part", "n", "carry", "ts", "event_id", "success", "failures", "locked_until",
        F.coalesce("ok_here", "ok_before", first - 1).alias("ok"),
        F.coalesce("ok_next", "ok_after", last + 1).alias("next_ok")), "lockout-numbered")


def _jumps(rows: DataFrame, ends: DataFrame, max_failures: int) -> DataFrame:
    """(user_id, part, n, until, count, resume, next) of every possible lock: the first attempt at or after its end, and the next lock."""
    mark = F.when(~F.col("success") & (F.col("next_ok") - F.col("n") == max_failures), F.struct("n", (F.col("ok") + 1).alias("start")))
    none = lambda kind: F.lit(None).cast(kind)
    attempts = (rows.where(F.col("carry") == 1).join(ends.select("user_id").distinct(), "user_id", "left_semi")
                .select("user_id", F.col("ts").alias("time"), F.lit(1).alias("kind"), "n", mark.alias("mark"),
                        none("int").alias("home"), none("int").alias("count")))
    asked = ends.select("user_id", F.col("until").alias("time"), F.lit(0).alias("kind"), "n",
                        none("struct<n:bigint,start:bigint>").alias("mark"), F.col("part").alias("home"), "count")
    both = in_ranges(attempts.unionByName(asked), "lockout-ends", "user_id", "time", "kind", "n")
    seen = F.when(F.col("kind") == 1, F.col("n"))
    edges = _edges(both.join(offsets(both, "user_id"), "part"), F.min(seen).alias("n"), F.min("mark").alias("mark"))
    after = ranges_after("user_id")
    edges = edges.select("user_id", "part", F.min("n").over(after).alias("n_after"), F.min("mark").over(after).alias("mark_after"))
    down = (Window.partitionBy("user_id", "part").orderBy(F.desc("time"), F.desc("kind"), F.desc("n"))
            .rowsBetween(Window.unboundedPreceding, 0))
    both = both.select("user_id", "part", "time", "kind", "n", "home", "count", F.min(seen).over(down).alias("n_here"),
                       F.min("mark").over(down).alias("mark_here")).where(F.col("kind") == 0)
    both = both.join(edges, ["user_id", "part"], "left")
    resume, run = F.coalesce("n_here", "n_after"), F.coalesce("mark_here", "mark_after")
    return table(both.select(
        "user_id", F.col("home").alias("part"), "n", F.col("time").alias("until"), "count", resume.alias("resume"),
        F.when(run.isNotNull(), F.greatest(resume, run["start"]) + (max_failures - 1)).alias("next")), "lockout-jumps")


def _reached(starts: DataFrame, jumps: DataFrame) -> DataFrame:
    """Numbers of the locks on the chains from ``starts``: pointer doubling, three times between two tables."""
    reached, step = starts, jumps.where(F.col("next").isNotNull()).select("n", "next")
    along = lambda at, hop: at.join(hop, "n").select(F.col("next").alias("n"))
    twice = lambda hop: hop.join(hop.select(F.col("n").alias("next"), F.col("next").alias("far")), "next").select("n", F.col("far").alias("next"))  # noqa: E731,E501
    while True:
        for _ in range(3):
            reached = reached.unionByName(along(reached, step))
            step = twice(step)
        reached, step = table(reached, "lockout-reached"), table(step, "lockout-steps")
        if along(reached, step).isEmpty():
            return reached


def login_lockouts(events: DataFrame, max_failures: int = MAX_FAILURES,
                   lock_seconds: int = LOCK_SECONDS, carried: DataFrame | None = None) -> DataFrame:
    """Outcome of every login attempt (SUCCESS, FAILURE, LOCKED, REFUSED, UNPLACED) and the counter after it.

    ``carried`` (user_id, failures, locked_until) is the state before these attempts, one row for
    each user that has one.
    """
    if max_failures < 1 or lock_seconds < 1:
        raise ValueError("at least one failure and one second")
    e = events.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"),
                      F.coalesce(F.col("success").cast("boolean"), F.lit(False)).alias("success"))
    placed = F.col("user_id").isNotNull() & F.col("ts").isNotNull()
    lost = e.where(~placed).select("*", F.lit(UNPLACED).alias("outcome"), F.lit(None).cast("int").alias("failed_attempts"),
                                   F.lit(None).cast("timestamp_ntz").alias("locked_until"))
    e = e.where(placed).select("*", F.lit(1).alias("carry"), F.lit(0).alias("failures"),
                               F.lit(None).cast("timestamp_ntz").alias("locked_until"))
    if carried is not None:
        e = e.unionByName(carried.where(F.col("user_id").isNotNull()).select(
            F.lit(None).cast("bigint").alias("event_id"), "user_id", F.lit(None).cast("timestamp_ntz").alias("ts"),
            F.lit(False).alias("success"), F.lit(0).alias("carry"), F.col("failures").cast("int").alias("failures"),
            F.col("locked_until").cast("timestamp_ntz").alias("locked_until")))
    rows = _numbered(e)

    row = F.col("n") - F.col("ok")  # failures in a row that end here
    held = (F.col("carry") == 0) & F.col("locked_until").isNotNull()
    could = (F.col("carry") == 1) & ~F.col("success") & (row >= max_failures)
    until = F.coalesce("locked_until", F.col("ts") + F.make_dt_interval(secs=F.lit(lock_seconds)))
    ends = rows.where(held | could).select("user_id", "part", "n", until.alias("until"),
                                           F.when(held, F.col("failures")).otherwise(max_failures).alias("count"))
    jumps = _jumps(rows, ends, max_failures)
    starts = rows.where(held | could & (row == max_failures)).groupBy("user_id").agg(F.min("n").alias("n")).select("n")
    locks = jumps.join(_reached(starts, jumps), "n", "left_semi")

    # the locks go in front of the attempts they begin at, and hold until the next one
    lock = F.struct("n", "until", "resume", "count")
    both = rows.select("user_id", "part", "n", "carry", "ts", "event_id", "success", "ok", F.lit(None).cast(
        "struct<n:bigint,until:timestamp_ntz,resume:bigint,count:int>").alias("lock")).unionByName(locks.select(
            "user_id", "part", "n", lock.alias("lock")), allowMissingColumns=True)
    both = both.join(offsets(rows, "user_id").drop("offset"), "part")
    edges = _edges(both, F.max("lock").alias("lock"))
    edges = edges.select("user_id", "part", F.max("lock").over(ranges_before("user_id")).alias("lock_before"))
    up = Window.partitionBy("user_id", "part").orderBy("n", F.asc_nulls_last("lock")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("lock_here", F.max("lock").over(up)).where((F.col("carry") == 1) & F.col("lock").isNull())
    both = both.join(edges, ["user_id", "part"], "left").withColumn("held", F.coalesce("lock_here", "lock_before"))
    locked, refused = F.col("held.n") == F.col("n"), F.col("ts") < F.col("held.until")
    bound = F.coalesce(locked | refused, F.lit(False))
    count = F.col("n") - F.greatest("ok", F.col("held.resume") - 1)
    done = both.select(
        "event_id", "user_id", "ts", "success",
        F.when(locked, "LOCKED").when(refused, "REFUSED").when(F.col("success"), "SUCCESS").otherwise("FAILURE").alias("outcome"),
        F.when(bound, F.col("held.count")).when(F.col("success"), 0).otherwise(count).cast("int").alias("failed_attempts"),
        F.when(bound, F.col("held.until")).alias("locked_until"))
    return done.unionByName(lost)
