"""J7 on two streams: alerts that have a reading of a given status within five minutes of them.

The readings stream becomes one row per minute (and region) with its first and last reading time, as in the
batch form (``operators.interval``), which is all a window of ten minutes can ask of a minute.  A minute
is passed on when the watermark closes it.  An alert stands in the eleven minutes its window touches and
waits there, in a stream-stream join with a bound in event time, until one of them has a reading
in its window or the watermark has passed them all.  An alert found in several minutes comes out once.

State: the open minutes, the minutes and alerts of the last ten minutes or so behind the watermark, and the ids
of alerts that came out in that time; never the readings themselves.  The watermark of both
streams follows the slower one.  What comes later than ``lateness`` is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.interval import HALF_WINDOW_MINUTES, minute_index

LATENESS = "5 minutes"


def _clock(time: str):
    return F.col(time).cast("timestamp")


def reading_minute_stream(readings: DataFrame, status: str, lateness: str = LATENESS, by: tuple[str, ...] = ()) -> DataFrame:
    """(event_time, minute, first, last, ``by``) of every closed minute with a reading of ``status``."""
    r = readings.withColumn("reading_time", _clock("collected_at")).withWatermark("reading_time", lateness)
    # every reading moves the watermark, those of another status count no further
    hit = F.when(F.col("data_status") == status, F.col("reading_time"))
    m = r.groupBy(F.window("reading_time", "1 minute").alias("w"), *by).agg(F.min(hit).alias("first"), F.max(hit).alias("last"))
    return (m.where(F.col("first").isNotNull())
            .select(F.window_time("w").alias("minute_time"), minute_index(F.col("w.start")).alias("minute"), "first", "last",
                    *[F.col(c).alias(f"at_{c}") for c in by]))


def alerts_near_readings_stream(alerts: DataFrame, readings: DataFrame, status: str, lateness: str = LATENESS,
                                same_region: bool = False) -> DataFrame:
    """``alerts`` rows (a stream with triggered_at) that have a reading of ``status`` in [t - 5 min, t + 5 min], each once.

    With ``same_region`` the readings carry a region_id, and only those of the alert's region count.
    """
    by = ("region_id",) if same_region else ()
    minutes = reading_minute_stream(readings, status, lateness, by)
    half = F.expr(f"INTERVAL {HALF_WINDOW_MINUTES} MINUTES")
    columns = alerts.columns
    a = alerts.withColumn("event_time", _clock("triggered_at")).withWatermark("event_time", lateness)
    lo, hi = F.col("event_time") - half, F.col("event_time") + half
    a = a.withColumn("asked", F.explode(F.sequence(minute_index(lo), minute_index(hi))))
    near = (F.col("asked") == F.col("minute")) & (F.col("last") >= lo) & (F.col("first") <= hi)
    # the same window in event time, a minute wider: what the state may forget
    wide = F.expr(f"INTERVAL {HALF_WINDOW_MINUTES + 1} MINUTES")
    near = near & (F.col("minute_time") >= F.col("event_time") - wide) & (F.col("minute_time") <= F.col("event_time") + wide)
    if same_region:
        near = near & (F.col("region_id") == F.col("at_region_id"))
    found = a.join(minutes, near, "left_semi")
    return found.dropDuplicatesWithinWatermark(["alert_id"]).select(*columns)


def start_alerts_near_readings(alerts: DataFrame, readings: DataFrame, status: str, sink: str, checkpoint: str,
                               lateness: str = LATENESS, same_region: bool = False, available_now: bool = True) -> StreamingQuery:
    out = alerts_near_readings_stream(alerts, readings, status, lateness, same_region)
    w = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(sink)
