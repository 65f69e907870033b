"""Structured Streaming forms of validation (S-1) and alerting (S-2); login lockouts (S-3) are in ``lockout_stream``.

The source polls a five-minute look-back with a stored procedure and
nothing schedules it.  Here the same rules run on unbounded inputs:

* S-1 readings -> validity -> parquet sink partitioned by day;
* S-2 readings -> watermark (5 minutes of lateness) -> readings that alert -> repeats of a
  reading dropped within the watermark -> stream-static joins with the
  rule map and sensors -> alerts; plus tumbling 5-minute counts per region
  and alert type.

Event-time columns must be TIMESTAMP (with zone), so zone-less times are
cast under the session zone (UTC) into ``event_time``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.alerts import alerts_from_readings, raises_alert
from ..operators.quality import validate_readings
from ..sources.driver import DriverTables
from ..sources.tables import hadoop_path
from .lockout_stream import finish_lockouts, read_lockouts, start_lockouts  # noqa: F401

LATENESS = "5 minutes"


class StreamTables(DriverTables):
    """Driver table projections where the tables named in ``streamed`` are read as streams.

    A stream's source is the table's own path, a file or a folder of part files.  How much a micro-batch
    takes is the caller's choice (``options`` of the file source); by default it takes what is there.
    The other tables stay static (stream-static joins).
    """

    def __init__(self, spark: SparkSession, sf_dir: str, options: Mapping[str, str] | None = None,
                 streamed: tuple[str, ...] = ("events",)):
        super().__init__(spark, sf_dir)
        self.options, self.streamed = dict(options or {}), streamed

    def src(self, name: str) -> DataFrame:
        if name not in self.streamed:
            return super().src(name)
        path = f"{self.sf_dir}/{name}.parquet"
        fs, p = hadoop_path(self.spark, path)
        r = self.spark.readStream.schema(self.spark.read.parquet(path).schema).options(**self.options)
        if fs.getFileStatus(p).isFile():  # the file source takes folders only: this one's, and that one name
            return r.option("pathGlobFilter", f"{name}.parquet").parquet(self.sf_dir)
        return r.parquet(path)


# -- S-1 ---------------------------------------------------------------------
def validated_stream(raw: DataFrame) -> DataFrame:
    return validate_readings(raw).withColumn("collected_date", F.to_date("collected_at"))


def start_validation(raw: DataFrame, sink: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Validated readings appended as parquet, partitioned by day (exactly once via the checkpoint)."""
    w = (validated_stream(raw).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).partitionBy("collected_date"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(sink)


# -- S-2 ---------------------------------------------------------------------
def alert_stream(readings: DataFrame, tables: Mapping[str, DataFrame], lateness: str = LATENESS) -> DataFrame:
    """Alerts of a readings stream; repeats of a reading within the watermark are dropped."""
    r = readings.withColumn("event_time", F.col("collected_at").cast("timestamp")).withWatermark("event_time", lateness)
    # few readings alert: only those enter the duplicate filter.  The condition names the event time,
    # so that it stays above the watermark, which has to see every reading.
    r = r.filter(F.when(F.col("event_time").isNotNull(), raises_alert())).dropDuplicatesWithinWatermark(["reading_id"])
    return alerts_from_readings(r, tables, keep=("event_time", "alert_type"))


def alert_window_counts(alerts: DataFrame, minutes: int = 5) -> DataFrame:
    """Tumbling per-``minutes`` alert counts per region and alert type (append: closed windows).

    Window bounds are returned zone-less, like the reading times.
    """
    return (alerts.groupBy(F.window("event_time", f"{minutes} minutes").alias("w"), "region_id", "alert_type")
            .agg(F.count(F.lit(1)).alias("alerts"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                    "region_id", "alert_type", "alerts"))


def start_alert_windows(readings: DataFrame, tables: Mapping[str, DataFrame], sink: str, checkpoint: str,
                        available_now: bool = True) -> StreamingQuery:
    """Closed 5-minute alert windows appended as they close (watermark passes the window end)."""
    w = (alert_window_counts(alert_stream(readings, tables)).writeStream.format("parquet")
         .outputMode("append").option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(sink)


def start_alerts(readings: DataFrame, tables: Mapping[str, DataFrame], sink: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    a = alert_stream(readings, tables).drop("event_time", "alert_type")
    w = (a.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(sink)


def run_to_end(q: StreamingQuery) -> None:
    """Wait for an available-now query, which ends by itself; raise its error if it failed."""
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
