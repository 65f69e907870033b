"""S2 reading ingest and S6 key assignment.

Ingest sets validity (R1), reserves ids for the rows that lack one, and appends the
batch to the readings folder partitioned by day, in one write job.  Spark's file
commit makes the job all-or-nothing: files of failed tasks are never committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.quality import validate_readings
from ..session import cut_lineage
from .tables import hadoop_path


def assign_ids(df: DataFrame, key: str, base: DataFrame | None = None, start: int | None = None,
               stable_input: bool = False) -> DataFrame:
    """Give rows with a NULL ``key`` new dense ids above the largest id in ``base`` (or ``start``).

    No single-partition window over the data: the rows to number are first
    checkpointed (stable partitions, also after a lost executor), each
    partition counts its rows, the per-partition counts (one row per
    partition) are turned into offsets, and every row gets offset + its
    position in the partition.  ``stable_input`` (rows already held locally or
    read from files that do not change) skips the checkpoint.
    """
    has = df.filter(F.col(key).isNotNull())
    todo = df.filter(F.col(key).isNull())
    if not stable_input:
        todo = cut_lineage(todo)
    if start is None:
        src = base if base is not None else has
        top = src.agg(F.max(key)).first()[0] or 0  # one number to the driver
    else:
        top = int(start) - 1
    numbered = todo.withColumn("__pid", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id())
    counts = numbered.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))  # one row per partition
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    pos = F.col("__mid") - F.shiftleft(F.col("__pid").cast("bigint"), 33)
    out = (numbered.join(offs, "__pid")  # one row per partition of the batch
                   .withColumn(key, (F.lit(int(top)) + F.col("__off") + pos + 1).cast("bigint")))
    return has.unionByName(out.select(*df.columns))


HIGH_WATER = "_high_water"  # below the readings folder; readers skip names that begin with an underscore


def high_water(spark: SparkSession, path: str) -> int | None:
    """The largest id handed out so far, as the ingests below ``path`` kept it (None before the first)."""
    fs, p = hadoop_path(spark, f"{path}/{HIGH_WATER}")
    return spark.read.parquet(f"{path}/{HIGH_WATER}").agg(F.max("last_id")).first()[0] if fs.exists(p) else None


def _has_rows(spark: SparkSession, path: str) -> bool:
    """Whether there is anything below ``path`` but marks."""
    fs, p = hadoop_path(spark, path)
    return fs.exists(p) and any(not f.getPath().getName().startswith("_") for f in fs.listStatus(p))


def ingest_readings(raw: DataFrame, path: str, base: DataFrame | None = None, start: int | None = None,
                    rows_per_file: int = 5_000_000, files_per_day: int = 8) -> str:
    """Validate, key and append a batch of readings under ``path`` (partitioned by day).

    The ids of a batch are reserved before its rows are written: the mark first goes up by the
    number of rows without an id, then the rows are appended.  An ingest that fails in between
    leaves a gap in the ids, and no id is handed out twice.  New ids go on from
    ``start``, else from the mark, else (the first time) from the largest id of ``base``; ids that the
    batch brings along raise the mark too.  Rows below ``path`` without a mark need ``base`` or ``start``.
    Ingests into one folder run one after the other.  The batch is dealt by day and one of
    ``files_per_day`` salts: a day gets a few files, and a day that holds most of the batch
    several writers; a file is split beyond ``rows_per_file`` rows, no row is left out.
    """
    spark = raw.sparkSession
    last = high_water(spark, path)
    if start is not None:
        last = start - 1
    elif last is None and base is not None:
        last = base.agg(F.max("reading_id")).first()[0] or 0
    elif last is None:
        if _has_rows(spark, path):
            raise ValueError(f"rows below {path} but no mark of the last id: give base or start")
        last = 0
    r = validate_readings(raw)
    r = r if raw.isLocal() else cut_lineage(r)  # what is counted is what is written
    new, top = r.agg(F.count(F.when(F.col("reading_id").isNull(), 1)), F.max("reading_id")).first()
    last = max(last, top or 0)
    spark.createDataFrame([(last + new,)], "last_id BIGINT").coalesce(1).write.mode("append").parquet(f"{path}/{HIGH_WATER}")
    r = assign_ids(r, "reading_id", start=last + 1, stable_input=True).withColumn("collected_date", F.to_date("collected_at"))
    salt = F.pmod(F.xxhash64("reading_id"), F.lit(files_per_day))
    (r.repartition("collected_date", salt).write.mode("append").option("maxRecordsPerFile", rows_per_file)
      .partitionBy("collected_date").parquet(path))
    return path
