"""A table in parts of which each has a version; a manifest names the version of every part.

A change writes the parts it touches as a new version folder and then the manifest, which is the commit: before it is
there readers see the old state, and a change that failed is done again under the same number.  The manifest also
names the batches taken in so far.  Changes of one table run one after the other; old versions stay for their readers.

Layout: ``<path>/v=<number>/<column>=<part>/`` and ``<path>/_manifest/<number>/``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators._ranges import table
from .tables import hadoop_path

_MANIFEST = "part STRING, v INT, batch STRING"
_NULL = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class State:
    """Number of the last change, version of every part (by folder name), batches taken in."""

    number: int = 0
    parts: dict[str, int] = field(default_factory=dict)
    batches: set[str] = field(default_factory=set)


def part_name(value) -> str:
    """The folder name of a part, without its column."""
    return _NULL if value is None else str(value)


def state(spark: SparkSession, path: str) -> State:
    """The committed state: one row per part and batch comes to the driver."""
    fs, p = hadoop_path(spark, f"{path}/_manifest")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    done = [int(n) for n in names if fs.exists(hadoop_path(spark, f"{path}/_manifest/{n}/_SUCCESS")[1])]
    if not done:
        return State()
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/_manifest/{max(done)}").collect()
    return State(max(done), {r.part: r.v for r in rows if r.batch is None}, {r.batch for r in rows if r.batch is not None})


def read(spark: SparkSession, path: str, column: str, schema: str, parts: Mapping[str, int]) -> DataFrame:
    """The rows of the given parts in their versions; ``schema`` ends with ``column``."""
    if not parts:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/v={v}/{column}={name}" for name, v in parts.items()]
    return spark.read.option("basePath", path).schema(f"{schema}, v INT").parquet(*folders).drop("v")


def commit(spark: SparkSession, path: str, before: State, rows: DataFrame, column: str, touched: Iterable, batch: str | None = None) -> None:
    """Write ``rows``, the whole new content of the ``touched`` parts, and the manifest that makes it the table's."""
    number = before.number + 1
    rows.write.mode("overwrite").partitionBy(column).parquet(f"{path}/v={number}")
    fs, _ = hadoop_path(spark, path)
    written = {s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(hadoop_path(spark, f"{path}/v={number}")[1])
               if s.getPath().getName().startswith(f"{column}=")}
    parts = {p: v for p, v in before.parts.items() if p not in set(map(part_name, touched))} | {p: number for p in written}
    lines = [(p, v, None) for p, v in parts.items()] + [(None, None, b) for b in sorted(before.batches | ({batch} if batch else set()))]
    spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest/{number}")


# -- upsert ------------------------------------------------------------------
PART = "part"


def _dealt(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    return df.withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.drop(PART).dtypes) + f", {PART} INT"


def create(rows: DataFrame, path: str, keys: list[str], parts: int = 64) -> None:
    """A keyed table below ``path``, dealt by key into ``parts``.  Size them to the table: the number doesn't change."""
    spark = rows.sparkSession
    commit(spark, path, State(), _dealt(rows, keys, parts).repartition(parts, PART), PART, [])


def open_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read(spark, path, PART, f"{schema}, {PART} INT", state(spark, path).parts).drop(PART)


def upsert(changes: DataFrame, path: str, schema: str, keys: list[str], parts: int = 64, order_by: str | None = None) -> DataFrame:
    """Give the rows of the keyed table at ``path`` the values of ``changes``; returns the keys of changes that match no row.

    Only the parts that a change falls into are read and written, and one full outer join gives both the new rows and the
    keys without a row.  Several changes of a key, and columns that changes lack, are as in
    ``operators.lifecycle.upsert_snapshot``.
    """
    spark, before = changes.sparkSession, state(changes.sparkSession, path)
    columns = spark.createDataFrame([], schema).columns
    new = [c for c in changes.columns if c in columns and c not in keys]
    first = [] if order_by is None else [F.col(order_by).alias("__order")]
    last = changes.groupBy(*keys).agg(F.max(F.struct(*first, *new)).alias("__new"))
    last = table(_dealt(last, keys, parts), "upsert-changes")
    touched = [r[0] for r in last.select(PART).distinct().collect()]  # at most one number per part
    old = read(spark, path, PART, f"{schema}, {PART} INT", {str(p): before.parts[str(p)] for p in touched if str(p) in before.parts})
    same = functools.reduce(lambda x, y: x & y, [F.col(f"o.{k}") == F.col(f"c.{k}") for k in [*keys, PART]])
    both = old.withColumn("__old", F.lit(True)).alias("o").join(last.alias("c"), same, "full_outer")
    pick = lambda c: F.when(F.col("c.__new").isNotNull(), F.col(f"c.__new.{c}")).otherwise(F.col(f"o.{c}")) if c in new else (
        F.coalesce(f"o.{c}", f"c.{c}") if c in keys else F.col(f"o.{c}"))
    both = table(both.select(*[pick(c).alias(c) for c in columns], F.coalesce(f"o.{PART}", f"c.{PART}").alias(PART), "__old"), "upsert-joined")
    if touched:
        commit(spark, path, before, both.where("__old").drop("__old").repartition(PART), PART, touched)
    return both.where("__old IS NULL").select(*keys)
