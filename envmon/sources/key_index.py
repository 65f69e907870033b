"""Constraint checks on an incoming batch only (R7 at insert time).

A key index holds a table's keys as a bucketed table: hashed into a fixed number of buckets and sorted there.  A batch
is checked against it by joins whose index side needs no exchange; the batch alone is shuffled into the buckets.  What is
checked: keys that repeat within the batch or are there already, foreign keys without a parent, and
values outside their lists.  For a base that has no violations of its own the result is that of
:func:`operators.lifecycle.constraint_violations` over base and batch.

An index is a folder of parquet files; :func:`open_index` makes it known to a session.  Null keys are neither kept nor checked.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import constraint_checks
from ..schemas import SCHEMAS, struct_type

_VIOLATION = ["table_name", "constraint_name", "kind", "key_value", "n"]


@dataclass(frozen=True)
class KeyIndex:
    """Keys of one table: a bucketed table of ``columns`` with the number of rows ``held`` per key."""

    name: str
    path: str
    columns: tuple[str, ...]
    buckets: int

    def keys(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)


def _name(path: str) -> str:
    return "key_index_" + hashlib.sha256(path.encode()).hexdigest()[:16]


def _counted(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.select(*columns).dropna().groupBy(*columns).agg(F.count(F.lit(1)).alias("held"))


def _write(keys: DataFrame, index: KeyIndex, mode: str) -> None:
    dealt = keys.repartition(index.buckets, *index.columns)  # one file per bucket and write
    (dealt.write.mode(mode).format("parquet").bucketBy(index.buckets, *index.columns).sortBy(*index.columns)
     .option("path", index.path).saveAsTable(index.name))


def build_index(rows: DataFrame, columns: Sequence[str], path: str, buckets: int = 32) -> KeyIndex:
    """The index of the keys ``columns`` of a table's rows, below ``path``.  Size ``buckets`` to the table: it doesn't change."""
    index = KeyIndex(_name(path), path, tuple(columns), buckets)
    _write(_counted(rows, columns), index, "errorifexists")
    return index


def open_index(spark: SparkSession, path: str, columns: Mapping[str, str], buckets: int) -> KeyIndex:
    """Make an index written by an earlier session known to this one; ``columns``: name -> type of its keys."""
    index = KeyIndex(_name(path), path, tuple(columns), buckets)
    names = ", ".join(columns)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {index.name} ({', '.join(f'{c} {t}' for c, t in columns.items())}, held BIGINT) USING parquet "
              f"CLUSTERED BY ({names}) SORTED BY ({names}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return index


def add_to_index(rows: DataFrame, index: KeyIndex) -> None:
    """Append the keys of rows that were inserted; a key may then stand in several files of its bucket."""
    _write(_counted(rows, index.columns), index, "append")
    rows.sparkSession.catalog.refreshTable(index.name)


def batch_violations(batch: DataFrame, table: str, indexes: Mapping[tuple[str, tuple[str, ...]], KeyIndex],
                     columns: Sequence[str] | None = None) -> DataFrame:
    """What a batch of ``table`` would violate, in the columns of the full check.

    ``indexes``: (table, key columns) -> index, for the table's own keys and its parents'; a parent of the same
    batch has to be inserted first.  A check without its index is an error, not skipped.
    """
    spark, found = batch.sparkSession, []
    mine = list(columns or batch.columns)
    every = {t: struct_type(t).fieldNames() for t in SCHEMAS}
    for check in constraint_checks(every | {table: mine}):
        if check[1] != table:
            continue
        kind = check[0]
        if kind.startswith("DUPLICATE"):
            keys = check[2]
            held = indexes[table, tuple(keys)].keys(spark).withColumnRenamed("held", "before")
            new = _counted(batch, keys)
            # per key of the batch: what the index holds; an appended index may hold it in several rows
            both = new.join(held, list(keys), "left").groupBy(*keys, "held").agg(F.coalesce(F.sum("before"), F.lit(0)).alias("before"))
            bad = both.withColumn("n", F.col("held") + F.col("before")).where("n > 1")
            found.append(bad.select(F.lit(table).alias("table_name"), F.lit("(" + ",".join(keys) + ")").alias("constraint_name"),
                                    F.lit(kind).alias("kind"), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]).alias("key_value"), "n"))
        elif kind == "ORPHAN":
            _, _, fk, parent, pkey = check
            held = indexes[parent, (pkey,)].keys(spark).select(F.col(pkey).alias(fk))
            bad = _counted(batch, [fk]).join(held, fk, "left_anti")
            found.append(bad.select(F.lit(table).alias("table_name"), F.lit(f"{fk}->{parent}.{pkey}").alias("constraint_name"),
                                    F.lit("ORPHAN").alias("kind"), F.col(fk).cast("string").alias("key_value"), F.col("held").alias("n")))
        else:
            column, values = check[2], check[3]
            bad = _counted(batch.where(~F.col(column).isin(list(values))), [column])
            found.append(bad.select(F.lit(table).alias("table_name"), F.lit(column).alias("constraint_name"),
                                    F.lit("NOT_ALLOWED").alias("kind"), F.col(column).cast("string").alias("key_value"), F.col("held").alias("n")))
    if not found:
        return spark.createDataFrame([], "table_name STRING, constraint_name STRING, kind STRING, key_value STRING, n BIGINT")
    return functools.reduce(lambda a, b: a.unionByName(b), found).select(*_VIOLATION)
