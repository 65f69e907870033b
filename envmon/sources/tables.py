"""Open a store of the monitoring tables; write a set of tables back.

A store is a folder with one sub-folder per table (parquet by default, any
DataFrame reader format otherwise) or a JDBC database.  Tables are read
with their declared schema, so nothing is inferred and every scan can push
filters and prune columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..schemas import SCHEMAS, conform, struct_type

TABLE_NAMES = [t for t in SCHEMAS if t not in ("raw_readings", "live_alerts")]


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of any path Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Store(dict):
    """Lazy mapping table name -> DataFrame over one storage location."""

    def __init__(self, spark: SparkSession, path: str, fmt: str = "parquet",
                 options: Mapping[str, str] | None = None,
                 jdbc_partitions: Mapping[str, tuple[str, int, int, int]] | None = None):
        super().__init__()
        self.spark, self.path, self.fmt = spark, path.rstrip("/"), fmt
        self.options = dict(options or {})
        self.jdbc_partitions = dict(jdbc_partitions or {})

    def __contains__(self, name) -> bool:
        return dict.__contains__(self, name) or name in SCHEMAS

    def stored(self) -> list[str]:
        """The tables present in storage, in declaration order (names only reach the driver)."""
        if self.fmt == "jdbc":
            return [t for t in TABLE_NAMES if self._readable(t)]
        fs, root = hadoop_path(self.spark, self.path)
        there = {s.getPath().getName() for s in fs.listStatus(root)} if fs.exists(root) else set()
        return [t for t in TABLE_NAMES if t in there]

    def _readable(self, name: str) -> bool:
        try:
            self.spark.read.format("jdbc").options(**self.options).option("dbtable", name).load()
        except Exception as e:  # the driver's own "no such table", whatever its class
            if "exist" in str(e).lower() or "not found" in str(e).lower():
                return False
            raise
        return True

    def __iter__(self):
        return iter(dict.fromkeys([*dict.keys(self), *self.stored()]))

    def __len__(self) -> int:
        return len(list(iter(self)))

    def keys(self):
        return list(iter(self))

    def items(self):
        return [(t, self[t]) for t in self]

    def values(self):
        return [self[t] for t in self]

    def __missing__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(name)
        if self.fmt == "jdbc":
            r = self.spark.read.format("jdbc").options(**self.options).option("dbtable", name)
            part = self.jdbc_partitions.get(name)
            if part is not None:  # parallel read: one range of the column per task
                col, lo, hi, n = part
                r = (r.option("partitionColumn", col).option("lowerBound", str(lo))
                     .option("upperBound", str(hi)).option("numPartitions", str(n)))
            df = conform(r.load(), name)
        else:
            r = self.spark.read.format(self.fmt).options(**self.options)
            # the declared schema: nothing is inferred, a column of another type is an error where it is read
            r = r.schema(struct_type(name))
            if self.fmt == "csv":
                r = r.option("header", "true")
            df = conform(r.load(f"{self.path}/{name}"), name)
        self[name] = df
        return df


def load_tables(spark: SparkSession, path: str, fmt: str = "parquet",
                options: Mapping[str, str] | None = None,
                jdbc_partitions: Mapping[str, tuple[str, int, int, int]] | None = None) -> Store:
    """Access to the monitoring tables stored at ``path`` (read on first use).

    For ``fmt="jdbc"`` a plain read is a single task; ``jdbc_partitions`` maps a table to
    (numeric column, lower bound, upper bound, partitions) for a parallel range read.
    """
    return Store(spark, path, fmt, options, jdbc_partitions)


def save_tables(tables: Mapping[str, DataFrame], path: str, names: Iterable[str] | None = None,
                fmt: str = "parquet", mode: str = "errorifexists",
                partition_by: Mapping[str, list[str]] | None = None) -> str:
    """Write tables as sub-folders of ``path`` (one job per table)."""
    chosen = list(names) if names is not None else list(tables)
    if not chosen:
        raise ValueError("there is no table to write")
    for name in chosen:
        w = tables[name].write.mode(mode).format(fmt)
        if fmt == "csv":
            w = w.option("header", "true")  # the store reads csv with a header line
        cols = (partition_by or {}).get(name)
        if cols:
            w = w.partitionBy(*cols)
        w.save(f"{path.rstrip('/')}/{name}")
    return path
