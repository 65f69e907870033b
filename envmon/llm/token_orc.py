"""Token ids as ORC files: integer run-length encoding, row indexes, Bloom filters on the document id.

Documents are range-partitioned and sorted by id, so part files follow one
another in id order and a stripe covers a narrow range of ids.  Each row holds
``doc_id``, ``ids`` (an integer list, run-length encoded by ORC), and the index
columns ``part``, ``first`` (ids before it in its part) and ``n_ids``.  Readers
take stripes in parallel; a filter on ``doc_id`` prunes files, stripes and row
groups by their statistics and Bloom filters.

Defined results: a null text counts as empty, an empty text has the end id
alone; null ids come first; rows that repeat an id follow one another; an empty
table gives files without rows.  Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .words import encoder, read_vocabulary

END_ID = 2
STRIPE_BYTES = 64 << 20
#: Rows of a row group: what the finest statistics and Bloom filters cover.
ROW_GROUP = 1000
#: Texts encoded at a time, for bounded memory.
SLICE = 500

COLUMNS = ["doc_id", "ids", "part", "first", "n_ids"]


def _encode(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    encode, end = encoder(vocabulary.value).encode, np.array([END_ID], "<u4").tobytes()
    part, before = TaskContext.get().partitionId(), 0
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            b = whole.slice(at, SLICE)
            raw = [encode(t.as_py()) + end for t in pc.fill_null(b.column("text"), "")]
            n = np.array([len(r) // 4 for r in raw], np.int64)
            off = np.concatenate([[0], np.cumsum(n)])
            ids = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)),
                                           pa.array(np.frombuffer(b"".join(raw), np.int32)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), ids, pa.array(np.full(len(n), part, np.int32)),
                 pa.array(before + off[:-1]), pa.array(n)], COLUMNS)
            before += int(off[-1])


def write(docs: DataFrame, path: str, vocabulary_path: str) -> None:
    """Encode every whole text and write the ids as ORC in ascending doc_id order."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))  # a fixed file
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    tie = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))  # also parts the rows of a hot id
    kind = rows.schema["doc_id"].dataType.simpleString()
    (rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
     .mapInArrow(partial(_encode, vocabulary=shared), f"doc_id {kind}, ids array<int>, part int, first long, n_ids long")
     .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.stripe.size", str(STRIPE_BYTES)).option("orc.row.index.stride", str(ROW_GROUP))
     .orc(path))


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, ids, part, first, n_ids; with ``doc_ids`` only those documents, pruned by the files' metadata."""
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        off, values = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")
        raw = memoryview(values).cast("B")
        crc = [zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
        n = np.diff(off).astype(np.int64)
        if not np.array_equal(n, b.column("n_ids").to_numpy()):
            raise ValueError("a stored list of ids doesn't have the length in its index column")
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("first"), pa.array(n),
                                          pa.array(crc, pa.int64())], ["doc_id", "part", "first", "n_tokens", "ids_crc32"])


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read back from the files."""
    rows = read(spark, path)
    kind = rows.schema["doc_id"].dataType.simpleString()
    sums = rows.select("doc_id", "ids", "part", "first", "n_ids").mapInArrow(
        _checksums, f"doc_id {kind}, part int, first long, n_tokens long, ids_crc32 long")
    # one row per part file; only the index columns are read for it
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (sums.join(parts.select("part", before.alias("before")), "part")
            .select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"))
