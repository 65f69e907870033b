"""Helpers shared by the corpus operators: Arrow buffers, written tables, work sizing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path

#: Fixed value: every fourth document by this checksum is kept from learning.
HELD_OUT_REMAINDER = 2


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id):
    """True for rows that no model may learn from; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == HELD_OUT_REMAINDER, F.lit(False))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def block_count(total_bytes: int, least: int = 4 << 20, most: int = 64 << 20, aim: int = 1000) -> int:
    """How many blocks of text to work on: of ``least`` bytes while that makes at most ``aim``
    blocks, then larger ones up to ``most`` bytes (what one task holds), then more of them."""
    size = min(most, max(least, total_bytes // aim))
    return max(1, math.ceil(total_bytes / size))


def one_array(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def utf8_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty.

    Text i is ``bytes[offsets[i]:offsets[i + 1]]``.  Nothing is copied.
    """
    arr = one_array(column)
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, arr.offset + len(arr) + 1)[arr.offset:] \
        if len(arr) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off.astype(np.int64)


def pieces(data: np.ndarray, off: np.ndarray, most: int = 1 << 20, texts: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs (first, last + 1) of texts with about ``most`` bytes each, of ``texts`` texts at most, so that temporaries stay small."""
    first, n = 0, len(off) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + most, side="right")) - 1)
        last = min(last, n if texts is None else first + texts, n)
        yield first, last
        first = last


def chars_array(values: list[bytes], kind=None) -> pa.Array:
    return pa.array(values, kind or pa.binary())
