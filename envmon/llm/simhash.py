"""SimHash near-duplicates with pigeonring filtering.

Fingerprint: 64 bits, a bit is set when it is set in over half of the XXH64
hashes (seed 42) of the text's word shingles.  Two fingerprints link when at
most ``max_bits`` bits differ.

Search: the 64 bits are cut into ``max_bits + 1`` segments that form a ring.
If the differences total at most ``max_bits``, some start segment exists from
which every chain of consecutive segments stays within its proportional budget
(``floor(length * max_bits / segments)``): the first segment agrees and the
first two together differ in as many bits as two segments may.  That
chain of two is the join key: the index holds each fingerprint's (start,
segment, next segment), the query side the same with every allowed flip in the
next segment.  Longer chains are then checked against their budgets before the
full Hamming distance.  The key covers two thirds of the bits, so buckets stay
small at any corpus size, and nothing is compared outside its bucket.

Work is on distinct fingerprints, copies never meet each other.

Defined results: a null text counts as empty; a text without words has
fingerprint zero and links like any other; fewer words than a shingle hash as
one sequence; repeated rows share fingerprint and component; a row with a null
id takes part, its component is named by the smallest id that is not null (null
if there is none).  Further columns are ignored (:func:`near_dup_report`) or
carried (:func:`near_dedup`).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import utf8_buffers, written
from .components import connected_components

SEED = 42
BITS = 64


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of one UTF-8 text as an unsigned 64-bit integer."""
    words = text.lower().split()  # bytes: folds A-Z and cuts at space and 09-0D only
    if not words:
        return 0
    total, n = np.zeros(BITS, np.int64), max(1, len(words) - shingle + 1)
    for first in range(0, n, 65536):  # bounded temporaries for very long texts
        part = words[first:first + 65536 + shingle - 1]
        grams = (map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle
                 else [b" ".join(words)])
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, itertools.repeat(SEED)), np.uint64)
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = utf8_buffers(b.column("text"))
        fp = np.fromiter((fingerprint(data[off[i]:off[i + 1]].tobytes(), shingle) for i in range(b.num_rows)),
                         np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(partial(_fingerprints, shingle=shingle), "doc_id long, fp long"))


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment of the ring."""
    m = max_bits + 1
    cut = [round(i * BITS / m) for i in range(m + 1)]
    return [(cut[i], cut[i + 1] - cut[i]) for i in range(m)]


def _segment(fp, low: int, width: int):
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def flip_masks(width: int, most: int) -> list[int]:
    """All masks with at most ``most`` bits out of ``width``."""
    return [sum(1 << i for i in c) for k in range(most + 1) for c in itertools.combinations(range(width), k)]


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) that differ in 1 to ``max_bits`` bits."""
    if max_bits < 1:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    seg = segments(max_bits)
    m = len(seg)
    budget = [max_bits * n // m for n in range(1, m + 1)]  # of a chain of n segments
    fp = F.col("fp")
    # rows that grow by a factor next: dealt out to a fixed number of tasks, which adaptive execution doesn't merge
    rows = fps.select("fp").distinct().repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = [_segment(fp, low, width) for low, width in seg]
    index = rows.select(fp.alias("b"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("s"), part[i].alias("k0"), part[(i + 1) % m].alias("k1")) for i in range(m)])).alias("k"))
    query = rows.select(fp.alias("a"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("s"), part[i].alias("k0"), part[(i + 1) % m].bitwiseXOR(F.lit(mask)).alias("k1"))
        for i in range(m) for mask in flip_masks(seg[(i + 1) % m][1], budget[1])])).alias("k"))
    pairs = (query.select("a", "k.s", "k.k0", "k.k1")
             .join(index.select("b", "k.s", "k.k0", "k.k1"), ["s", "k0", "k1"]).where("a < b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    bits = [F.bit_count(_segment(differ, low, width)) for low, width in seg]
    within = F.lit(False)  # from the start segment of the bucket, every chain within its budget
    for i in range(m):
        chain = F.col("s") == i
        for n in range(1, m + 1):
            chain = chain & (sum((bits[(i + j) % m] for j in range(n)), F.lit(0)) <= budget[n - 1])
        within = within | chain
    return pairs.where(within).where(F.bit_count(differ) <= max_bits).select("a", "b").distinct()


def near_dup_report(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest id reachable)."""
    fps = written(fingerprints(docs, shingle), "simhash")
    per_fp = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    near = connected_components(links(per_fp, max_bits))
    rooted = per_fp.join(near, per_fp["fp"] == near["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first_id")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One document of each component stays, with all its columns: the one with the smallest id.

    Rows that repeat an id and its text count as one document; rows that share
    an id but not the text are told apart by nothing and stay or go together;
    rows with a null id stay.
    """
    report = written(near_dup_report(docs, shingle, max_bits), "simhash-report")
    ids = written(report.where("doc_id IS NOT NULL").groupBy("doc_id")
                  .agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias("n"))
                  .where("c <> doc_id OR n > 1").select(F.col("doc_id").alias("id_"), (F.col("c") != F.col("doc_id")).alias("gone"), "n"), "simhash-ids")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"),
                       F.col("text").alias("text"))
    plain = rows.join(ids, F.col("id") == F.col("id_"), "left_anti").select("row")
    repeated = (rows.join(ids.where("NOT gone"), F.col("id") == F.col("id_"))
                .dropDuplicates(["id", "text"]).select("row"))
    return plain.unionByName(repeated).select("row.*")
