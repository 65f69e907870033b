"""Exact deduplication against a history kept as minimal perfect hashes.

The distinct digests of the historical rows are dealt by digest into shards.
Each shard becomes a minimal perfect hash: levels of bit arrays in which every
digest that falls alone into its cell settles, the rest moving on to the next
level; the rank of the cell is the digest's slot.  A slot holds the full
digest and the locator (id) of the winning row, so a lookup compares all 32
bytes and a foreign digest is never taken for a member.

New rows are aggregated by digest first (the hot text becomes one row per
task), then looked up shard by shard; members join the historical group,
nonmembers form groups of their own.  Only (id, digest) moves between
executors, never the text.

Defined results: a null text counts as empty; a null id loses against any
other; of equal texts the largest id stays; rows repeating the winning id and
text all carry kept = true in :func:`dedup_report`, while :func:`dedup` returns
exactly one of them.  An empty table gives an empty result.  Further columns
are carried by :func:`dedup` and ignored by :func:`dedup_report`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written

#: Cells per digest on each level of a shard's hash.
GAMMA = 2.0
MAX_LEVELS = 48


def _words(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)


def _cell(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Cell of each digest on a level: all 256 bits mixed with the level number."""
    with np.errstate(over="ignore"):
        x = words[:, 0] + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        for i in (1, 2, 3):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + words[:, i]
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x % np.uint64(size)


def build_shard(digests: np.ndarray, winners: np.ndarray, counts: np.ndarray) -> dict:
    """Minimal perfect hash of distinct 32-byte digests (uint8, n x 32) and the slots in its order."""
    words, left, levels, slot, used = _words(digests), np.arange(len(digests)), [], np.empty(len(digests), np.int64), 0
    while len(left) and len(levels) < MAX_LEVELS:
        size = max(1, int(math.ceil(GAMMA * len(left))))
        cell = _cell(words[left], len(levels), size)
        alone = np.bincount(cell.astype(np.int64), minlength=size) == 1
        settled = alone[cell.astype(np.int64)]
        rank = np.cumsum(alone) - 1
        slot[left[settled]] = used + rank[cell[settled].astype(np.int64)]
        used += int(alone.sum())
        levels.append((size, np.packbits(alone)))
        left = left[~settled]
    slot[left] = used + np.arange(len(left))  # what no level parted: looked up by scanning these few slots
    order = np.argsort(slot)
    return {"sizes": [s for s, _ in levels], "bits": b"".join(b.tobytes() for _, b in levels), "rest": len(left),
            "digests": np.ascontiguousarray(digests[order]).tobytes(), "winners": winners[order], "counts": counts[order]}


def lookup_shard(shard: dict, digests: np.ndarray) -> np.ndarray:
    """Slot of each digest, or -1 where the slot's 32 bytes differ."""
    n, words = len(digests), _words(digests)
    held = np.frombuffer(shard["digests"], np.uint8).reshape(-1, 32)
    found, open_, used, at = np.full(n, -1, np.int64), np.arange(n), 0, 0
    for level, size in enumerate(shard["sizes"]):
        nbytes = (size + 7) // 8
        alone = np.unpackbits(np.frombuffer(shard["bits"], np.uint8, nbytes, at), count=size).astype(bool)
        at += nbytes
        cell = _cell(words[open_], level, size).astype(np.int64)
        hit = alone[cell]
        found[open_[hit]] = used + (np.cumsum(alone) - 1)[cell[hit]]
        used += int(alone.sum())
        open_ = open_[~hit]
    ok = found >= 0
    ok[ok] = (held[found[ok]] == digests[ok]).all(axis=1)
    found[~ok] = -1
    for s in range(len(held) - shard["rest"], len(held)):
        found[(digests == held[s]).all(axis=1)] = s
    return found


def _digest_matrix(column) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(-1, 32)


INDEX_SCHEMA = ("shard int, sizes array<long>, bits binary, rest int, digests binary, "
                "winners array<long>, winner_null array<boolean>, counts array<long>")


def _winners(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    w = table.column("winner")
    return w.fill_null(0).to_numpy().astype(np.int64), np.asarray(pc.is_null(w)).astype(bool)


def _build(table: pa.Table) -> pa.Table:
    digests = _digest_matrix(table.column("digest"))
    winners, null = _winners(table)
    counts = table.column("n").to_numpy().astype(np.int64)
    shard = build_shard(digests, np.arange(len(digests)), counts)
    order = shard["winners"]  # the rows in slot order
    return pa.table({
        "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
        "sizes": pa.array([shard["sizes"]], pa.list_(pa.int64())), "bits": pa.array([shard["bits"]], pa.binary()),
        "rest": pa.array([shard["rest"]], pa.int32()), "digests": pa.array([shard["digests"]], pa.binary()),
        "winners": pa.array([winners[order].tolist()], pa.list_(pa.int64())),
        "winner_null": pa.array([null[order].tolist()], pa.list_(pa.bool_())),
        "counts": pa.array([shard["counts"].tolist()], pa.list_(pa.int64()))})


def _groups(digests: DataFrame) -> DataFrame:
    """digest, winner (largest id), n rows, n_winner rows with that id: hot texts shrink before the shuffle."""
    by_id = digests.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by_id.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.sum("n").alias("n"),
                                       F.max_by("n", F.coalesce("doc_id", F.lit(-2**63))).alias("n_winner"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """Index table (one row per shard) over historical rows (doc_id, digest)."""
    g = _groups(history).withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))
    return g.select("shard", "digest", "winner", "n").groupBy("shard").applyInArrow(_build, INDEX_SCHEMA)


LOOKUP_SCHEMA = "digest binary, winner long, n long, hist_n long, member boolean"


def _look_up(left: pa.Table, right: pa.Table) -> pa.Table:
    """left: the shard's index row (or none); right: distinct new digests."""
    digests = _digest_matrix(right.column("digest")) if right.num_rows else np.zeros((0, 32), np.uint8)
    new_w, new_null = _winners(right) if right.num_rows else (np.zeros(0, np.int64), np.zeros(0, bool))
    new_n = right.column("n").to_numpy().astype(np.int64) if right.num_rows else np.zeros(0, np.int64)
    lowest = np.iinfo(np.int64).min
    new_key = np.where(new_null, lowest, new_w)
    slot = np.full(len(digests), -1, np.int64)
    out_d, out_w, out_null, out_n, out_h = [digests], [], [], [], []
    if left.num_rows:
        r = left.slice(0, 1).to_pylist()[0]
        hist_d = np.frombuffer(r["digests"], np.uint8).reshape(-1, 32)
        hist_w, hist_null = np.array(r["winners"], np.int64), np.array(r["winner_null"], bool)
        hist_n = np.array(r["counts"], np.int64)
        slot = lookup_shard(r, digests)
    member = slot >= 0
    w, null, n, h = new_w.copy(), new_null.copy(), new_n.copy(), np.zeros(len(digests), np.int64)
    if left.num_rows:
        s = slot[member]
        older = np.where(hist_null[s], lowest, hist_w[s])
        better = older > new_key[member]
        w[member] = np.where(better, hist_w[s], new_w[member])
        null[member] = hist_null[s] & new_null[member]
        h[member] = hist_n[s]
        n[member] += hist_n[s]
        lone = np.ones(len(hist_w), bool)  # historical texts that no new row repeats
        lone[s] = False
        out_d.append(hist_d[lone])
        w, null = np.concatenate([w, hist_w[lone]]), np.concatenate([null, hist_null[lone]])
        n, h = np.concatenate([n, hist_n[lone]]), np.concatenate([h, hist_n[lone]])
        member = np.concatenate([member, np.zeros(int(lone.sum()), bool)])
    d = np.concatenate(out_d)
    return pa.table({"digest": pa.array([x.tobytes() for x in d], pa.binary()),
                     "winner": pa.array(w, pa.int64(), mask=null), "n": pa.array(n, pa.int64()),
                     "hist_n": pa.array(h, pa.int64()), "member": pa.array(member, pa.bool_())})


def resolve(digests: DataFrame, is_history: Column, digests_per_shard: int = 100_000) -> DataFrame:
    """Groups of equal digests over history and new rows.

    ``digests``: doc_id, digest (32 bytes).  Returns digest, winner, n (rows in the
    group), hist_n (of them historical), member (a new text found in the history).
    The number of shards follows the number of rows, so a shard stays within
    ``digests_per_shard`` digests on average whatever the size of the corpus.
    """
    rows = digests.withColumn("_old", F.coalesce(is_history, F.lit(False)))
    shards = max(16, math.ceil(rows.count() / digests_per_shard))
    index = written(build_index(rows.where("_old").drop("_old"), shards), "mph-index")
    new = (_groups(rows.where(~F.col("_old")).drop("_old"))
           .withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))
           .select("shard", "digest", "winner", "n"))
    return index.groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(_look_up, LOOKUP_SCHEMA)


def with_digest(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("digest"))


def older_half(digests: DataFrame) -> Column:
    """The history of a table that arrives as one: rows up to the (approximate) median id.

    Every row is read on one side or the other; where the cut lies changes no result.
    """
    cut = digests.agg(F.percentile_approx("doc_id", 0.5, 1000).alias("m")).first()["m"]
    return F.col("doc_id") <= F.lit(cut if cut is not None else 0)


def dedup_report(docs: DataFrame, is_history: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, in_history."""
    digests = written(with_digest(docs), "digests")
    groups = resolve(digests, older_half(digests) if is_history is None else is_history)
    # a text with very many copies makes a hot key here: the row side is narrow and AQE splits it
    return (digests.join(groups, "digest")
            .select("doc_id", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"),
                    F.col("doc_id").eqNullSafe(F.col("winner")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256"), (F.col("hist_n") > 0).alias("in_history")))


def dedup(docs: DataFrame, is_history: Column | None = None) -> DataFrame:
    """The documents that stay, all their columns: exactly one row per distinct text."""
    report = written(dedup_report(docs, is_history), "exact-report")
    keep = (report.where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("_n"))
            .select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "_n"))
    keep = written(keep, "exact-keep")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"),
                       F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("sha"))  # no name can clash
    match = lambda k: rows.join(k, rows["id"].eqNullSafe(F.col("_id")) & (rows["sha"] == F.col("_sha")))
    once = match(keep.where("_n = 1")).select("row.*")
    many = match(keep.where("_n > 1")).dropDuplicates(["id", "sha"]).select("row.*")
    return once.unionByName(many)
