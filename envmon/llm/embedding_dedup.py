"""Embedding near-duplicates by sorted projection passes.

Equal vectors of one label form a class; classes are what is compared.  Each
class gets a signature of random hyperplane hashes.  A pass orders the
classes lexicographically by label and the signature rotated to the pass's own
hashes, so that similar vectors come near each other, and compares every class
with the next ``window`` ones.  Pairs whose signatures differ in more bits than
:func:`most_differing` (over six standard deviations beyond what the threshold
expects) are dropped there; the rest are verified by the exact cosine in double
precision.  Links of all passes are united into components.

How many passes there are follows from the largest label (:func:`passes_for`): two
vectors at the threshold meet in a pass if they agree in the hashes that part
the label down to a window, each with a known probability, so the share of such
pairs that no pass brings together can be held under ``miss`` whatever the size.
The signature grows with the passes, which each open with hashes of their own.

A row whose window is still full of such candidates at its edge has more of them
beyond.  It forms a crowd with its candidates, and crowds that share a class are
one.  Within a crowd every class is compared with every other: its classes are
dealt into blocks of bounded size, and the blocks into groups; a task gets two groups
and multiplies each block of one with each of the other, which
returns the number of links per class and a spanning forest of the links instead
of the links.  A block is sent once per group, not once per block.  Pairs of a
crowd that windows found are left to the products.

The order is Spark's range-partitioned sort on (pass, label, signature, class),
which also parts labels and groups that hold a large share of the rows.  Windows
that span two partitions are compared in a second step, from the rows near the
partitions' ends.

Defined results: labels that differ or are null never link; a vector that is
null, empty, zero or holds a null or non-finite component links with nothing;
vectors of different lengths never link; equal vectors always link, each
repeated row counts as a vector of its own; a null id links with nothing.  Finite
components of any size count: vectors are scaled by their largest component first.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import one_array, written
from .components import connected_components

#: Hashes of a signature and passes, at least; hashes are a multiple of 64.
BITS, PASSES = 256, 16


def differ_probability(cosine: float) -> float:
    """How likely a random hyperplane parts two vectors of this cosine."""
    return math.acos(min(1.0, max(-1.0, cosine))) / math.pi


def most_differing(bits: int, least: float) -> int:
    """Bits in which the signatures of linked vectors may differ: over six standard deviations beyond the expected."""
    p = differ_probability(least)
    return math.ceil(bits * p + 6.4 * math.sqrt(bits * p * (1 - p)))


def passes_for(largest: int, least: float, window: int, miss: float) -> tuple[int, int]:
    """(passes, bits) for a label of ``largest`` classes, so that at most a share ``miss`` of the pairs at the threshold is lost.

    A window of w rows holds all rows that agree in about log2(n / w) hashes; one more is taken, as the place in the window varies.
    """
    prefix = max(1.0, math.log2(max(2, largest) / window) + 1)
    meet = (1 - differ_probability(least)) ** prefix
    passes = max(PASSES, math.ceil(math.log(miss) / math.log1p(-meet)))
    own = max(BITS // PASSES, math.ceil(math.log2(max(2, largest))))
    return passes, -(-max(BITS, passes * own) // 64) * 64


#: Rows and bytes of a block of a crowd; the rows of a block whose products are held at a time.
CROWD_ROWS = 4096
CROWD_BYTES = 4 << 20
STRIP = 512
#: Blocks of a group at most, once a crowd has so many groups.
GROUP_BLOCKS, GROUPS = 16, 24


@lru_cache(maxsize=8)
def _planes(dim: int, bits: int) -> np.ndarray:
    return np.random.default_rng(dim + 7919).standard_normal((bits, dim)).T


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows by their largest component: no overflow or underflow in products."""
    return x / np.abs(x).max(axis=1, keepdims=True, initial=0) if len(x) else x


def _matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, offsets, usable) of a list column as doubles."""
    bad = np.asarray(pc.is_null(lists)).astype(bool)
    lists = pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists
    off = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(off[0], off[-1] - off[0])
    v = pc.fill_null(values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False) + 0.0
    return v, off - off[0], ~bad


def _prepare(batches: Iterator[pa.RecordBatch], vectors: bool, bits: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = one_array(b.column("embedding"))
        v, off, ok = _matrix(lists)
        size = np.diff(off)
        ok = ok & (size > 0) & ~np.asarray(pc.is_null(b.column("label"))).astype(bool) \
            & ~np.asarray(pc.is_null(b.column("vec_id"))).astype(bool)
        digest: list[bytes | None] = [None] * len(ok)
        sig: list[bytes | None] = [None] * len(ok)
        for dim in np.unique(size[ok]).tolist():
            rows = np.flatnonzero(ok & (size == dim))
            x = v[off[rows][:, None] + np.arange(dim)]
            fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            ok[rows[~fine]] = False
            rows, x = rows[fine], x[fine]
            signs = np.packbits(_scaled(x) @ _planes(dim, bits) > 0, axis=1) if bits else None
            for i, r in enumerate(rows.tolist()):
                digest[r] = hashlib.blake2b(v[off[r]:off[r + 1]].tobytes(), digest_size=16).digest()
                sig[r] = signs[i].tobytes() if bits else None
        cols = [b.column("vec_id"), b.column("label"), pa.array(ok), pa.array(size.astype(np.int32)),
                pa.array(digest, pa.binary()), pa.array(sig, pa.binary())]
        names = ["vec_id", "label", "ok", "dim", "digest", "sig"]
        if vectors:
            cols.append(lists)
            names.append("vector")
        yield pa.RecordBatch.from_arrays(cols, names)


def prepare(embeddings: DataFrame, vectors: bool = False, bits: int = 0) -> DataFrame:
    """vec_id, label (as string), ok, dim, digest, sig (of ``bits`` hashes, else null) of every row, and its vector if asked for."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                             "embedding")
    return rows.mapInArrow(partial(_prepare, vectors=vectors, bits=bits),
                           "vec_id long, label string, ok boolean, dim int, digest binary, sig binary"
                           + (f", vector {embeddings.schema['embedding'].dataType.simpleString()}" if vectors else ""))


def _rotations(batches: Iterator[pa.RecordBatch], passes: int, width: int) -> Iterator[pa.RecordBatch]:
    """One row per class and pass: the signature of ``width`` hashes from the pass's first hash on."""
    step = width // passes
    for b in batches:
        raw = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(b.num_rows, width // 8)
        bits = np.unpackbits(raw, axis=1)
        for p in range(passes):
            key = np.packbits(np.roll(bits, -p * step, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(b.num_rows, p, np.int32)), b.column("label"), b.column("dim"),
                 pa.array([k.tobytes() for k in key], pa.binary()), b.column("cid")], ["pass", "label", "dim", "key", "cid"])


ROW = "pass int, label string, dim int, key binary, cid long"


class _Rows:
    """Rows in order: signatures as words, ids, and numbers that are equal within one (pass, label, length)."""

    def __init__(self, t):
        self.n = t.num_rows
        self.cid = t.column("cid").to_numpy()
        keys = b"".join(t.column("key").to_pylist())
        self.words = np.frombuffer(keys, "<u8").reshape(self.n, len(keys) // 8 // max(1, self.n))
        groups = list(zip(t.column("pass").to_pylist(), t.column("label").to_pylist(), t.column("dim").to_pylist()))
        self.group = np.cumsum([0] + [a != b for a, b in zip(groups, groups[1:])]) if self.n else np.zeros(0, np.int64)


def near_in_order(r: _Rows, window: int, differ: int, split: int = 0, carried: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs at most ``window`` rows apart, and whether a pair ties a crowd together.

    With ``split`` only pairs across that row, with ``carried`` only those that end there or
    later.  The candidates of a row whose window is full at its edge (half of the last quarter)
    come as a chain through all of them, tied, which most rows of a crowd share.
    """
    reach = min(window, r.n - 1)
    near = np.zeros((max(reach, 0) + 1, r.n), bool)  # [o, x]: rows x and x + o
    for o in range(1, reach + 1):
        x = np.flatnonzero(r.group[:-o] == r.group[o:])
        near[o, x] = np.bitwise_count(r.words[x] ^ r.words[x + o]).sum(axis=1) <= differ
    edge = range(window - max(1, window // 4) + 1, reach + 1)
    least = max(1, window // 4) / 2
    ahead, behind = np.zeros(r.n, np.int64), np.zeros(r.n, np.int64)
    for o in edge:
        ahead += near[o]
        behind[o:] += near[o, :-o]
    ahead, behind = ahead >= least, behind >= least
    tie = np.zeros_like(near)
    last, first = np.arange(r.n), np.arange(r.n)  # of each row: the candidate reached so far, on either side
    for o in range(1, reach + 1):
        x = np.flatnonzero(near[o] & ahead)
        tie[x + o - last[x], last[x]] = True
        last[x] = x + o
        y = np.flatnonzero(near[o, :-o] & behind[o:]) + o
        tie[first[y] - (y - o), y - o] = True
        first[y] = y - o
    for o in range(1, reach + 1):
        near[o] &= ~ahead
        near[o, :-o] &= ~behind[o:]
        if split:
            near[o, :max(0, split - o)] = near[o, split:] = False
        near[o, :max(0, carried - o)] = False
    out = [np.nonzero(near), np.nonzero(tie)]
    x = np.concatenate([at for _, at in out])
    y = np.concatenate([at + o for o, at in out])
    a, b = r.cid[x], r.cid[y]
    return np.minimum(a, b), np.maximum(a, b), np.repeat([False, True], [len(at) for _, at in out])


SCAN_SCHEMA = "a long, b long, tied boolean, part int, place long, " + ROW


def _scan(batches: Iterator[pa.RecordBatch], window: int, differ: int) -> Iterator[pa.RecordBatch]:
    """Pairs within a partition, and its first and last ``window`` rows with their places."""
    part, place, names = TaskContext.get().partitionId(), 0, ["pass", "label", "dim", "key", "cid"]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.int64()]
    tail, head = None, []

    def edges(t: pa.Table, first: int) -> pa.RecordBatch:
        n = t.num_rows
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [none, none, pa.nulls(n, pa.bool_()), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(first, first + n))]
            + [one_array(t.column(c)).cast(k) for c, k in zip(names, kinds)], ["a", "b", "tied", "part", "place", *names])

    for b in batches:
        t = pa.Table.from_batches([b])
        if place < window:
            yield edges(t.slice(0, window - place), place)
        both = pa.concat_tables([tail, t]) if tail is not None else t
        x, y, tied = near_in_order(_Rows(both), window, differ, carried=both.num_rows - t.num_rows)  # ties may come twice
        n = len(x)
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(tied), pa.nulls(n, pa.int32()),
                                          pa.nulls(n, pa.int64())] + [pa.nulls(n, k) for k in kinds],
                                         ["a", "b", "tied", "part", "place", *names])
        tail = both.slice(max(0, both.num_rows - window))
        place += t.num_rows
    if tail is not None:
        yield edges(tail, place - tail.num_rows)


def _spread(batches: Iterator[pa.RecordBatch], before: dict[int, int], bounds: np.ndarray, window: int):
    """Each row near a partition's end, once per bound that is at most ``window`` rows away."""
    for b in batches:
        rank = np.array([before[p] for p in b.column("part").to_pylist()], np.int64) + b.column("place").to_numpy()
        lo = np.searchsorted(bounds, rank - window, side="right")
        hi = np.searchsorted(bounds, rank + window, side="right")
        n = hi - lo
        rows = np.repeat(np.arange(b.num_rows), n)
        which = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        t = b.take(pa.array(rows))
        yield pa.RecordBatch.from_arrays([pa.array(bounds[which]), pa.array(rank[rows])] + [t.column(c) for c in
                                         ("pass", "label", "dim", "key", "cid")],
                                         ["bound", "rank", "pass", "label", "dim", "key", "cid"])


def _across(table: pa.Table, window: int, differ: int) -> pa.Table:
    rank = table.column("rank").to_numpy()
    rank, first = np.unique(rank, return_index=True)  # a short partition's rows are both first and last ones
    t = table.take(pa.array(first))
    bound = t.column("bound")[0].as_py()
    split = int(np.searchsorted(rank, bound))
    x, y, tied = near_in_order(_Rows(t), window, differ, split) if 0 < split < len(rank) else (
        np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    return pa.table({"a": pa.array(x), "b": pa.array(y), "tied": pa.array(tied)})


def candidates(classes: DataFrame, passes: int, bits: int, window: int, differ: int) -> DataFrame:
    """Distinct pairs a < b of classes (label, dim, sig, cid) that some pass brings near each other.

    ``tied`` pairs tell which classes form a crowd, whose other pairs are mostly left out.
    """
    order = ["pass", "label", "dim", "key", "cid"]
    rows = classes.select("label", "dim", "sig", "cid").mapInArrow(partial(_rotations, passes=passes, width=bits), ROW)
    scanned = written(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                      .mapInArrow(partial(_scan, window=window, differ=differ), SCAN_SCHEMA), "pass-scan")
    edge = scanned.where("part IS NOT NULL")
    sizes = {r["part"]: r["n"] + 1 for r in edge.groupBy("part").agg(F.max("place").alias("n")).collect()}  # per partition
    total, before = 0, {}
    for p in sorted(sizes):
        before[p] = total
        total += sizes[p]
    bounds = np.array(sorted(before.values())[1:], np.int64)
    pairs = scanned.where("a IS NOT NULL").select("a", "b", "tied")
    if len(bounds):
        spread = edge.select("part", "place", *order).mapInArrow(
            partial(_spread, before=before, bounds=bounds, window=window), "bound long, rank long, " + ROW)
        pairs = pairs.unionByName(spread.groupBy("bound").applyInArrow(lambda t: _across(t, window, differ), "a long, b long, tied boolean"))
    return pairs.where("a <> b").distinct()


def _cosines(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, off, _ = _matrix(one_array(b.column("x")))
        y, _, _ = _matrix(one_array(b.column("y")))
        size, keep = np.diff(off), np.zeros(b.num_rows, bool)
        for dim in np.unique(size).tolist():
            rows = np.flatnonzero(size == dim)
            at = off[rows][:, None] + np.arange(dim)
            p, q = _scaled(x[at]), _scaled(y[at])
            keep[rows] = (p * q).sum(axis=1) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1)) >= least
        yield b.select(["a", "b"]).filter(pa.array(keep))


def _pack(table: pa.Table) -> pa.Table:
    """A block of a crowd as one row: ids, sizes and unit vectors of its classes."""
    v, off, _ = _matrix(one_array(table.column("vector")))
    x = v.reshape(len(off) - 1, -1)
    x = _scaled(x)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return pa.table([table.column("crowd").slice(0, 1), table.column("blocks").slice(0, 1), table.column("block").slice(0, 1),
                     pa.array([table.column("cid").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                     pa.array([table.column("n").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                     pa.array([x.tobytes()], pa.binary())], names=["crowd", "blocks", "block", "cids", "sizes", "units"])


def spanning_forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of links that connect what the links of a two-sided graph connect."""
    n, m = near.shape
    sides, left = (near, np.ascontiguousarray(near.T)), (np.ones(m, bool), np.ones(n, bool))
    rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for root in range(n):
        if not left[1][root]:
            continue
        left[1][root] = False
        todo = [(0, root)]
        while todo:
            side, at = todo.pop()
            new = np.flatnonzero(sides[side][at] & left[side])
            left[side][new] = False
            rows.append(np.full(len(new), at) if side == 0 else new)
            columns.append(new if side == 0 else np.full(len(new), at))
            todo += [(1 - side, i) for i in new.tolist()]
    return np.concatenate(rows), np.concatenate(columns)


CROWD_SCHEMA = "a long, b long, more long"


def _products(p, n, x, q, m, y, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links between two blocks (ids, sizes, units of each) or within one: vectors linked per class of either, connecting links."""
    near = np.zeros((len(p), len(q)), bool)
    for at in range(0, len(p), STRIP):
        near[at:at + STRIP] = x[at:at + STRIP] @ y.T >= least
    if same:
        near |= near.T
        np.fill_diagonal(near, False)
    i, j = spanning_forest(near)
    linked = lambda rows, sizes: np.concatenate([rows[a:a + STRIP] @ sizes for a in range(0, len(rows), STRIP)])
    return linked(near, m), linked(near.T, n), np.minimum(p[i], q[j]), np.maximum(p[i], q[j])


def _groups_met(table: pa.Table, least: float) -> pa.Table:
    """(class, null, vectors linked) and connecting (a, b, null) of all pairs of blocks of two groups (or within one)."""
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    t = sorted(table.select(["block", "grp", "cids", "sizes", "units"]).to_pylist(), key=lambda r: r["block"])
    blocks = [(r["block"], r["grp"], ids := np.frombuffer(r["cids"], np.int64), np.frombuffer(r["sizes"], np.int64),
               np.frombuffer(r["units"]).reshape(len(ids), -1)) for r in t]
    more = [np.zeros(len(b[2]), np.int64) for b in blocks]
    links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, (k, g, p, n, x) in enumerate(blocks):
        for u, (l, h, q, m, y) in enumerate(blocks):
            if (l < k or (i != j and g == h)):
                continue
            here, there, a, b = _products(p, n, x, q, m, y, least, k == l)
            more[s] += here
            if k != l:
                more[u] += there
            links_a.append(a)
            links_b.append(b)
    ids, count = (np.concatenate([b[2] for b in blocks]), np.concatenate(more)) if blocks else (np.zeros(0, np.int64),) * 2
    ids, count, a, b = ids[count > 0], count[count > 0], np.concatenate(links_a), np.concatenate(links_b)
    return pa.table([pa.array(np.concatenate([ids, a])), pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(b)]),
                     pa.concat_arrays([pa.array(count), pa.nulls(len(a), pa.int64())])], names=["a", "b", "more"])


def crowd_links(members: DataFrame, least: float) -> DataFrame:
    """a, null, vectors linked with class a (to be added up); and a, b, null: links that connect what all links connect.

    ``members``: crowd, cid, n, vector.  Every pair of classes of one crowd is compared.
    """
    per_block = F.greatest(F.lit(1), F.least(F.lit(CROWD_ROWS), F.lit(CROWD_BYTES) / (8 * F.size("vector"))))
    sizes = members.groupBy("crowd").agg(F.ceil(F.count(F.lit(1)) / F.min(per_block)).cast("int").alias("blocks"))
    dealt = members.join(sizes, "crowd").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.repartition("crowd", "block")  # the join's own deal, by crowd, would put a whole crowd in one task
    blocks = written(dealt.groupBy("crowd", "block").applyInArrow(
        _pack, "crowd long, blocks int, block int, cids binary, sizes binary, units binary"), "crowd-blocks")
    groups = F.least(F.col("blocks"), F.greatest(F.lit(GROUPS), F.ceil(F.col("blocks") / GROUP_BLOCKS))).cast("int")
    blocks = blocks.withColumns({"groups": groups, "grp": F.pmod(F.col("block"), groups).cast("int")})
    other = F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("other")
    met = blocks.select("*", other).withColumns({"i": F.least("grp", "other"), "j": F.greatest("grp", "other")})
    return met.groupBy("crowd", "i", "j").applyInArrow(lambda t: _groups_met(t, least), CROWD_SCHEMA)


def near_dup_report(embeddings: DataFrame, least: float = 0.93, window: int = 128, miss: float = 0.005) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest id reachable), kept.

    ``miss``: the share of the pairs at the threshold, outside crowds, that the passes may not bring together.
    """
    rows = written(prepare(embeddings).drop("sig"), "vectors")
    key = ["label", "dim", "digest"]
    largest = rows.where("ok").groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0  # one number
    passes, bits = passes_for(largest, least, window, miss)
    classes = written(prepare(embeddings, bits=bits).where("ok").groupBy(*key, "sig").agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    found = written(candidates(classes, passes, bits, window, most_differing(bits, least)), "vector-pairs")
    crowds = written(connected_components(found.where("tied").select("a", "b"))
                     .select(F.col("node").alias("cid"), F.col("root").alias("crowd")), "vector-crowds")
    pairs = (found.where("NOT tied").select("a", "b")
             .join(crowds.select(F.col("cid").alias("a"), F.col("crowd").alias("crowd_a")), "a", "left")
             .join(crowds.select(F.col("cid").alias("b"), F.col("crowd").alias("crowd_b")), "b", "left")
             .where("crowd_a IS NULL OR crowd_b IS NULL OR crowd_a <> crowd_b").select("a", "b"))
    pairs = written(pairs, "vector-pairs-apart")
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).union(crowds.select("cid")).distinct()
    named = classes.join(wanted, "cid", "left_semi").select(*key, F.col("first_id").alias("vec_id"), "cid")
    vectors = (prepare(embeddings, vectors=True).where("ok").select("vec_id", *key, "vector")
               .join(named, ["vec_id", *key]).select("cid", "vector").dropDuplicates(["cid"]))
    vectors = written(vectors, "class-vectors")
    links = written(pairs.join(vectors.select(F.col("cid").alias("a"), F.col("vector").alias("x")), "a")
                    .join(vectors.select(F.col("cid").alias("b"), F.col("vector").alias("y")), "b")
                    .select("a", "b", "x", "y").mapInArrow(partial(_cosines, least=least), "a long, b long"),
                    "vector-links")
    crowded = written(crowd_links(vectors.join(crowds, "cid").join(classes.select("cid", "n"), "cid"), least), "crowd-links")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = (both.join(classes.select(F.col("cid").alias("b"), "n"), "b").select("a", F.col("n").alias("more"))
            .unionByName(crowded.where("b IS NULL").select("a", "more")).groupBy(F.col("a").alias("cid"))
            .agg(F.sum("more").alias("more")))
    near = connected_components(links.unionByName(crowded.where("b IS NOT NULL").select("a", "b")))
    named = (classes.join(more, "cid", "left").join(near.withColumnRenamed("node", "cid"), "cid", "left")
             .select(*key, "first_id", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
                     F.coalesce("root", "cid").alias("root")))
    named = written(named, "class-links")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    info = written(named.join(smallest, "root").select(*key, "n_links", "component_id"), "class-report")
    # one class may hold a large share of the rows: the row side is narrow and AQE splits it
    out = rows.where("ok").join(info, key).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                        F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
