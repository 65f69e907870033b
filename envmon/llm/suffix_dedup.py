"""Exact substring deduplication by longest-previous-factor arrays.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id; the first copy stays.  Matches are judged on the
input and never cross documents.

No task can hold the suffix array of a large corpus, so the suffixes are dealt
into buckets such that equal strings always meet:

* Every window of ``LENGTH`` bytes has an anchor, its smallest hashed gram
  (leftmost of equals).  The anchor depends on the window's bytes alone, so
  equal windows have equal anchors, and neighbouring windows mostly share one:
  a run of windows with one anchor is a *context* of 50 to 80 bytes.
* Documents are dealt into blocks by id.  A block sends the distinct anchor
  hashes of its texts to the buckets; a bucket tells which of them occur in
  more than one document.  Text without such an anchor cannot match.
* Of the other contexts a block sends each distinct one once, with its smallest
  document, so that a passage with very many copies reaches a bucket once per
  block; the block's own later copies have that one as their longest previous factor.
  The bucket puts the suffixes that start in all blocks' contexts in order (those of equal
  contexts stand together, so their bytes are compared once) and takes the longest previous
  factor of each over the previous and the next smaller document in suffix order.  Where
  it reaches ``LENGTH``, the window has an earlier copy.
* An anchor with more than ``HEAVY`` different contexts (a frequent line with
  ever other text around it) would fill one bucket.  Its windows are sent one by
  one, to the buckets of their own hashes: equal windows still meet.
* The verdicts return to the blocks, which cut the covered bytes out.

The text is shuffled once (the three uses share the exchange); hashes and
contexts travel packed, per pair of block and bucket.  There are at most ``MOST_BUCKETS``
buckets, so what a block sends stays in proportion to its text however large the corpus is.  In
a bucket the blocks of a group are merged first: equal hashes and contexts become one, and
the rest is parted by hash into as many fine buckets as keep a task's share bounded.
Answers go back by the same way.

Defined results: a null text counts as empty; a null id counts as larger than
any other; rows with the same id never remove from each other; texts below
``LENGTH`` bytes stay; :func:`cut_repeats` drops the fragments of a UTF-8
character that a cut leaves behind; an empty table gives an empty result.
Further columns are carried by :func:`cut_repeats`, ignored by
:func:`repeat_report`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import block_count, one_array, pieces, text_bytes, utf8_buffers

#: Bytes of a repeated string.
LENGTH = 50
#: Bytes of a gram; a window has LENGTH - GRAM + 1 of them.
GRAM = 20
GRAMS = LENGTH - GRAM + 1
#: Text per bucket, for the number of buckets.
BUCKET_BYTES = 8 << 20
#: Windows looked at in one go; a longer text is taken in parts, which changes no window's anchor.
PART = 1 << 20
#: Different contexts of an anchor beyond which its windows are dealt out one by one.
HEAVY = 4096
#: Buckets that blocks send to at most, and text of a group of blocks, which are merged in each bucket.
MOST_BUCKETS, GROUP_BYTES = 4096, 64 << 30
#: Suffixes put in order at a time.
SUFFIXES = 1 << 18
NO_ID = np.iinfo(np.int64).max
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _load64(b: np.ndarray, n: int, at: int) -> np.ndarray:
    """The 8 bytes at each of n positions from ``at`` on, as little-endian integers."""
    return np.ndarray((n,), "<u8", buffer=b, offset=at, strides=(1,))


def _window_hashes(b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hash of the LENGTH bytes from each start on."""
    h = np.zeros(len(start), np.uint64)
    if not len(start):
        return h
    word = _load64(b, len(b) - 7, 0)
    with np.errstate(over="ignore"):
        for i, at in enumerate([*range(0, LENGTH - 8, 8), LENGTH - 8]):
            h = (h ^ word[start + at]) * _MIX[i % 4]
            h ^= h >> np.uint64(31)
    return h


def _windows(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of a byte array: anchor position; and the hash of the gram at every position."""
    n = len(b) - GRAM + 1
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    with np.errstate(over="ignore"):
        h = _load64(padded, n, 0) * _MIX[0] + _load64(padded, n, 8) * _MIX[1] + _load64(padded, n, GRAM - 8) * _MIX[2]
        h ^= h >> np.uint64(32)
        h *= _MIX[3]
        h ^= h >> np.uint64(29)
    low = np.uint64((1 << 24) - 1)
    v = (h & ~low) | np.arange(n, dtype=np.uint64)
    span = 1
    while 2 * span <= GRAMS:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    if span < GRAMS:
        v = np.minimum(v[:-(GRAMS - span)], v[GRAMS - span:])
    return (v & low).astype(np.int64), h


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (row, first window, last window, anchor hash), in row order."""
    out: list[tuple] = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]

    def add(rows: np.ndarray, bounds: np.ndarray, base: int, end: int) -> None:
        """Texts ``rows`` lie in data[base:end], cut at ``bounds``."""
        if end - base < LENGTH:
            return
        anchor, h = _windows(data[base:end])
        cut = np.zeros(len(anchor), bool)
        cut[0] = True
        cut[1:] = anchor[1:] != anchor[:-1]
        edge = np.concatenate([bounds[:-1] - base, bounds[1:] - base - LENGTH + 1])
        cut[edge[(edge >= 0) & (edge < len(cut))]] = True
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(anchor)) - 1
        which = np.searchsorted(bounds, first + base, side="right") - 1
        # texts that are empty share a bound: searchsorted from the right finds the one that holds the byte
        ok = first + base + LENGTH <= bounds[which + 1]
        out.append((rows[which[ok]], first[ok] + base, last[ok] + base, h[anchor[first[ok]]]))

    for i, j in pieces(data, off, PART):
        if j - i == 1 and off[j] - off[i] > PART:
            for base in range(int(off[i]), int(off[j]) - LENGTH + 1, PART):
                end = min(int(off[j]), base + PART + LENGTH - 1)
                add(np.array([i]), np.array([base, end]), base, end)
        else:
            add(np.arange(i, j), off[i:j + 1], int(off[i]), int(off[j]))
    return tuple(np.concatenate(x) for x in zip(*out))


class Block:
    """The documents of one block in a fixed order, and their runs of windows."""

    def __init__(self, table: pa.Table, buckets: int):
        doc = pc.fill_null(one_array(table.column("doc_id")), NO_ID)
        text = pc.fill_null(one_array(table.column("text")), "")
        order = pc.sort_indices(pa.table({"d": doc, "t": text}), [("d", "ascending"), ("t", "ascending")])
        self.table = table.take(order)
        self.docs = doc.take(order).to_numpy().astype(np.int64)
        self.data, self.off = utf8_buffers(self.table.column("text"))
        self.row, self.first, self.last, h = runs(self.data, self.off)
        # distinct hashes in the order (bucket, hash)
        hashes, self.kind = np.unique(h, return_inverse=True)
        bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.kind = place[self.kind.reshape(-1)] if len(order) else self.kind.reshape(-1).astype(np.int64)
        self.hashes, self.bucket = hashes[order], bucket[order]
        self.cuts = np.searchsorted(self.bucket, np.arange(buckets + 1))

    def in_many(self) -> np.ndarray:
        """Which hashes occur in more than one row of the block."""
        low, high = np.full(len(self.hashes), NO_ID), np.full(len(self.hashes), -1)
        np.minimum.at(low, self.kind, self.row)
        np.maximum.at(high, self.kind, self.row)
        return low != high

    def context_counts(self) -> np.ndarray:
        """How many contexts that differ in their first or last bytes or in length each hash has."""
        if not len(self.first):
            return np.zeros(len(self.hashes), np.uint16)
        word = _load64(self.data, len(self.data) - 7, 0)
        with np.errstate(over="ignore"):
            mark = word[self.first] * _MIX[0] ^ word[self.last + LENGTH - 8] * _MIX[1] ^ (self.last - self.first).astype(np.uint64)
        order = np.lexsort((mark, self.kind))
        kind, mark = self.kind[order], mark[order]
        new = np.append(True, (kind[1:] != kind[:-1]) | (mark[1:] != mark[:-1]))
        return np.minimum(np.bincount(kind[new], minlength=len(self.hashes)), 0xFFFF).astype(np.uint16)

    def contexts(self, bits: dict[int, bytes]):
        """Per bucket: (bucket, rows, first and last windows of its runs, context number of each run, contexts, their
        hashes and smallest documents).  A bucket whose bits tell of windows in other buckets comes too, without contexts."""
        shared, heavy = np.zeros((2, len(self.hashes)), bool)
        for k, packed in bits.items():
            a, b = self.cuts[k], self.cuts[k + 1]
            if b > a:
                shared[a:b], heavy[a:b] = np.unpackbits(np.frombuffer(packed, np.uint8)).reshape(2, -1)[:, :b - a]
        chosen = np.flatnonzero(shared[self.kind])
        hot = heavy[self.kind[chosen]]
        chosen, hot = chosen[~hot], chosen[hot]
        n = self.last[hot] - self.first[hot] + 1
        single = np.repeat(self.first[hot] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        own = _window_hashes(self.data, single)
        row = np.concatenate([self.row[chosen], np.repeat(self.row[hot], n)])
        first, last = np.concatenate([self.first[chosen], single]), np.concatenate([self.last[chosen], single])
        h = np.concatenate([self.hashes[self.kind[chosen]], own])
        buckets = len(self.cuts) - 1
        where = np.concatenate([self.bucket[self.kind[chosen]], ((own >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)])
        order = np.argsort(where, kind="stable")
        at = np.searchsorted(where[order], np.arange(buckets + 1))
        raw = memoryview(self.data)
        for k in range(buckets):
            mine = order[at[k]:at[k + 1]]
            if not len(mine) and not any(bits.get(k, b"")):
                continue
            seen: dict[bytes, int] = {}
            number = np.fromiter((seen.setdefault(bytes(raw[f:e]), len(seen)) for f, e in
                                  zip(first[mine].tolist(), (last[mine] + LENGTH).tolist())), np.int64, len(mine))
            lead = np.unique(number, return_index=True)[1]  # rows are in id order: the first run has the smallest id
            key = (h[mine[lead]] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield k, row[mine], first[mine], last[mine], number, list(seen), key, self.docs[row[mine[lead]]]


HASHES_SCHEMA = "grp int, bucket int, block int, hashes binary, many binary, counts binary"


def _send_hashes(table: pa.Table, buckets: int, groups: int) -> pa.Table:
    b = Block(table, buckets)
    many, counts, key = b.in_many(), b.context_counts(), (b.hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    spans = [(k, b.cuts[k], b.cuts[k + 1]) for k in np.flatnonzero(np.diff(b.cuts)).tolist()]
    block = table.column("block")[0].as_py()
    return pa.table([pa.array([block % groups] * len(spans), pa.int32()), pa.array([k for k, _, _ in spans], pa.int32()),
                     pa.array([block] * len(spans), pa.int32()),
                     pa.array([key[x:y].tobytes() for _, x, y in spans], pa.binary()),
                     pa.array([np.packbits(many[x:y]).tobytes() for _, x, y in spans], pa.binary()),
                     pa.array([counts[x:y].tobytes() for _, x, y in spans], pa.binary())],
                    names=["grp", "bucket", "block", "hashes", "many", "counts"])


def _sent(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Hashes, which of them occur in many documents, and counts of contexts, of each row as blocks send them."""
    keys = [np.frombuffer(x, np.uint32) for x in table.column("hashes").to_pylist()]
    many = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(table.column("many").to_pylist(), keys)]
    return keys, many, [np.frombuffer(x, np.uint16) for x in table.column("counts").to_pylist()]


def _united(keys: list[np.ndarray], many: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, whether they occur in many documents, and their contexts."""
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every = every[order]
    at = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    kinds, shared = every[at], np.diff(np.append(at, len(every))) > 1
    for k, m in zip(keys, many):
        shared[np.searchsorted(kinds, k[m])] = True
    return kinds, shared, np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), at)


MERGED_HASHES_SCHEMA = "bucket int, fine int, grp int, n int, hashes binary, many binary, counts binary"


def _planes(a: np.ndarray) -> bytes:
    """Numbers byte by byte, the lowest bytes of all first, compressed."""
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), "zstd", asbytes=True)


def _from_planes(raw: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    b = np.frombuffer(pa.decompress(raw, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(b.T).reshape(-1).view(kind)


def _merge_hashes(table: pa.Table, fine: int) -> pa.Table:
    """A group's distinct hashes of a bucket as their differences in order, one row per fine bucket."""
    kinds, shared, counts = _united(*_sent(table))
    part, rows = kinds % np.uint32(fine), []
    for f in np.unique(part).tolist():
        mine = part == f
        rows.append((table.column("bucket")[0].as_py(), f, table.column("grp")[0].as_py(), int(mine.sum()),
                     _planes(np.diff(kinds[mine], prepend=np.uint32(0))), np.packbits(shared[mine]).tobytes(),
                     _planes(np.minimum(counts[mine], 0xFFFF).astype(np.uint16))))
    kinds_of = [pa.int32()] * 4 + [pa.binary()] * 3
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds_of)],
                    names=[x.split()[0] for x in MERGED_HASHES_SCHEMA.split(", ")])


GROUP_BITS_SCHEMA = "grp int, bucket int, fine int, bits binary"


def _find_shared(table: pa.Table, heavy: int = HEAVY) -> pa.Table:
    """Which hashes of each group occur in several documents of the corpus, and which of those in many contexts."""
    rows = table.select(["n", "hashes", "many", "counts"]).to_pylist()
    keys = [np.cumsum(_from_planes(r["hashes"], r["n"], np.uint32), dtype=np.uint32) for r in rows]
    many = [np.unpackbits(np.frombuffer(r["many"], np.uint8), count=r["n"]).astype(bool) for r in rows]
    kinds, shared, counts = _united(keys, many, [_from_planes(r["counts"], r["n"], np.uint16) for r in rows])
    often = shared & (counts > heavy)
    which = [np.searchsorted(kinds, k) for k in keys]
    bits = [np.packbits(shared[w]).tobytes() + np.packbits(often[w]).tobytes() for w in which]
    return pa.table([table.column("grp"), table.column("bucket"), table.column("fine"), pa.array(bits, pa.binary())],
                    names=["grp", "bucket", "fine", "bits"])


BITS_SCHEMA = "block int, bucket int, bits binary"


def _split_bits(hashes: pa.Table, answers: pa.Table, fine: int) -> pa.Table:
    """A group's answers for each of its blocks."""
    keys, many, counts = _sent(hashes)
    kinds, _, _ = _united(keys, many, counts)
    flags = np.zeros((2, len(kinds)), bool)
    for r in answers.select(["fine", "bits"]).to_pylist():
        mine = np.flatnonzero(kinds % np.uint32(fine) == r["fine"])
        flags[:, mine] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).reshape(2, -1)[:, :len(mine)]
    bits = [np.packbits(flags[0, w]).tobytes() + np.packbits(flags[1, w]).tobytes() for w in (np.searchsorted(kinds, k) for k in keys)]
    return pa.table([hashes.column("block"), hashes.column("bucket"), pa.array(bits, pa.binary())], names=["block", "bucket", "bits"])


CONTEXTS_SCHEMA = "grp int, bucket int, block int, bits binary, keys binary, sizes binary, docs binary, raw_size int, raw binary"


def _packed(contexts: list[bytes]) -> tuple[bytes, int, bytes]:
    raw = b"".join(contexts)
    return np.array([len(c) for c in contexts], np.uint8).tobytes(), len(raw), pa.compress(raw, "zstd", asbytes=True)


def _unpacked(row: dict) -> list[bytes]:
    raw = pa.decompress(row["raw"], row["raw_size"], "zstd", asbytes=True) if row["raw_size"] else b""
    end = np.cumsum(np.frombuffer(row["sizes"], np.uint8).astype(np.int64)).tolist()
    return [raw[a:b] for a, b in zip([0, *end], end)]


def _send_contexts(texts: pa.Table, bits: pa.Table, buckets: int, groups: int) -> pa.Table:
    rows: dict[str, list] = {c.split()[0]: [] for c in CONTEXTS_SCHEMA.split(", ")}
    if texts.num_rows:
        packed = dict(zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist()))
        block = texts.column("block")[0].as_py()
        for k, _, _, _, _, contexts, key, docs in Block(texts, buckets).contexts(packed):
            sizes, raw_size, raw = _packed(contexts)
            values = (block % groups, k, block, packed.get(k, b""), key.tobytes(), sizes, docs.tobytes(), raw_size, raw)
            for column, v in zip(rows.values(), values):
                column.append(v)
    kinds = [pa.int32()] * 3 + [pa.binary()] * 4 + [pa.int32(), pa.binary()]
    return pa.table([pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=list(rows))


class _Contexts:
    """The contexts of a group's blocks in one bucket: distinct ones in order of first sight, and each block's entries."""

    def __init__(self, table: pa.Table):
        self.rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        number: dict[bytes, int] = {}
        self.kinds = [np.fromiter((number.setdefault(c, len(number)) for c in _unpacked(r)), np.int64) for r in self.rows]
        self.texts = list(number)
        self.docs = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r["docs"], np.int64) for r in self.rows]])
        self.kind = np.concatenate([np.zeros(0, np.int64), *self.kinds])
        self.keys, self.smallest = np.zeros(len(number), np.uint32), np.full(len(number), NO_ID)
        self.keys[self.kind] = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(r["keys"], np.uint32) for r in self.rows]])
        np.minimum.at(self.smallest, self.kind, self.docs)

    def parts(self, fine: int) -> np.ndarray:
        return self.keys % np.uint32(fine)


MERGED_CONTEXTS_SCHEMA = "bucket int, fine int, grp int, sizes binary, docs binary, raw_size int, raw binary"


def _merge_contexts(table: pa.Table, fine: int) -> pa.Table:
    """A group's distinct contexts of a bucket with their smallest documents, one row per fine bucket."""
    c, rows = _Contexts(table), []
    part = c.parts(fine)
    for f in np.unique(part).tolist():
        mine = np.flatnonzero(part == f)
        sizes, raw_size, raw = _packed([c.texts[i] for i in mine.tolist()])
        rows.append((c.rows[0]["bucket"], f, c.rows[0]["grp"], sizes, c.smallest[mine].tobytes(), raw_size, raw))
    kinds = [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.int32(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in MERGED_CONTEXTS_SCHEMA.split(", ")])


def longest_previous_factors(docs: np.ndarray, lcp: np.ndarray, least: int = 1) -> np.ndarray:
    """For suffixes in suffix order: the longest prefix shared with a suffix of a smaller document (0 if below ``least``).

    ``lcp[i]`` is the common prefix of suffixes i - 1 and i.  The longest match is with the
    previous or the next smaller document in suffix order.  Every position points to one before it with no
    smaller document in between, and jumps on along the pointers, all at once, until that document is smaller.
    """
    n = len(docs)
    best = np.zeros(n, np.int64)
    for back in (False, True):
        d = docs[::-1] if back else docs
        at = np.arange(n) - 1
        common = np.concatenate([[0], lcp[1:][::-1]]) if back else lcp.copy()
        common[:1] = 0
        common[common < least] = 0
        todo = np.flatnonzero(common > 0)
        while len(todo):
            todo = todo[d[at[todo]] >= d[todo]]
            over = at[todo]
            common[todo] = np.minimum(common[todo], common[over])
            at[todo] = at[over]
            todo = todo[common[todo] > 0]
        best = np.maximum(best, common[::-1] if back else common)
    return best


def suffix_order(rows: np.ndarray) -> np.ndarray:
    """Order of suffixes given by their first LENGTH bytes (n x LENGTH)."""
    width = -(-LENGTH // 8) * 8
    words = np.zeros((len(rows), width), np.uint8)
    words[:, :LENGTH] = rows
    return np.lexsort(words.view(">u8").astype(np.uint64).T[::-1])


def earlier_windows(texts: list[bytes], kind: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each entry (context number ``kind`` among the distinct ``texts``, document) a mask of its windows that also
    start in an entry of a smaller document."""
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    count = size - LENGTH + 1
    owner = np.repeat(np.arange(len(texts)), count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(size) - size)[owner] + inside
    masks = np.zeros(len(kind))
    by_kind = np.argsort(kind, kind="stable")  # entries of each context, together
    entries = np.bincount(kind, minlength=len(texts))
    first_entry = np.cumsum(entries) - entries
    h = _window_hashes(data, start)
    parts = max(1, -(-len(h) // SUFFIXES))  # equal windows have equal hashes: each part has an order of its own
    deal = (h >> np.uint64(33)) % np.uint64(parts) if parts > 1 else None
    for k in range(parts):
        mine = np.flatnonzero((entries[owner] > 0) & (deal == k if parts > 1 else True))
        _, same = np.unique(h[mine], return_inverse=True)
        times = np.bincount(same.reshape(-1), weights=entries[owner[mine]])
        mine = mine[times[same.reshape(-1)] > 1]  # suffixes whose window occurs once need no place in the order
        if not len(mine):
            continue
        rows = data[start[mine][:, None] + np.arange(LENGTH)]
        order = suffix_order(rows)
        rows, mine = rows[order], mine[order]
        differ = rows[1:] != rows[:-1]
        lcp = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)])
        # every window once per entry of its context: copies stand together and share all of it
        n = entries[owner[mine]]
        entry = by_kind[np.repeat(first_entry[owner[mine]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        common = np.full(len(entry), LENGTH)
        common[np.cumsum(n) - n] = lcp
        found = longest_previous_factors(docs[entry], common, LENGTH) >= LENGTH
        masks += np.bincount(entry[found], weights=np.exp2(np.repeat(inside[mine], n)[found]), minlength=len(kind))
    return masks.astype(np.uint64)


GROUP_VERDICT_SCHEMA = "grp int, bucket int, fine int, gone binary, part binary, masks binary"
VERDICT_SCHEMA = "block int, bucket int, bits binary, gone binary, part binary, masks binary"


def _full(texts: list[bytes]) -> np.ndarray:
    """The mask of all windows of each context."""
    windows = np.array([len(t) - LENGTH + 1 for t in texts], np.uint64)
    return (np.uint64(1) << windows) - np.uint64(1)


def _verdict(mask: np.ndarray, full: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """What has an earlier copy: all of a context, or the windows of a mask."""
    whole = mask == full
    some = np.flatnonzero(~whole & (mask > 0))
    return np.packbits(whole).tobytes(), some.astype(np.uint32).tobytes(), mask[some].tobytes()


def _judge(table: pa.Table) -> pa.Table:
    """Which windows of each group's contexts have an earlier copy in the corpus."""
    number: dict[bytes, int] = {}  # equal contexts stand together in suffix order
    rows = table.to_pylist()
    kinds = [np.fromiter((number.setdefault(c, len(number)) for c in _unpacked(r)), np.int64) for r in rows]
    every, texts = np.concatenate([np.zeros(0, np.int64), *kinds]), list(number)
    masks = earlier_windows(texts, every, np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r["docs"], np.int64) for r in rows]]))
    full, at, out = _full(texts), 0, []
    for r, kind in zip(rows, kinds):
        out.append((r["grp"], r["bucket"], r["fine"], *_verdict(masks[at:at + len(kind)], full[kind])))
        at += len(kind)
    types = [pa.int32()] * 3 + [pa.binary()] * 3
    return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=[x.split()[0] for x in GROUP_VERDICT_SCHEMA.split(", ")])


def _own_copies(number: np.ndarray, docs: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which contexts have a copy in a smaller document here: all of the context is its longest previous factor."""
    order = np.argsort(number, kind="stable")
    same = np.append(False, number[order][1:] == number[order][:-1])
    out = np.zeros(len(number), bool)
    out[order] = longest_previous_factors(docs[order], np.where(same, size[order], 0)) >= size[order]
    return out


def _masks(row: dict, full: np.ndarray) -> np.ndarray:
    """The masks of a verdict on contexts whose full masks are given."""
    gone = np.unpackbits(np.frombuffer(row["gone"], np.uint8), count=len(full)).astype(bool)
    mask = np.where(gone, full, np.uint64(0))
    mask[np.frombuffer(row["part"], np.uint32)] = np.frombuffer(row["masks"], np.uint64)
    return mask


def _split_verdicts(contexts: pa.Table, verdicts: pa.Table, fine: int) -> pa.Table:
    """A group's verdicts for each of its blocks; copies within the group go but for the one of the smallest document."""
    c = _Contexts(contexts)
    part, full, masks = c.parts(fine), _full(c.texts), np.zeros(len(c.texts), np.uint64)
    for r in verdicts.to_pylist():
        mine = np.flatnonzero(part == r["fine"])
        masks[mine] = _masks(r, full[mine])
    size = np.array([len(t) for t in c.texts], np.int64)
    every = np.where(_own_copies(c.kind, c.docs, size[c.kind]), full[c.kind], masks[c.kind])
    at, out = 0, []
    for r, kind in zip(c.rows, c.kinds):
        out.append((r["block"], r["bucket"], r["bits"], *_verdict(every[at:at + len(kind)], full[kind])))
        at += len(kind)
    types = [pa.int32()] * 2 + [pa.binary()] * 4
    return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=[x.split()[0] for x in VERDICT_SCHEMA.split(", ")])


def _covered(b: Block, verdicts: dict[int, dict]) -> tuple[np.ndarray, np.ndarray]:
    """Removed bytes of a block as (first, last + 1) of its runs of windows, not yet united."""
    begin, end = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, row, first, last, number, contexts, _, _ in b.contexts({k: v["bits"] for k, v in verdicts.items()}):
        full = _full(contexts)
        mask = _masks(verdicts[k], full) if contexts else full
        whole = (mask == full)[number] | _own_copies(number, b.docs[row], last - first + LENGTH)
        begin.append(first[whole])
        end.append(last[whole] + LENGTH)
        some = ~whole & (mask[number] > 0)
        start, bits = first[some], mask[number[some]]
        for o in range(GRAMS):
            at = start[(bits >> np.uint64(o)) & np.uint64(1) == 1] + o
            begin.append(at)
            end.append(at + LENGTH)
    return np.concatenate(begin), np.concatenate(end)


def _cut(texts: pa.Table, verdicts: pa.Table, buckets: int, whole_chars: bool = False) -> pa.Table:
    """With ``whole_chars`` the fragments of cut characters go; a replacement character of the text is none."""
    names = ["rest", "doc_id", "n_bytes", "span_first", "span_end", "kept"]
    if not texts.num_rows:
        return pa.table([texts.column("rest"), texts.column("doc_id"), pa.array([], pa.int64()),
                         pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.int64())),
                         pa.array([], pa.binary())], names=names)
    b = Block(texts, buckets)
    begin, end = _covered(b, {r["bucket"]: r for r in verdicts.select(
        ["bucket", "bits", "gone", "part", "masks"]).to_pylist()}) if verdicts.num_rows else (np.zeros(0, np.int64),) * 2
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order]) if len(order) else end
    # windows of different texts never overlap, but may touch: a new text opens a new span
    text = np.searchsorted(b.off, begin, side="right") - 1
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (begin[1:] > end[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(fresh)
    first, last, owner = begin[at], end[np.append(at[1:], len(begin)) - 1] if len(at) else end[:0], text[at]
    cuts = np.searchsorted(owner, np.arange(len(b.docs) + 1))
    kept, firsts, ends, raw = [], [], [], memoryview(b.data)
    for i, base in enumerate(b.off[:-1].tolist()):
        f, e = first[cuts[i]:cuts[i + 1]], last[cuts[i]:cuts[i + 1]]
        stay = zip([base, *e.tolist()], [*f.tolist(), int(b.off[i + 1])])
        rest = b"".join(raw[x:y] for x, y in stay)
        kept.append(rest.decode("utf-8", "ignore").encode() if whole_chars else rest)
        firsts.append(f - base)
        ends.append(e - base)
    return pa.table([b.table.column("rest"), b.table.column("doc_id"), pa.array(np.diff(b.off), pa.int64()),
                     pa.array(firsts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())),
                     pa.array(kept, pa.binary())], names=names)


def _process(docs: DataFrame, rest, kind: T.DataType, whole_chars: bool = False) -> DataFrame:
    """rest, doc_id, n_bytes, span_first, span_end, kept of every document."""
    total = text_bytes(docs)
    blocks, needed = block_count(total, least=1 << 20), 16 + math.ceil(total / BUCKET_BYTES)
    buckets = min(MOST_BUCKETS, needed)
    fine, groups = math.ceil(needed / buckets), max(1, math.ceil(total / GROUP_BYTES))
    # rows that repeat an id go to different blocks by their text; what meets in a block changes no result
    texts = docs.select(F.pmod(F.xxhash64(F.col("doc_id"), F.crc32(F.col("text").cast("binary"))), F.lit(blocks))
                        .cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"), rest.alias("rest"))
    heavy = HEAVY
    group = ("grp", "bucket")
    hashes = texts.groupBy("block").applyInArrow(lambda t: _send_hashes(t, buckets, groups), HASHES_SCHEMA).groupBy(*group)
    found = hashes.applyInArrow(lambda t: _merge_hashes(t, fine), MERGED_HASHES_SCHEMA).groupBy("bucket", "fine").applyInArrow(
        lambda t: _find_shared(t, heavy), GROUP_BITS_SCHEMA)
    bits = hashes.cogroup(found.groupBy(*group)).applyInArrow(lambda t, a: _split_bits(t, a, fine), BITS_SCHEMA)
    contexts = texts.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(
        lambda t, b: _send_contexts(t, b, buckets, groups), CONTEXTS_SCHEMA).groupBy(*group)
    judged = contexts.applyInArrow(lambda t: _merge_contexts(t, fine), MERGED_CONTEXTS_SCHEMA).groupBy("bucket", "fine").applyInArrow(
        _judge, GROUP_VERDICT_SCHEMA)
    verdicts = contexts.cogroup(judged.groupBy(*group)).applyInArrow(lambda t, v: _split_verdicts(t, v, fine), VERDICT_SCHEMA)
    out = T.StructType([T.StructField("rest", kind)]).add("doc_id", "long").add("n_bytes", "long") \
        .add("span_first", T.ArrayType(T.LongType())).add("span_end", T.ArrayType(T.LongType())).add("kept", "binary")
    return texts.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(
        lambda t, v: _cut(t, v, buckets, whole_chars), out)


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (first, end of each removed run, in bytes), kept (the remaining bytes)."""
    return _process(docs, F.lit(True), T.BooleanType()).select(
        "doc_id", "n_bytes", F.arrays_zip(F.col("span_first").alias("first"), F.col("span_end").alias("end"))
        .alias("spans"), "kept")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated bytes cut out of ``text``, all their columns."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rest = F.struct(*others)
    kind = docs.select(rest.alias("r")).schema["r"].dataType
    done = _process(docs, rest, kind, whole_chars=True)
    return done.select(*[F.col("kept").cast("string").alias(c) if c == "text" else F.col("rest").getField(c).alias(c)
                         for c in docs.columns])
