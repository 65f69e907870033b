"""Hierarchical multi-length packing of documents into training sequences.

Sequences have one of several capacities (``TIERS``).  A document's full
windows of the largest capacity become sequences of their own; the remainder is
routed to the smallest tier that holds it.  Tiers are packed from the longest:
each remainder opens a sequence, and the gap behind it is filled from shorter
tiers, whole remainders first, then one cut to fit (its rest goes back to its
tier).  What can't be filled at the end of a batch waits for the next one; at the
end of a task the last few tokens become sequences of falling powers of two,
which need no padding.

Every task packs the documents it reads, so nothing is shuffled and the work
per task is bounded by an Arrow batch.  The sequences of a batch are dealt to
step groups of about ``STEP_TOKENS`` tokens, the next sequence always to the
lightest group.

Defined results: a null text counts as empty, an empty text has the end id
alone; a null id is carried; repeated rows are packed each for itself; an empty
table gives no sequence.  Further columns are ignored.  Which sequence a
document lands in follows the input's partitions.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import encoder, read_vocabulary

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Tokens of a step group.
STEP_TOKENS = 64 * 4096

#: A run of one document's ids: (row, first id, number of ids).
Fragment = tuple[int, int, int]


class Packer:
    """Packs fragments into sequences; keeps what doesn't fill one yet."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))
        self.queues: list[deque[Fragment]] = [deque() for _ in self.tiers]
        self.sequences: list[tuple[int, list[Fragment]]] = []  # (capacity, fragments)

    def add(self, row: int, tokens: int) -> None:
        """Route a document: full windows of the longest tier leave at once."""
        most, at = self.tiers[-1], 0
        while tokens - at >= most:
            self.sequences.append((most, [(row, at, most)]))
            at += most
        self._wait((row, at, tokens - at))

    def _wait(self, f: Fragment) -> None:
        if f[2]:
            self.queues[bisect_left(self.tiers, f[2])].append(f)

    def _fill(self, members: list[Fragment], gap: int, tier: int) -> int:
        """Fill a gap from the tiers up to ``tier``; returns what stays open."""
        while gap:
            fits = next((q for t, q in zip(self.tiers[tier::-1], self.queues[tier::-1]) if t <= gap and q), None)
            source = fits or next((q for q in self.queues[:tier + 1] if q), None)
            if source is None:
                return gap
            row, at, n = source.popleft()
            take = min(n, gap)
            members.append((row, at, take))
            gap -= take
            self._wait((row, at + take, n - take))
        return 0

    def pack(self) -> None:
        """Pack all tiers; fragments that can't fill a sequence wait on."""
        open_: list[Fragment] = []
        for tier in range(len(self.tiers) - 1, -1, -1):
            capacity = self.tiers[tier]
            while self.queues[tier]:
                members = [self.queues[tier].popleft()]
                if self._fill(members, capacity - members[0][2], tier):
                    open_ += members
                else:
                    self.sequences.append((capacity, members))
        for f in open_:
            self._wait(f)

    def finish(self) -> None:
        """What is left at the end of a task, in sequences of falling powers of two."""
        self.pack()
        rest = deque(f for q in reversed(self.queues) for f in q)
        left = sum(f[2] for f in rest)
        for q in self.queues:
            q.clear()
        while left:
            capacity = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            members, gap = [], capacity
            while gap:
                row, at, n = rest.popleft()
                take = min(n, gap)
                members.append((row, at, take))
                gap -= take
                if n > take:
                    rest.appendleft((row, at + take, n - take))
            self.sequences.append((capacity, members))
            left -= capacity


SCHEMA = ("doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, "
          "offset long, capacity int, step_id long")
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _emit(p: Packer, held: dict[int, tuple], task: int, counts: dict, id_type: pa.DataType) -> pa.RecordBatch:
    sequences, p.sequences = p.sequences, []
    total = sum(c for c, _ in sequences)
    steps = max(1, round(total / STEP_TOKENS))
    light = [(0, s) for s in range(steps)]
    cols: dict[str, list] = {n: [] for n in NAMES}
    for capacity, members in sorted(sequences, key=lambda s: -s[0]):
        load, step = heapq.heappop(light)
        heapq.heappush(light, (load + capacity, step))
        offset = 0
        for row, at, n in members:
            doc_id, ids = held[row]
            values = (doc_id, at, n, ids[4 * at:4 * (at + n)], len(ids) // 4, (task << 36) + counts["sequence"], offset,
                      capacity, (task << 36) + counts["step"] + step)
            for column, v in zip(cols.values(), values):
                column.append(v)
            offset += n
        counts["sequence"] += 1
    counts["step"] += steps
    waiting = {f[0] for q in p.queues for f in q}
    for row in [r for r in held if r not in waiting]:
        del held[row]
    kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), kinds)], NAMES)


def _pack(batches: Iterator[pa.RecordBatch], vocabulary, tiers: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    encode, p = encoder(vocabulary.value).encode, Packer(tiers)
    end = np.array([END_ID], "<u4").tobytes()
    task, counts, held, row, id_type = TaskContext.get().partitionId(), {"sequence": 0, "step": 0}, {}, 0, pa.int64()
    for b in batches:
        id_type = b.column("doc_id").type
        text = pc.fill_null(b.column("text"), "")
        for doc_id, t in zip(b.column("doc_id").to_pylist(), text):
            ids = encode(t.as_py()) + end
            held[row] = (doc_id, ids)
            p.add(row, len(ids) // 4)
            row += 1
        p.pack()
        yield _emit(p, held, task, counts, id_type)
    p.finish()
    yield _emit(p, held, task, counts, id_type)


def pack(docs: DataFrame, vocabulary_path: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset, capacity, step_id."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))  # a fixed file
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_pack, vocabulary=shared, tiers=tiers),
                           SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString()))


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "capacity", "step_id")
