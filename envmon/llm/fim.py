"""Fill-in-middle examples from whole texts.

A text is cut by code points at two places into prefix, middle and suffix, and
written with markers as suffix-prefix-middle or prefix-suffix-middle, or left
plain.  The places follow from the document's id alone, as shares of its length.

Content-defined chunks: a rolling hash over the last 32 bytes ends a chunk wherever its
low bits are zero (at the start of a character, and after 4 KB at the latest), so
that passages which documents share become equal chunks.  A worker keeps what
it has found in a chunk (code points, markers inside, the two bytes at each
edge) under the chunk's bytes, and a later chunk takes the summary only if all its
bytes are equal.  Adding the counts of a document's chunks gives its length
and the chunk that each cut lies in, which alone is decoded; markers that cross from
one chunk into the next show in the edges.  The memo has a bound in bytes and
starts anew when it is full.

Work is one pass over the texts: nothing is shuffled, no row depends on another.

Defined results: a null text counts as empty and is plain; a null id as the empty
string where it is hashed; rows that repeat an id are cut alike.  An empty table gives
an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import pieces, utf8_buffers

#: The markers.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))

#: Bytes the rolling hash sees, mean and longest chunk, and bytes of chunks a worker remembers.
WINDOW, MEAN_CHUNK, LONGEST_CHUNK, MEMO_BYTES = 32, 512, 4096, 16 << 20

# One 32-bit value per byte, by a multiplicative rule.
_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Hash of the up to WINDOW bytes that end at each place; doubled widths, so log2(WINDOW) passes."""
    h, width = _GEAR[data], 1
    while width < WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width) if len(h) > width else h[:0]
        h, width = wider, 2 * width
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text's bytes, the last one its length."""
    n = len(data)
    if n == 0:
        return []
    # the low bits of the sum see the newest bytes only: take the high ones, which all WINDOW bytes reach
    mask = np.uint32((MEAN_CHUNK - 1) << 23)
    starts = (data & 0xC0) != 0x80
    ends = np.flatnonzero((rolling_hash(data)[:-1] & mask == 0) & starts[1:]) + 1
    out, last = [], 0
    for end in itertools.chain(ends[ends >= WINDOW].tolist(), (n,)):
        while end - last > LONGEST_CHUNK:
            last += LONGEST_CHUNK
            while not starts[last]:
                last -= 1
            out.append(last)
        out.append(end)
        last = end
    return out


class ChunkMemo(dict):
    """chunk bytes -> (code points, holds a marker, first two bytes, last two bytes)."""

    def __init__(self, most: int = MEMO_BYTES):
        super().__init__()
        self.most, self.held = most, 0

    def __missing__(self, chunk: bytes) -> tuple[int, bool, bytes, bytes]:
        got = len(chunk.decode()), b"<" in chunk and any(m in chunk for m in MARKERS), chunk[:2], chunk[-2:]
        if self.held + len(chunk) > self.most:
            self.clear()
            self.held = 0
        if len(chunk) <= self.most:
            self[chunk] = got
            self.held += len(chunk)
        return got


class Chunked:
    """A text as chunks: its length in code points, whether it holds a marker, and byte places of code points."""

    def __init__(self, data: np.ndarray, memo: ChunkMemo):
        self.raw, self.ends = data.tobytes(), chunk_ends(data)
        self.points, self.marked, edge, at = [0], False, b"", 0
        for end in self.ends:
            n, marked, head, tail = memo[self.raw[at:end]]
            if not self.marked:
                self.marked = marked or any(m in edge + head for m in MARKERS)
                edge = (edge + tail)[-2:]
            self.points.append(self.points[-1] + n)
            at = end

    @property
    def length(self) -> int:
        return self.points[-1]

    def byte_at(self, point: int) -> int:
        """Where code point number ``point`` begins."""
        k = bisect.bisect_right(self.points, point) - 1
        at = self.ends[k - 1] if k else 0
        if self.points[k] == point:
            return at
        return at + len(self.raw[at:self.ends[k]].decode()[:point - self.points[k]].encode())


def rearrange(text: Chunked, h: tuple[int, int, int, int]) -> tuple[str, int | None, int | None, bytes]:
    """(form, code points of prefix and of middle, output) of a text for four numbers."""
    n = text.length
    if n == 0 or text.marked or h[2] % 100 >= 90:
        return "plain", None, None, text.raw
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = text.byte_at(first), text.byte_at(last)
    p, m, s = MARKERS[0] + text.raw[:a], MARKERS[2] + text.raw[a:b], MARKERS[1] + text.raw[b:]
    return ("spm", first, last - first, s + p + m) if h[3] % 100 < 20 else ("psm", first, last - first, p + s + m)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = ChunkMemo()
    for batch in batches:
        data, off = utf8_buffers(batch.column("text"))
        numbers = [batch.column(f"h{i}").to_numpy() for i in range(1, 5)]
        for first, last in pieces(data, off):
            n, form, prefix, middle, output = [], [], [], [], []
            for row in range(first, last):
                text = Chunked(data[off[row]:off[row + 1]], memo)
                f, p, m, out = rearrange(text, tuple(int(x[row]) for x in numbers))
                n.append(text.length), form.append(f), prefix.append(p), middle.append(m), output.append(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, last - first), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                 pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame, salt: str = "1:") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row; other ``salt`` texts give other cuts."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select("doc_id", "text", digest.alias("_digest")).select("doc_id", "text", *numbers)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_batches, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")  # nothing before the first marker, then three parts
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))
