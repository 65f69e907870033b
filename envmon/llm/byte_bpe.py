"""Byte-level BPE encoding and decoding around a global shuffle of distinct words.

A task reads a block of texts and explodes them into pre-tokens (matches of the
pattern) with their positions: the block's distinct words in order of frequency,
and per text the sequence of word numbers.  The distinct words are dealt by
hash into buckets, first among the blocks of a group, where the words that several
blocks have become one, then among all groups; a bucket encodes each distinct word of the
whole corpus once, and the ids go back by the same way.  In the block the ids are
joined to the positions and the texts' ids put together.

Blocks, and the words they send, pass one exchange each that both uses share; words and
ids travel packed, per pair of block and bucket, so a word that every text has (a third of
all pre-tokens, say) is one entry per block.  There are at most ``MOST_BUCKETS`` buckets: what a
block sends stays in proportion to its words however large the corpus is, and what a bucket gets
grows with the distinct words of groups.

Decoding joins every id with the table of token bytes (bounded by the
vocabulary, broadcast) and concatenates by position.

Defined results: a null text counts as empty and has no ids; a null id is
carried; repeated rows are encoded each for itself; an empty table gives an
empty result; an id outside the vocabulary, or null, raises an error on decoding,
a null list decodes to empty bytes.  Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import one_array, pieces, text_bytes, utf8_buffers

#: Text per block and per bucket of words.
BLOCK_BYTES, BUCKET_BYTES = 7 << 20, 64 << 20
#: Buckets at most, and blocks whose words are merged before they meet those of other groups.
MOST_BUCKETS, GROUP_BLOCKS = 4096, 256
#: Texts decoded at a time, for bounded memory.
SLICE = 500
#: White space that may stand before a space: there a text can't be parted without looking at the whole run.
_ASCII_RUNS = ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ")
_OTHER_RUN = re.compile("[\x85\xa0  -     　] ")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Numbered(dict):
    """Value of a new key: its number, counted from 0."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class _Parts(dict):
    """Space-separated part -> its number; a new part is parted into words once."""

    def __init__(self, block: "Explode", lead: str):
        super().__init__()
        self.block, self.lead = block, lead

    def __missing__(self, part):
        n = self[part] = self.block.add(self.lead + part)
        return n


class Explode:
    """Pre-tokens of a block of texts as numbers of its distinct words.

    A pre-token spans a space only in front of it, so a text may be parted at every
    space that follows no white space, and each distinct part matched once.
    """

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall
        self.words: dict[str, int] = _Numbered()
        self.sizes: list[int] = []   # words of each distinct part
        self.flat: list[int] = []    # their numbers
        self.first, self.later = _Parts(self, ""), _Parts(self, " ")

    def add(self, part: str) -> int:
        found = self.find(part)
        self.flat += map(self.words.__getitem__, found)
        self.sizes.append(len(found))
        return len(self.sizes) - 1

    def close(self) -> None:
        """Let go of the parts; they refer back here, and a cycle would outlive its block."""
        for parts in (self.first, self.later):
            parts.clear()
            parts.block = None

    def parts(self, text: str) -> np.ndarray:
        if any(r in text for r in _ASCII_RUNS) or not text.isascii() and _OTHER_RUN.search(text):
            return np.array([self.add(text)], np.int64)
        head, *rest = text.split(" ")
        return np.fromiter([self.first[head], *map(self.later.__getitem__, rest)], np.int64, 1 + len(rest))


def gather(sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Positions of the members of the chosen groups, where group i has ``sizes[i]`` members in a row."""
    n = sizes[chosen]
    begin = (np.cumsum(sizes) - sizes)[chosen]
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _zip(a: np.ndarray | bytes) -> bytes:
    raw = a if isinstance(a, bytes) else a.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unzip(b: bytes, kind=None):
    raw = pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True)
    return raw if kind is None else np.frombuffer(raw, kind)


BLOCK_SCHEMA = "block long, ids array<{id}>, counts binary, low binary, mid binary, high binary, sizes binary, words binary"


def _explode(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[pa.RecordBatch]:
    nth, names = TaskContext.get().partitionId() << 24, [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
    for b in batches:
        text = pc.fill_null(one_array(b.column("text")), "")
        data, off = utf8_buffers(text)
        for i, j in pieces(data, off, BLOCK_BYTES):
            e = Explode(pattern)
            parts = [e.parts(t) for t in text.slice(i, j - i).to_pylist()]
            sizes, flat = np.array(e.sizes, np.int64), np.array(e.flat, np.int64)
            per_text = np.array([sizes[p].sum() for p in parts], np.int64)
            every = flat[gather(sizes, np.concatenate(parts))]
            # frequent words get small numbers: the bytes of the sequence then compress well
            order = np.argsort(-np.bincount(every, minlength=len(e.words)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            every = rank[every]
            spelled = [w.encode() for w in e.words]
            spelled = [spelled[k] for k in order.tolist()]
            e.close()
            del e, parts, flat
            values = [nth, b.column("doc_id").slice(i, j - i), _zip(per_text)] + \
                [_zip(((every >> np.uint32(s)) & np.uint32(255)).astype(np.uint8)) for s in (0, 8)] + \
                [_zip((every >> np.uint32(16)).astype(np.uint16)),
                 _zip(np.array([len(w) for w in spelled], np.uint32)), _zip(b"".join(spelled))]
            ids = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), one_array(values[1]))
            yield pa.RecordBatch.from_arrays([pa.array([values[0]], pa.int64()), ids] +
                                             [pa.array([v], pa.binary()) for v in values[2:]], names)
            nth += 1


def _spelled(row: dict) -> list[bytes]:
    end = np.cumsum(_unzip(row["sizes"], np.uint32).astype(np.int64)).tolist()
    raw = _unzip(row["words"])
    return [raw[a:b] for a, b in zip([0, *end], end)]


def _by_bucket(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers sorted by bucket, and where each bucket starts."""
    bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


WORDS_SCHEMA = "grp int, bucket int, block long, mark long, sizes binary, words binary"


def _send_words(table: pa.Table, buckets: int, groups: int) -> pa.Table:
    out: dict[str, list] = {c.split()[0]: [] for c in WORDS_SCHEMA.split(", ")}
    for row in table.select(["block", "sizes", "words"]).to_pylist():
        words, mark = _spelled(row), zlib.crc32(row["words"])
        order, at = _by_bucket(words, buckets)
        group = zlib.crc32(row["block"].to_bytes(8, "little")) % groups
        for k in np.flatnonzero(np.diff(at)).tolist():
            mine = [words[i] for i in order[at[k]:at[k + 1]].tolist()]
            for column, v in zip(out.values(), (group, k, row["block"], mark, _zip(np.array([len(w) for w in mine], np.uint32)),
                                                _zip(b"".join(mine)))):
                column.append(v)
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))


def _numbered(table: pa.Table, by: str) -> tuple[list[dict], list[np.ndarray], list[bytes]]:
    """Rows in order of ``by``, the number of each of their words, and the distinct words in order of their numbers."""
    rows, number = sorted(table.to_pylist(), key=lambda r: r[by]), _Numbered()
    chosen = [np.fromiter(map(number.__getitem__, _spelled(r)), np.int32) for r in rows]
    return rows, chosen, list(number)


MERGED_SCHEMA = "bucket int, grp int, sizes binary, words binary"


def _merge_words(table: pa.Table) -> pa.Table:
    """The distinct words of a group of blocks in one bucket."""
    rows, _, words = _numbered(table, "block")
    sizes = np.array([len(w) for w in words], np.uint32)
    return pa.table([pa.array([rows[0]["bucket"]], pa.int32()), pa.array([rows[0]["grp"]], pa.int32()),
                     pa.array([_zip(sizes)], pa.binary()), pa.array([_zip(b"".join(words))], pa.binary())],
                    names=["bucket", "grp", "sizes", "words"])


GROUP_IDS_SCHEMA = "grp int, bucket int, n_ids binary, ids binary"


def _encode_words(table: pa.Table, ranks) -> pa.Table:
    """Encode each distinct word of a bucket once; answer every group in the order of its words."""
    # a pattern that takes any text whole: the words are matches already
    enc = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks.value, special_tokens={})
    rows, groups, words = _numbered(table, "grp")
    known = [enc.encode_ordinary(w.decode()) for w in words]
    size = np.array([len(k) for k in known], np.int64)
    flat = np.array([i for k in known for i in k], np.uint32)
    return pa.table([pa.array([r["grp"] for r in rows], pa.int32()), pa.array([r["bucket"] for r in rows], pa.int32()),
                     pa.array([_zip(size[c].astype(np.uint32)) for c in groups], pa.binary()),
                     pa.array([_zip(flat[gather(size, c)]) for c in groups], pa.binary())], names=["grp", "bucket", "n_ids", "ids"])


IDS_SCHEMA = "block long, bucket int, mark long, n_ids binary, ids binary"


def _hand_back(words: pa.Table, answer: pa.Table) -> pa.Table:
    """A group's ids for each of its blocks, in the order of the block's words."""
    rows, blocks, distinct = _numbered(words, "block")
    size = np.concatenate([np.zeros(0, np.uint32), *[_unzip(x, np.uint32) for x in answer.column("n_ids").to_pylist()]]).astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.uint32), *[_unzip(x, np.uint32) for x in answer.column("ids").to_pylist()]])
    if len(size) != len(distinct):
        raise RuntimeError("a block of texts was read again in another order: write the input first")
    return pa.table([pa.array([r["block"] for r in rows], pa.int64()), pa.array([r["bucket"] for r in rows], pa.int32()),
                     pa.array([r["mark"] for r in rows], pa.int64()),
                     pa.array([_zip(size[c].astype(np.uint32)) for c in blocks], pa.binary()),
                     pa.array([_zip(flat[gather(size, c)]) for c in blocks], pa.binary())], names=[c.split()[0] for c in IDS_SCHEMA.split(", ")])


def _reassemble(blocks: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    kind = blocks.schema.field("ids").type.value_type
    docs, sizes, every = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for row in blocks.to_pylist():
        order, _ = _by_bucket(_spelled(row), buckets)
        mine = sorted(answers.to_pylist(), key=lambda a: a["bucket"])
        if any(a["mark"] != zlib.crc32(row["words"]) for a in mine):
            raise RuntimeError("a block of texts was read again in another order: write the input first")
        n = np.concatenate([np.zeros(0, np.uint32)] + [_unzip(a["n_ids"], np.uint32) for a in mine]).astype(np.int64)
        ids = np.concatenate([np.zeros(0, np.uint32)] + [_unzip(a["ids"], np.uint32) for a in mine])
        place = np.empty(len(order), np.int64)  # word -> its place among the answers
        place[order] = np.arange(len(order))
        word = np.zeros(0, np.int32)
        for c, t, shift in (("high", np.uint16, 8), ("mid", np.uint8, 8), ("low", np.uint8, 0)):
            part = _unzip(row[c], t).astype(np.int32)
            word = (word | part if len(word) else part) << shift
        word = place[word]
        every.append(ids[gather(n, word)].astype(np.int32))
        before = np.concatenate([[0], np.cumsum(n[word])])
        ends = before[np.cumsum(_unzip(row["counts"], np.int64))]
        sizes.append(np.diff(ends, prepend=0))
        docs += row["ids"]
    off = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return pa.table([pa.array(docs, kind), pa.ListArray.from_arrays(pa.array(off, pa.int32()),
                                                                    pa.array(np.concatenate(every)))],
                    names=["doc_id", "ids"])


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of every whole text, without special tokens."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # bounded by the vocabulary
    total = text_bytes(docs)
    buckets, groups = min(MOST_BUCKETS, 16 + math.ceil(total / BUCKET_BYTES)), math.ceil(total / BLOCK_BYTES / GROUP_BLOCKS) or 1
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    blocks = rows.mapInArrow(partial(_explode, pattern=pattern), BLOCK_SCHEMA.format(id=kind)).groupBy("block")
    words = blocks.applyInArrow(lambda t: _send_words(t, buckets, groups), WORDS_SCHEMA).groupBy("grp", "bucket")
    merged = words.applyInArrow(_merge_words, MERGED_SCHEMA)
    encoded = merged.groupBy("bucket").applyInArrow(lambda t: _encode_words(t, ranks), GROUP_IDS_SCHEMA)
    answers = words.cogroup(encoded.groupBy("grp", "bucket")).applyInArrow(_hand_back, IDS_SCHEMA)
    return blocks.cogroup(answers.groupBy("block")).applyInArrow(
        lambda b, a: _reassemble(b, a, buckets), f"doc_id {kind}, ids array<int>")


def _take(tokens: pa.Array, lists) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated entries of ``tokens`` for every list of ids: (bytes, offsets per list)."""
    lists = one_array(lists)
    if lists.null_count:
        lists = pc.fill_null(lists, pa.scalar([], lists.type))
    off = lists.offsets.to_numpy().astype(np.int64)
    data, at = utf8_buffers(tokens.take(lists.values.slice(off[0], off[-1] - off[0])))
    return data, at[off - off[0]]


def token_bytes(ranks: dict[bytes, int]) -> pa.Array:
    """Table id -> bytes; ids the vocabulary leaves out are null."""
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token
    return pa.array(table, pa.large_binary())


def _decode(batches: Iterator[pa.RecordBatch], ranks) -> Iterator[pa.RecordBatch]:
    tokens = token_bytes(ranks.value)
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            b = whole.slice(at, SLICE)
            unknown = pc.is_null(tokens.take(pc.unique(one_array(b.column("ids")).flatten())))
            if pc.any(unknown).as_py():
                raise ValueError("an id to decode is not in the vocabulary")
            data, off = _take(tokens, b.column("ids"))
            raw = memoryview(data)
            text = pa.array([raw[x:y].tobytes() for x, y in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), text], ["doc_id", "ids", "decoded"])


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids, decoded (bytes): each id joined with the token-byte table, in order of position."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = encoded.select("doc_id", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_decode, ranks=ranks), f"doc_id {kind}, ids array<int>, decoded binary")


def _digests(batches: Iterator[pa.RecordBatch], ranks) -> Iterator[pa.RecordBatch]:
    digits = pa.array([b"%d," % i for i in range(max(ranks.value.values(), default=-1) + 1)], pa.large_binary())
    for whole in _decode(batches, ranks):
        for at in range(0, whole.num_rows, SLICE):
            b = whole.slice(at, SLICE)
            data, off = _take(digits, b.column("ids"))
            raw = memoryview(data)
            listed = [hashlib.sha256(raw[x:max(x, y - 1)]).hexdigest() for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
            decoded = [hashlib.sha256(t.as_buffer()).hexdigest() for t in b.column("decoded")]
            n = pc.fill_null(pc.list_value_length(b.column("ids")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, pa.array(listed, pa.string()),
                                              pa.array(decoded, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digest(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids in decimal, joined by commas), decoded_sha256 (of the decoded bytes).

    Decoding and digests run in one pass: the decoded texts need not leave the task.
    """
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = encoded.select("doc_id", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_digests, ranks=ranks),
                           f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
