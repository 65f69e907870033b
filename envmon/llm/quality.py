"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

A text is two term vectors.  Its words (runs of letters, case folded, hashed; for scripts
that don't part words, pairs of neighbouring characters as well) weigh the square root
of their share times the inverse document frequency.  Beside them stand layout
terms: pairs of neighbouring character classes (each punctuation mark its own class, upper and
lower case, digits, spaces, line ends, other bytes), letters, and how words repeat
the words before them.  A truncated singular value decomposition of the
labelled rows gives a latent-semantic space of either, and a document's vector is
its place in both, ``word_weight`` of the whole from words.  Every document is compared by
exact cosine, in blocks, with all labelled vectors, and the nearest ones vote with
weights that grow with similarity.

Learning uses at most ``max_labelled`` labelled rows (those with the smallest
id hash): their vectors and the two spaces, ``N_TERMS x dims`` floats, are all that is
broadcast, whatever the size of the corpus.

Defined results: null and empty texts have the zero vector, which is equally
near to all labelled rows, so their score is the share of label 1; the same
holds for every text when nothing is labelled (0.5 then).  Of repeated label
rows of one document the smallest label counts; null labels are left out.  Of labelled
rows that repeat an id with different texts the one of the smallest digest is learned from.
Further columns are ignored or carried.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pieces, utf8_buffers


def _classes() -> np.ndarray:
    """Byte -> character class."""
    t = np.zeros(256, np.int64)
    t[128:] = 1
    t[48:58], t[65:91], t[97:123], t[32] = 2, 3, 4, 5
    t[[9, 10, 11, 12, 13]] = 6
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    t[marks] = 7 + np.arange(len(marks))
    return t


CLASS = _classes()
N_CLASSES = int(CLASS.max()) + 1
N_PAIRS = N_CLASSES * N_CLASSES
#: Terms for the share of words that repeat one of the words 1, 2, 3 places before.
LAGS = (1, 2, 3)
N_LAYOUT = N_PAIRS + 26 + len(LAGS)
REPEAT_WEIGHT = 4.0
#: Cells that words are hashed to.
WORD_BITS = 14
N_WORDS = 1 << WORD_BITS
N_TERMS = N_LAYOUT + N_WORDS
_BYTE_HASH = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)


#: A text is read in parts of this many bytes, whose counts are added up.
PART = 1 << 20
#: Bytes of texts, and texts (each a row of all layout terms), whose terms are counted at a time.
PIECE, TEXTS = 1 << 18, 512
#: Texts that are compared at a time.
BLOCK = 1024


def term_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """texts x (layout terms, words): how often each pair, letter and repeat occurs."""
    n, size = len(off) - 1, np.diff(off)
    out = np.zeros((n, N_LAYOUT + 1))
    b = data[off[0]:off[-1]]
    if not len(b):
        return out
    owner = np.repeat(np.arange(n), size)
    cls = CLASS[b]
    same = owner[1:] == owner[:-1]
    code = (owner[:-1] * N_PAIRS + cls[:-1] * N_CLASSES + cls[1:])[same]
    out[:, :N_PAIRS] = np.bincount(code, minlength=n * N_PAIRS).reshape(n, N_PAIRS)
    low = np.where((b >= 65) & (b < 91), b + 32, b)
    letter = (low >= 97) & (low < 123)
    out[:, N_PAIRS:N_PAIRS + 26] = np.bincount(owner[letter] * 26 + (low[letter] - 97), minlength=n * 26).reshape(n, 26)
    gap = (cls == 5) | (cls == 6)
    begins = ~gap
    begins[1:] &= gap[:-1] | ~same
    first = np.flatnonzero(begins)
    if len(first):
        # a word's hash is the sum over its bytes of (byte's number) x (odd number of the place in the word)
        place = np.arange(len(b))
        place[first[0]:] -= np.repeat(first, np.diff(np.append(first, len(b))))
        with np.errstate(over="ignore"):
            h = np.where(gap, np.uint64(0), _BYTE_HASH[b] * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
            word = np.add.reduceat(h, first)
        whose = owner[first]
        out[:, -1] = np.bincount(whose, minlength=n)
        for i, lag in enumerate(LAGS):
            again = (word[lag:] == word[:-lag]) & (whose[lag:] == whose[:-lag])
            out[:, N_PAIRS + 26 + i] = np.bincount(whose[lag:][again], minlength=n)
    return out


def word_counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text * N_WORDS + cell, count) of the words of texts, sorted; wide characters also count in pairs."""
    n, size = len(off) - 1, np.diff(off)
    b = data[off[0]:off[-1]]
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), size)
    low = np.where((b >= 65) & (b < 91), b + 32, b).astype(np.uint8)
    letter = (low >= 97) & (low < 123) | (low >= 128)
    begins = letter.copy()
    begins[1:] &= ~letter[:-1] | (owner[1:] != owner[:-1])
    first, found = np.flatnonzero(begins), []
    with np.errstate(over="ignore"):
        if len(first):
            place = np.arange(len(b))
            place[first[0]:] -= np.repeat(first, np.diff(np.append(first, len(b))))
            h = np.where(letter, _BYTE_HASH[low] * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), np.uint64(0))
            found.append((owner[first], np.add.reduceat(h, first)))
        wide = np.flatnonzero((b >= 0xE0) & (b < 0xF0))  # characters of three bytes
        wide = wide[wide + 6 <= len(b)]
        wide = wide[(b[wide + 3] >= 0xE0) & (b[wide + 3] < 0xF0) & (owner[wide] == owner[wide + 5])] if len(wide) else wide
        if len(wide):
            h = sum(_BYTE_HASH[b[wide + k]] * np.uint64(2 * k + 1) for k in range(6))
            found.append((owner[wide], h))
        keys = [whose * N_WORDS + (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - WORD_BITS)).astype(np.int64) for whose, h in found]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(np.concatenate(keys), return_counts=True)


@dataclass
class Terms:
    """Term shares of texts: layout terms as a matrix, words as (text, cell, share) sorted by text."""

    layout: np.ndarray
    text: np.ndarray
    cell: np.ndarray
    share: np.ndarray

    def __len__(self) -> int:
        return len(self.layout)

    def rows(self, first: int, last: int) -> Terms:
        i, j = np.searchsorted(self.text, [first, last])
        return Terms(self.layout[first:last], self.text[i:j] - first, self.cell[i:j], self.share[i:j])


def term_frequencies(data: np.ndarray, off: np.ndarray) -> Terms:
    """Term shares of texts, each part (pairs, letters, repeats, words) adding up on its own; nothing for empty texts."""
    n = len(off) - 1
    if np.diff(off).max(initial=0) <= PART:
        counts, (key, times) = term_counts(data, off), word_counts(data, off)
    else:
        cut = np.concatenate([*[np.arange(a, b, PART) for a, b in zip(off[:-1], off[1:])], off[-1:]])
        owner = np.searchsorted(off, cut[:-1], side="right") - 1
        counts, found = np.zeros((n, N_LAYOUT + 1)), []
        for i, j in pieces(data, cut, PART):
            np.add.at(counts, owner[i:j], term_counts(data, cut[i:j + 1]))
            key, times = word_counts(data, cut[i:j + 1])
            found.append((owner[i:j][key // N_WORDS] * N_WORDS + key % N_WORDS, times))
        every = np.concatenate([k for k, _ in found])
        key, at = np.unique(every, return_inverse=True)
        times = np.bincount(at, weights=np.concatenate([t for _, t in found]), minlength=len(key))
    out = np.zeros((n, N_LAYOUT), np.float32)
    for a, b in ((0, N_PAIRS), (N_PAIRS, N_PAIRS + 26)):
        out[:, a:b] = counts[:, a:b] / np.maximum(1, counts[:, a:b].sum(axis=1, keepdims=True))
    out[:, N_PAIRS + 26:] = counts[:, N_PAIRS + 26:-1] / np.maximum(1, counts[:, -1:])
    text, cell = key // N_WORDS, key % N_WORDS
    words = np.bincount(text, weights=times, minlength=n)
    return Terms(out, text, cell, (times / words[text] if len(text) else np.zeros(0)).astype(np.float32))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray         # terms, layout first
    space: np.ndarray       # layout terms x dims
    word_space: np.ndarray  # word cells x dims
    vectors: np.ndarray     # labelled rows x dims of both, of length 1 (or 0)
    labels: np.ndarray      # 0 or 1 per labelled row
    neighbours: int
    power: float
    word_weight: float      # share of a cosine that comes from words

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def embed(self, t: Terms) -> np.ndarray:
        layout = _unit((_weights(t.layout) * self.idf[:N_LAYOUT]) @ self.space)
        words = np.zeros((len(t), self.word_space.shape[1]), np.float32)
        if len(t.text):
            weight = np.sqrt(t.share) * self.idf[N_LAYOUT + t.cell]
            first = np.flatnonzero(np.diff(t.text, prepend=-1))
            words[t.text[first]] = np.add.reduceat(self.word_space[t.cell] * weight[:, None], first, axis=0)
        both = np.concatenate([layout * np.sqrt(1 - self.word_weight), _unit(words) * np.sqrt(self.word_weight)], axis=1)
        return _unit(both).astype(np.float32)

    def score(self, t: Terms) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by similarity; blocked, exact."""
        out, k = np.full(len(t), self.prior), min(self.neighbours, len(self.labels))
        if not k:
            return out
        for at in range(0, len(t), BLOCK):
            part = t.rows(at, min(len(t), at + BLOCK))
            filled = part.layout.any(axis=1)
            if not filled.any():
                continue
            cos = self.embed(part)[filled] @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cos, near, axis=1), 1e-6).astype(np.float64) ** self.power
            out[at:at + BLOCK][filled] = (w * self.labels[near]).sum(axis=1) / w.sum(axis=1)
        return out


def _weights(tf: np.ndarray) -> np.ndarray:
    w = np.sqrt(tf)
    w[:, N_PAIRS + 26:] *= REPEAT_WEIGHT
    return w


#: Word cells whose columns are held at a time while learning.
CELLS = 2048


def _word_space(t: Terms, idf: np.ndarray, dims: int) -> np.ndarray:
    """Right singular vectors of the labelled rows' word weights, from their inner products, in blocks of cells."""
    n, weight = len(t), np.sqrt(t.share) * idf[t.cell]
    order = np.argsort(t.cell, kind="stable")
    cell, text, weight = t.cell[order], t.text[order], weight[order]

    def block(at: int) -> np.ndarray:
        i, j = np.searchsorted(cell, [at, at + CELLS])
        x = np.zeros((n, CELLS), np.float32)
        x[text[i:j], cell[i:j] - at] = weight[i:j]
        return x

    inner = np.zeros((n, n), np.float32)
    for at in range(0, N_WORDS, CELLS):
        inner += (x := block(at)) @ x.T
    del x
    values, basis = np.linalg.eigh(inner)
    del inner
    keep = np.argsort(values)[::-1][:dims]
    keep = keep[values[keep] > 1e-6 * max(1e-12, values.max(initial=0))]
    left = basis[:, keep] / np.sqrt(values[keep])
    del basis
    return np.concatenate([block(at).T @ left for at in range(0, N_WORDS, CELLS)]).astype(np.float32)


def fit(t: Terms, labels: np.ndarray, dims: int = 48, neighbours: int = 15, power: float = 8.0, word_weight: float = 0.25) -> Model:
    n = len(labels)
    present = np.concatenate([(t.layout > 0).sum(axis=0), np.bincount(t.cell, minlength=N_WORDS)])
    idf = (np.log((1 + n) / (1 + present)) + 1 if n else np.ones(N_TERMS)).astype(np.float32)
    x = _weights(t.layout) * idf[:N_LAYOUT]
    values, basis = np.linalg.eigh((x.T @ x).astype(np.float64))  # right singular vectors of the labelled rows
    space = basis[:, ::-1][:, :dims].astype(np.float32)
    del x, basis
    words = _word_space(t, idf[N_LAYOUT:], dims) if n else np.zeros((N_WORDS, 0), np.float32)
    model = Model(idf, space, words, np.zeros((0, space.shape[1] + words.shape[1]), np.float32), labels, neighbours, power, word_weight)
    model.vectors = np.concatenate([model.vectors, *[model.embed(t.rows(a, min(n, a + 1024))) for a in range(0, n, 1024)]])
    model.vectors[~t.layout.any(axis=1)] = 0
    return model


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Non-zero terms of labelled texts, and a digest of the text."""
    for b in batches:
        data, off = utf8_buffers(b.column("text"))
        for i, j in pieces(data, off, PIECE, TEXTS):
            t = term_frequencies(data, off[i:j + 1])
            at = [np.flatnonzero(r) for r in t.layout]
            cut = np.searchsorted(t.text, np.arange(j - i + 1))
            words = [slice(x, y) for x, y in zip(cut[:-1], cut[1:])]
            terms = [np.concatenate([a, N_LAYOUT + t.cell[w]]).astype("<i4").tobytes() for a, w in zip(at, words)]
            shares = [np.concatenate([r[a], t.share[w]]).astype("<f4").tobytes() for r, a, w in zip(t.layout, at, words)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id").slice(i, j - i), b.column("digest").slice(i, j - i), pa.array(terms, pa.binary()), pa.array(shares, pa.binary())],
                ["id", "digest", "terms", "shares"])


def _fit_rows(table: pa.Table, labels: dict[int, int], settings: dict) -> pa.Table:
    """The model of all learned rows, one row with its arrays."""
    rows = sorted(table.select(["id", "terms", "shares"]).to_pylist(), key=lambda r: r["id"])
    layout, text, cell, share = np.zeros((len(rows), N_LAYOUT), np.float32), [], [], []
    for i, r in enumerate(rows):
        at, x = np.frombuffer(r["terms"], "<i4"), np.frombuffer(r["shares"], "<f4")
        own = at < N_LAYOUT
        layout[i, at[own]] = x[own]
        cell.append(at[~own] - N_LAYOUT)
        share.append(x[~own])
        text.append(np.full(int((~own).sum()), i))
    flat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
    terms = Terms(layout, flat(text, np.int64), flat(cell, np.int64), flat(share, np.float32))
    model = fit(terms, np.array([float(labels[r["id"]] > 0) for r in rows]), **settings)
    return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = 3000, **settings) -> Model:
    """``docs``: doc_id, text.  ``labels``: doc_id, quality; both already without the rows held out.

    At most ``max_labelled`` rows are learned from, by one task; the model alone comes to the driver.
    """
    ids = (labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
           .agg(F.min(F.col("quality").cast("int")).alias("label"))
           .orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(max_labelled))
    picked = {r["id"]: r["label"] for r in ids.collect()}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.sha2(text, 256).alias("digest"))
    texts = texts.where(F.col("id").isin(list(picked)))  # a bounded list, pushed down to the scan
    # one text of a repeated id: the one of the smallest digest
    one = F.min(F.struct("digest", "terms", "shares")).alias("t")
    rows = (texts.mapInArrow(_sample_terms, "id long, digest string, terms binary, shares binary")
            .groupBy("id").agg(one).select("id", "t.terms", "t.shares", F.lit(0).alias("every")))
    found = rows.groupBy("every").applyInArrow(lambda t: _fit_rows(t, picked, settings), "model binary").collect()
    if found:
        return pickle.loads(found[0]["model"])
    nothing = Terms(np.zeros((0, N_LAYOUT), np.float32), *[np.zeros(0, np.int64)] * 2, np.zeros(0, np.float32))
    return fit(nothing, np.zeros(0), **settings)


def _terms(data: np.ndarray, off: np.ndarray) -> Terms:
    """Term shares of texts, counted a few texts at a time."""
    parts = [(i, term_frequencies(data, off[i:j + 1])) for i, j in pieces(data, off, PIECE, TEXTS)]
    return Terms(np.concatenate([t.layout for _, t in parts]), *[np.concatenate(x) for x in (
        [t.text + i for i, t in parts], [t.cell for _, t in parts], [t.share for _, t in parts])])


def _scores(m: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    found = [m.score(_terms(data, off[a:min(a + BLOCK, j) + 1])) for i, j in pieces(data, off) for a in range(i, j, BLOCK)]
    return np.concatenate(found or [np.zeros(0)])


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for b in batches:
        data, off = utf8_buffers(b.column("text"))
        score = np.clip(_scores(m, data, off), 0.0, 1.0)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score)],
                                         ["doc_id", "held_out", "score"])


def score(docs: DataFrame, model: Model, held_out=None) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = (docs.select("doc_id", (F.lit(False) if held_out is None else held_out).alias("held_out"),
                          F.col("text").cast("string").alias("text"))
              .mapInArrow(partial(_score, model=shared),
                          f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def _good(batches: Iterator[pa.RecordBatch], model, least: float) -> Iterator[pa.RecordBatch]:
    m = model.value
    for b in batches:
        data, off = utf8_buffers(b.column("text"))
        yield b.filter(pa.array(_scores(m, data, off) >= least))


def keep_good(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """The documents that score at least ``least``, all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_good, model=shared, least=least), docs.schema)
