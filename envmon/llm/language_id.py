"""Language identification by cross-parsing entropy.

For each language, labelled text becomes a suffix automaton.  A text is parsed
against each automaton into phrases, every phrase the longest match that occurs
in the labelled text (an unknown symbol is a phrase of its own).  The language
with the fewest normalised phrases, c * log2(N) / n for c phrases, N labelled
bytes and n text bytes, wins; ties go to the smaller language name.

Symbols are UTF-8 bytes with A-Z folded and everything else in ASCII taken as
one gap symbol.  Whole texts are read: a text is cut into blocks of
``BLOCK`` bytes that are parsed side by side, at the cost of at most one more
phrase per block and language (README has the measured effect: no other prediction).

Learning uses a bounded sample, ``budget`` bytes that all languages share: per language the
rows with the smallest id hash in each of ``slots`` id classes, and of each a snippet at a
place of the whole text that the id decides, as long as the language's share of the
budget allows (``snippet`` characters at most).  The automata of all languages together have
at most two states per byte of it, whatever the number of languages.  If there are more than
``max_languages``, those with the most labelled rows are learned.  These are parameters of :func:`learn`.

Defined results: null text or a text without a letter gives ``und`` with score
0; without any labelled row every text does.  Repeated rows get equal results,
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pieces, utf8_buffers

#: Bytes of a text that are parsed as one run.
BLOCK = 4096
GAP = 1


def _folded() -> np.ndarray:
    """Byte -> folded byte; ASCII that is no letter becomes a space."""
    t = np.arange(256, dtype=np.uint8)
    t[:128] = 32
    for c in range(26):
        t[97 + c] = t[65 + c] = 97 + c
    return t


FOLDED = _folded()


class SuffixAutomaton:
    """Suffix automaton of a symbol sequence; ``step`` moves are dictionaries per state."""

    def __init__(self, symbols: list[int]):
        self.move, link, length = [{}], [-1], [0]
        last = 0
        for c in symbols:
            cur = len(self.move)
            self.move.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.move[p]:
                self.move[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.move[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(self.move)
                    self.move.append(dict(self.move[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[cur] = clone
                    while p >= 0 and self.move[p].get(c) == q:
                        self.move[p][c] = clone
                        p = link[p]
            last = cur


class Parser:
    """All languages' automata as one table of moves, so that many texts step together.

    A cell holds ``2 * (row of the next state) + (1 if a new phrase starts here)``.
    Each language has two start states: one whose first symbol opens no phrase
    (the caller counts the first) and one, entered after an unknown symbol, whose does.
    """

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        seen = sorted({b for t in texts.values() for s in t for b in FOLDED[np.frombuffer(s, np.uint8)].tolist()})
        self.symbol = np.zeros(256, np.int32)  # 0: a byte that no labelled text has
        for i, b in enumerate(seen):
            self.symbol[b] = i + 1
        self.symbol = self.symbol[FOLDED]
        width = self.width = len(seen) + 2  # the last symbol parts the snippets and occurs in no text
        tables, self.start, self.bits, base = [], [], [], 0
        # two states per symbol at most, and two start states a language: the cells' numbers fit 32 bits
        most = sum(2 * (len(t) + sum(map(len, t))) + 2 for t in texts.values()) * width * 2
        kind = np.int32 if most < 2**31 else np.int64
        for name in self.languages:
            seq: list[int] = []
            for s in texts[name]:
                seq += self.symbol[np.frombuffer(s, np.uint8)].tolist() + [width - 1]
            moves = SuffixAutomaton(seq).move
            again = len(moves)  # the second start state
            t = np.empty((len(moves) + 1, width), kind)
            miss = np.full(width, 2 * (base + again) * width + 1, kind)
            for c, to in moves[0].items():
                miss[c] = 2 * (base + to) * width + 1
            t[:] = miss  # from any state: the phrase ends, the symbol opens the next one
            t[0] = 2 * (base + again) * width
            for state, out in enumerate(moves):
                for c, to in out.items():
                    t[state, c] = 2 * (base + to) * width
            tables.append(t)
            self.start.append(base * width)
            self.bits.append(float(np.log2(max(2, len(seq)))))
            base += len(t)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def phrases(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Phrase counts, languages x texts."""
        n, k = len(off) - 1, len(self.languages)
        size = np.diff(off)
        blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(n), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        first = off[owner] + nth * BLOCK
        length = np.minimum(BLOCK, off[owner + 1] - first)
        order = np.argsort(-length, kind="stable")
        owner, first, length = owner[order], first[order], length[order]
        total = np.zeros((k, n), np.int64)
        if not len(owner):
            return total
        state = np.repeat(np.array(self.start, self.table.dtype)[:, None], len(owner), axis=1)
        count = np.ones((k, len(owner)), np.int32)
        active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # blocks longer than each step
        for i in range(int(length[0])):
            a = int(active[i])
            c = self.symbol[data[first[:a] + i]]
            v = self.table[state[:, :a] + c]
            count[:, :a] += v & 1
            state[:, :a] = v >> 1
        for j in range(k):
            total[j] = np.bincount(owner, weights=count[j], minlength=n).astype(np.int64)
        return total

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) of each text: score is the lead over the runner-up, 0 to 1."""
        h = self.phrases(data, off) * np.array(self.bits)[:, None] / np.maximum(1, np.diff(off))
        best = h.argmin(axis=0)
        if len(self.languages) == 1:
            return best, np.ones(len(best))
        two = np.partition(h, 1, axis=0)[:2]
        return best, np.clip(1 - two[0] / np.maximum(two[1], 1e-12), 0.0, 1.0)


def learn(labelled: DataFrame, slots: int = 40, snippet: int = 400, budget: int = 384_000, max_languages: int = 400
          ) -> dict[str, list[bytes]]:
    """Labelled text per language from doc_id, text, lang (rows with a null in text or lang are left out).

    At most ``max_languages * slots`` rows, and of them ``budget`` bytes, come to the driver.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages)
    langs = sorted(r["lang"] for r in most.collect())
    if not langs:
        return {}
    share = budget // len(langs)  # bytes of a language
    used = max(1, min(slots, share // 60))  # snippets of 60 characters or so, rather than many short ones
    size = max(1, min(snippet, share // used))
    known = rows.where(F.col("lang").isin(langs))
    picked = known.groupBy("lang", F.pmod("h", F.lit(used)).alias("slot")).agg(F.min("h").alias("h")).collect()
    keep = {(r["lang"], r["h"]) for r in picked}
    # a snippet at a place of the whole text that the id decides
    place = F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.length("text") - size + 1)).cast("int") + 1
    found = (known.where(F.col("h").isin(sorted({h for _, h in keep})))
             .select("lang", "h", F.substring(F.col("text"), place, F.lit(size)).alias("text"))
             .groupBy("lang", "h").agg(F.min("text").alias("text")).collect())  # of a repeated id the smallest
    texts: dict[str, list[bytes]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["h"])):
        if (r["lang"], r["h"]) in keep:
            own, text = texts.setdefault(r["lang"], []), r["text"].encode()
            room = share - sum(map(len, own))  # in bytes a snippet can be longer than in characters
            if room > 0:
                own.append(text[:room])
    return texts


_PARSERS: dict[int, Parser] = {}  # one per worker: building the automata is paid once


def _parser(texts: dict[str, list[bytes]]) -> Parser:
    key = hash(tuple((k, tuple(v)) for k, v in sorted(texts.items())))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(texts)
    return _PARSERS[key]


def _predict(batches: Iterator[pa.RecordBatch], texts: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
    p = _parser(texts)
    names = pa.array(p.languages, pa.string())
    for b in batches:
        data, off = utf8_buffers(b.column("text"))
        letters = b.column("letters").to_numpy(zero_copy_only=False).astype(bool)
        lang, score = np.full(b.num_rows, -1, np.int64), np.zeros(b.num_rows)
        if p.languages:
            for i, j in pieces(data, off, 8 << 20):
                lang[i:j], score[i:j] = p.predict(data, off[i:j + 1])
        lang[~letters], score[~letters] = -1, 0.0
        pred = names.take(pa.array(lang, pa.int64(), mask=lang < 0)).fill_null("und")
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pred, pa.array(score)],
                                         ["doc_id", "held_out", "lang_pred", "score"])


def predict(docs: DataFrame, texts: dict[str, list[bytes]], held_out=None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    text = F.col("text").cast("string")
    return (docs.select("doc_id", (F.lit(False) if held_out is None else held_out).alias("held_out"),
                        text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
            .mapInArrow(partial(_predict, texts=texts),
                        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, "
                        "lang_pred string, score double"))
