"""Word-wise encoding with a public vocabulary of the tokenizers library.

The vocabulary drops white space and never joins across it, so the ids of a
text are the ids of its white-space parts in turn.  Parts repeat a lot: a worker
keeps the ids of those it has seen (a bounded memo, emptied when full) and asks
the library for the rest.
"""

from __future__ import annotations

import struct
import unicodedata

from tokenizers import Tokenizer

#: Parts remembered per worker, and the longest part worth remembering.
MEMO_PARTS, MEMO_CHARS = 500_000, 48
#: Marks that end a word and are never joined to its letters by the pattern.
MARKS = ".,;:!?"
#: Control characters that Python's split() takes for white space and the tokenizer doesn't.
NOT_SPACE = "\x1c\x1d\x1e\x1f"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


BYTE_LETTERS = _byte_letters()


def _plain(letters: str) -> bool:
    """Letters of long-known scripts that stay letters when normalized and lower-cased; a capital dotted I becomes i and
    a combining mark, which joins the marks behind it."""
    return letters.isascii() or max(letters) < "\u0530" and unicodedata.normalize("NFC", letters).lower().isalpha()


def _latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder(dict):
    """part -> ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model = self.tokenizer.model

    def _word(self, part: str) -> list[int]:
        """Ids of one part; a lower-case Latin word needs neither normalizing nor parting and goes to the model at once."""
        if part.isascii():
            if part.isalpha() and part.islower():
                return [t.id for t in self.model.tokenize(part)]
        elif part.isalpha() and max(part) < "\u0250" and part == part.lower() and unicodedata.is_normalized("NFC", part):
            return [t.id for t in self.model.tokenize("".join(map(BYTE_LETTERS.__getitem__, part.encode())))]
        return self.tokenizer.encode(part, add_special_tokens=False).ids

    def __missing__(self, part: str) -> bytes:
        if len(part) > 1 and part[-1] in MARKS and part[:-1].isalpha() and _plain(part[:-1]):
            ids = self[part[:-1]] + self[part[-1]]
        else:
            ids = _packed(self._word(part))
        if len(part) <= MEMO_CHARS:
            if len(self) >= MEMO_PARTS:
                self.clear()
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, without special tokens."""
        if any(c in text for c in NOT_SPACE):
            parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        else:
            # folding case before the memo halves it; only where it is what the tokenizer does itself
            if "<|" not in text:
                if text.isascii() or _latin1(text):  # nothing in it composes
                    text = text.lower()
                elif "Σ" not in text and "İ" not in text and unicodedata.is_normalized("NFC", text):
                    low = text.lower()  # J with caron is two characters, j with caron one: then the tokenizer's order counts
                    text = low if unicodedata.is_normalized("NFC", low) else text
            parts = text.split()
        return b"".join(map(self.__getitem__, parts))


_ENCODERS: dict[int, WordEncoder] = {}  # one per worker and vocabulary


def encoder(vocabulary: str) -> WordEncoder:
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(vocabulary)
    return _ENCODERS[key]


def read_vocabulary(path: str) -> str:
    """The vocabulary file, read once where the query is built; its size is fixed (a few MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()
