"""Token ids of whole texts by the tokenizers library.

No token crosses the border between a character that isn't white space and one
single space with another such character behind it. So texts are cut there, and
each worker keeps a bounded table of the pieces it has met. A piece of letters, and
a run of ASCII punctuation behind it, are words of their own to the library's
pre-tokenizers, so its model takes them directly; any other piece goes through the
whole library. All ids come from the library.
"""

from __future__ import annotations

import re
import unicodedata
from array import array

import numpy as np
from tokenizers import Tokenizer

_TABLES: dict[str, Pieces] = {}
#: White space but spaces and newlines; and single spaces between other characters.
_RARE = re.compile(r"[^\S \n]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Letters with punctuation behind them, but no apostrophe, which may open a contraction, and no underscore.
_TAILED = re.compile(r"(\n?)([^\W\d_]+)([!-&(-/:-@\[-^`{-~]*)")
END_OF_WORD = "</w>"


def _alphabet() -> dict[int, str]:
    """The characters that stand for bytes: printable Latin-1 ones for themselves, the others in order from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


ALPHABET = _alphabet()
_SPACE = ALPHABET[32]


class _Met(dict):
    """Pieces met since the table was last full, with their ids; `old` has those of the time before."""

    def __init__(self, of: Pieces, old: dict[str, bytes]):
        super().__init__({"": b""})
        self.of, self.old = of, old

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.of.spelled(piece)
        self[piece] = ids
        return ids


class Pieces:
    """A tokenizer and the pieces met lately, with their ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, most: int = 200_000):
        self.most = most
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        #: Byte-level vocabularies stand for each byte by one character and keep the space before a word.
        self.words = any(k.endswith(END_OF_WORD) for k in self.library.get_vocab())
        self.met = _Met(self, {})
        self.tails = {"": b"", "\n": b"" if self.words else self.one("\n")}

    def one(self, text: str) -> bytes:
        """The library's ids of the text as it is."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, w: str) -> bytes:
        """The ids of one word of the pre-tokenizer, by the library's model in its own alphabet."""
        w = w.replace(" ", _SPACE) if w.isascii() else w.encode().decode("latin-1").translate(ALPHABET)
        return array("I", [t.id for t in self.model.tokenize(w)]).tobytes()

    def spelled(self, p: str) -> bytes:
        """The ids of a piece behind a space (or, byte-level, behind a newline that opens it)."""
        if p.isalpha():
            if not self.words:
                return self._word(" " + p)
            low = p.lower()
            return self._word(low) if p.isascii() or (low == p and unicodedata.is_normalized("NFC", p)) else self.one(p)
        m = _TAILED.fullmatch(p)
        if m and m[2].isalpha() and (m[1] or m[3]):
            lead, w, tail = m.groups()
            if tail not in self.tails:
                self.tails[tail] = self._word(tail)
            return (self.tails[lead] + self._word(w) if lead and not self.words else self.met[w]) + self.tails[tail]
        # A byte-level piece takes the space before it along, but not behind a newline.
        return self.one(p if self.words or p[0] == "\n" else " " + p)

    def _cut(self, text: str) -> list[str]:
        """Pieces of the text; in byte-level ones a newline between other characters opens a piece."""
        if self.words:  # white space is dropped, so any space or newline parts pieces
            low = text.lower()
            if low != text and "Σ" not in text and (low.isascii() or all(unicodedata.is_normalized("NFC", x) for x in (text, low))):
                text = low  # as the library's own normaliser does
            return text.replace("\n", " ").split(" ")
        ends = text[:1] + text[-1:]
        loose = "  " in text or " \n" in text or "\n " in text or "\n\n" in text or " " in ends or "\n" in ends
        return _CUT.split(text) if loose or _RARE.search(text) else text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, equal to the library's own for the whole text."""
        out = []
        for t in texts:
            if len(self.met) > self.most:
                self.met.old = {}
                self.met = _Met(self, self.met)
            if len(self.tails) > self.most:
                self.tails = {k: self.tails[k] for k in ("", "\n")}
            cut, head = self._cut(t), b""
            if not self.words and cut[0]:
                # A byte-level text's first piece has no space before it: letters stand as behind a newline.
                head = self.met["\n" + cut[0]][4:] if cut[0].isalpha() else self.one(cut[0])
                cut[0] = ""
            out.append(head + b"".join(map(self.met.__getitem__, cut)))
        return out


def table(path: str, most: int = 200_000) -> Pieces:
    """The worker's table of this tokenizer, with at least `most` pieces before it is full."""
    if path not in _TABLES:
        _TABLES[path] = Pieces(path, most)
    _TABLES[path].most = max(most, _TABLES[path].most)
    return _TABLES[path]
