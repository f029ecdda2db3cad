"""Exact, memoised use of the public tokenizers inside Spark tasks.

Both tokenizers never join characters across certain places of a text, so a text
is cut there, and the ids (or counts) of the pieces are remembered. What the
memory lacks is merged by the library's own model. Any text or piece for which
the cut is not provably exact goes whole through the library.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

_SPACES = r"\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space, a space, and white space or the end: here a cut before the space is not exact.
_RUN = re.compile(rf"[{_SPACES}] (?:[{_SPACES}]|\Z)")
#: White space that Python and the library may see differently: ASCII, and the rest.
_ODD = tuple("\x0b\x0c\x1c\x1d\x1e\x1f"), ("\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")
#: What a text lacks whose white space is single spaces and line feeds.
_UNEVEN = "  ", "\n\n", " \n", "\n ", "\t", "\r"
_CONTROL = re.compile(r"[\x1c-\x1f\x85\xa0]")
#: Letters of every Unicode version agree below this character.
_KNOWN = "\u0250"
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

MEMO = 300_000
#: Characters of the longest piece that is remembered.
LONGEST = 64
#: Pieces between spaces that the encoder remembers in a generation, and pre-tokens of other shapes.
PIECES, SHAPES = 500_000, 50_000


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = byte_letters()


def as_letters(text: str) -> str:
    return text.encode().decode("latin-1").translate(_LETTERS)


def odd(text: str) -> bool:
    return any(c in text for c in _ODD[0]) or (not text.isascii() and any(c in text for c in _ODD[1]))


class Memo(dict):
    """Remembers ``fn(key)`` in two generations of ``limit`` keys each.

    A full generation becomes the old one, and what is asked for again comes back
    from there, so that frequent keys stay. Keys of more than ``LONGEST`` characters
    (or bytes) are computed each time, so what is held is bounded in bytes too.
    """

    def __init__(self, fn, limit: int = MEMO):
        super().__init__()
        self.fn, self.limit, self.old = fn, limit, {}

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.fn(key)
        value = self.old.pop(key, None)
        if value is None:
            value = self.fn(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class BytePairEncoder:
    """Ids of a byte-level tokenizer as little-endian unsigned integers.

    ``encode(text)`` equals the library's ``encode(text, add_special_tokens=False)``.
    A single space before a visible character always starts a pre-token, so texts
    are cut there.
    """

    def __init__(self, path: str, pieces: int = PIECES):
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self._tokenize = self.tokenizer.model.tokenize
        self._pre = Memo(lambda pre: self._merge(as_letters(pre)), SHAPES)
        self._piece = Memo(self._after_space, pieces)

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.dtype.char, ids).tobytes()

    def _merge(self, letters: str) -> bytes:
        return self._bytes([t.id for t in self._tokenize(letters)])

    def _after_space(self, piece: str) -> bytes:
        """Ids of a piece with the space before it; a line feed stands without one.

        A word is remembered here alone, and marks attached to it cost no second merge.
        """
        word = piece.rstrip(_MARKS)
        if not word.isalpha() or not (piece.isascii() or max(piece) < _KNOWN):
            return self._split(piece if piece[:1] == "\n" else " " + piece)
        if len(word) < len(piece):
            return self._piece[word] + self._pre[piece[len(word) :]]
        return self._merge(_LETTERS[32] + word if word.isascii() else as_letters(" " + word))

    def _split(self, piece: str) -> bytes:
        if not piece or max(piece) >= _KNOWN or _CONTROL.search(piece):
            return self._whole(piece)
        word = piece.rstrip(_MARKS)
        if word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):  # one word and what is attached to it
            return self._pre[word] + (self._pre[piece[len(word) :]] if len(word) < len(piece) else b"")
        return b"".join([self._pre[x] for x in self.pattern.findall(piece)])

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._whole(text)
        if not (any(x in text for x in _UNEVEN) or odd(text)):
            text = text.replace("\n", " \n")  # a lone line feed is a token of its own
        elif " \n" in text or _RUN.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        return self._split(first) + b"".join(map(self._piece.__getitem__, rest))


def whole_tokens(path: str) -> frozenset[str]:
    """The pre-tokens that the tokenizer keeps as one token, proved one by one.

    Every vocabulary string with a word end is turned back to text and merged
    alone by the library; it counts only if exactly its own id comes out and the
    text is a single pre-token. The set is bounded by the vocabulary.
    """
    tokenizer = Tokenizer.from_file(path)
    counter = WordPieceCounter.pattern
    bytes_of = {c: b for b, c in _LETTERS.items()}
    found = set()
    for word, number in tokenizer.get_vocab().items():
        if not word.endswith("</w>") or any(c not in bytes_of for c in word[:-4]):
            continue
        try:
            text = bytes(bytes_of[c] for c in word[:-4]).decode()
        except UnicodeDecodeError:
            continue
        if counter.findall(text) == [text] and [t.id for t in tokenizer.model.tokenize(word[:-4])] == [number]:
            found.add(text)
    return frozenset(found)


class WordPieceCounter:
    """Numbers of tokens of a lower-casing tokenizer with word ends.

    ``count(text)`` equals ``len(encode(text, add_special_tokens=False).ids)``. No
    token crosses white space, so texts are cut there. Pre-tokens in ``whole`` count
    as one without merging; the library merges the rest.
    """

    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str, whole: frozenset[str]):
        self.tokenizer, self.whole = Tokenizer.from_file(path), whole
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._merged = Memo(lambda pre: len(self.tokenizer.model.tokenize(as_letters(pre))))
        self._piece = Memo(self._count)

    def _library(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _count(self, piece: str) -> int:
        if max(piece) >= _KNOWN:
            return self._library(piece)
        found = self.pattern.findall(unicodedata.normalize("NFC", piece).lower())
        return sum(1 if x in self.whole else self._merged[x] for x in found)

    def count(self, text: str) -> int:
        if any(s in text for s in self.special) or odd(text):
            return self._library(text)
        return sum(map(self._piece.__getitem__, text.split()))


def path_of(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    return public_tokenizers.path(name)


_made: dict = {}


def once(key, make):
    """``make()``, once in each Python worker."""
    if key not in _made:
        _made[key] = make()
    return _made[key]


assert sys.byteorder == "little"
