"""Token ids of whole texts through the ``tokenizers`` library, with what was seen before kept per worker.

Both vocabularies split a text into pieces before they merge.  A text of plain Latin letters, digits and ASCII
marks is split at once by an equivalent of the file's own pattern, and each piece is merged by the library's
model unless the worker has met it before.  In other texts the stretches between single spaces are told
apart, as neither vocabulary lets a piece reach over a space between two non-spaces: plain ones are split the
same way, the others go through the library.  Other texts in which white space runs around a space go through
the library uncut.  What was met is kept in two generations, the older of which goes when the younger is full.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable
from itertools import groupby
from operator import attrgetter

import numpy as np

CACHE = 160_000
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(r"[ \n\t\r!-~À-ÖØ-öø-ÿ]*\Z")
_AROUND = re.compile(r"\s (?:\s|\Z)")
_ID = attrgetter("id")
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_PIECES = {
    "byte": re.compile(rf"{_SHORT}| ?[{_LETTER}]+| ?[0-9]+| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"{_SHORT}|[{_LETTER}]+|[0-9]|[^\s0-9{_LETTER}]+"),
}


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 as it is, the rest from 256 on."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Kept(dict):
    """Results by key; ``most`` at most in each of two generations, so what is frequent stays."""

    def __init__(self, make, most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class Encoder:
    """``encode(text)`` gives the ids as little-endian numbers of ``dtype``: 16 bits if all ids fit, else 32."""

    def __init__(self, path: str, kept: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 65_536 else "<u4")
        self.low = self.library.normalizer is not None
        self.split = _PIECES["word" if self.low else "byte"].findall
        self.merge, self.letters = self.library.model.tokenize, _byte_letters()
        self.pieces, self.others = _Kept(self._piece, kept), _Kept(self.whole, CACHE)

    def _bytes(self, ids: Iterable[int]) -> bytes:
        out = array("HI"[self.dtype.itemsize // 4], ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._bytes(map(_ID, self.merge(piece.encode().decode("latin-1").translate(self.letters))))

    def whole(self, text: str) -> bytes:
        return self._bytes(self.library.encode(text, add_special_tokens=False).ids)

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text.lower() if self.low else text)))

    def encode(self, text: str) -> bytes:
        if _PLAIN.match(text):
            return self.plain(text)
        if not self.low and _AROUND.search(text):
            return self.whole(text)
        # The space before a stretch belongs to it.
        first, *rest = text.split(" ")
        out = []
        for is_plain, run in groupby([first, *[" " + x for x in rest]], lambda x: _PLAIN.match(x) is not None):
            out += [self.plain("".join(run))] if is_plain else map(self.others.__getitem__, run)
        return b"".join(out)


_KNOWN: dict[str, Encoder] = {}


def encoder(path: str, kept: int = CACHE) -> Encoder:
    """The worker's encoder of this vocabulary file, that keeps so many pieces at least."""
    if path not in _KNOWN or _KNOWN[path].pieces.most < kept:
        _KNOWN.clear()
        _KNOWN[path] = Encoder(path, kept)
    return _KNOWN[path]


def public_vocabulary(name: str) -> str:
    """Place of a public vocabulary file; asked for on the executor, as folders may differ there."""
    import public_tokenizers

    return public_tokenizers.path(name)
