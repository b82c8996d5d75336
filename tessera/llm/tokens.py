"""Byte-exact, cached encoding with a public word-level BPE vocabulary.

``WordBpe.encode`` returns the ids that ``tokenizers`` gives for the whole text
(``add_special_tokens=False``). Text whose characters all lie below U+0250 is split
with the vocabulary's own pattern and each distinct piece is encoded once; any other
text, and text that may hold a special token, goes through the library as a whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import numpy as np

END_ID = 2
VOCABULARY = "word_bpe_49k.json"
_TOP = 0x250


def _classes() -> tuple[str, str]:
    letters, numbers = [], []
    for code in range(0x20, _TOP):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LN":
            (letters if kind == "L" else numbers).append(re.escape(chr(code)))
    return "".join(letters), "".join(numbers)


_L, _N = _classes()
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
#: letters whose small form lies beyond, though they do not (U+0130 and some capitals of U+0180 to U+024F)
_FAR = "".join(c for c in map(chr, range(0x80, _TOP)) if max(map(ord, c.lower())) >= _TOP or len(c.lower()) > 1)
_UNUSUAL = re.compile(rf"[^\n\t\r -~¡-ɏ]|[{_FAR}]|<\|")


class WordBpe:
    """One encoder for each Python worker; the piece cache is bounded."""

    def __init__(self, path: str | None = None, cache: int = 1_200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.whole = Tokenizer.from_file(path)
        if self.whole.get_vocab_size() > 65_536:
            raise ValueError("ids must fit 16 bits")
        self.limit, self.cache = cache, {}

    def encode_batch(self, texts) -> list[np.ndarray]:
        """uint16 ids of each text; None counts as empty."""
        pieces = [None if t and _UNUSUAL.search(t) else _PIECE.findall(t.lower()) if t else [] for t in texts]
        every = set().union(*(ps for ps in pieces if ps))
        new = every.difference(self.cache)
        if len(self.cache) + len(new) > self.limit:
            self.cache, new = {}, every
        if new:
            new = list(new)
            for at in range(0, len(new), 20_000):
                part = new[at : at + 20_000]
                for word, e in zip(part, self.whole.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    self.cache[word] = array("H", e.ids).tobytes()
        get = self.cache.__getitem__
        return [
            np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint16)
            if ps is None
            else np.frombuffer(b"".join(map(get, ps)), np.uint16)
            for t, ps in zip(texts, pieces, strict=True)
        ]


_encoders: dict[str | None, WordBpe] = {}


def encoder(path: str | None = None) -> WordBpe:
    if path not in _encoders:
        _encoders[path] = WordBpe(path)
    return _encoders[path]


def forget() -> None:
    """Gives up this worker's encoders and the pieces they have kept."""
    _encoders.clear()
