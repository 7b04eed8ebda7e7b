"""Token ids of whole texts by a public BPE tokenizer, with a per-process cache of its words.

The tokenizer lower-cases a text, splits it at white space and into pre-tokens, and merges
each pre-token alone: equal words always give equal ids.  Texts within the character range
where Python cuts words as the tokenizer does are split here, and each new word goes through
the tokenizer's own model once; all other texts go through the tokenizer whole.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

CACHE_WORDS = 1_000_000  # the cache is emptied beyond this many words: bounded memory in a worker

_RANGE = [chr(c) for c in (*range(0xA1, 0x130), *range(0x131, 0x250))]
_LETTERS = "a-z" + "".join(c for c in _RANGE if unicodedata.category(c)[0] == "L")
_NUMBERS = "0-9" + "".join(c for c in _RANGE if unicodedata.category(c)[0] == "N")
_PLAIN = re.compile("[\t\n\r -~¡-įı-ɏ]*")
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class CachedTokenizer:
    """``ids(text)`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids`` (ids below 65,536)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.size = self.whole.get_vocab_size()
        self.merge = self.whole.model.tokenize
        self.chars = byte_chars()
        self.cache: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        ids = self.cache.get(part)
        if ids is None:
            shown = part if part.isascii() else "".join([self.chars[b] for b in part.encode()])
            ids = np.array([t.id for t in self.merge(shown)], dtype="<u2").tobytes()
            self.cache[part] = ids
        return ids

    def _learn(self, words: set[str]) -> None:
        for word in words:
            if word.isalpha():
                self._part(word)
            else:
                self.cache[word] = b"".join([self._part(p) for p in _PARTS.findall(word)])

    def ids(self, text: str) -> np.ndarray:
        if "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint16)
        words = text.lower().split()
        try:
            found = b"".join([self.cache[w] for w in words])
        except KeyError:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            self._learn(set(words).difference(self.cache))
            found = b"".join([self.cache[w] for w in words])
        return np.frombuffer(found, dtype="<u2")
