"""Encoding with public tokenizers, one cached word at a time.

``WordEncoder`` gives exactly the ids of ``Tokenizer.encode(text, add_special_tokens=False)``. It
cuts texts only where the tokenizer's own pre-tokenisation always cuts: before a space or line end that
stands between two characters that aren't white space. Words recur, so most are found in a dictionary. Other words are
cut once more, between Latin letters and the ASCII punctuation after them, and the letters go straight to the model.
Files whose pre-tokenisation isn't known to cut there are encoded as whole texts.
"""

from __future__ import annotations

import codecs
import json
import re
import struct
from functools import lru_cache
from string import punctuation
from unicodedata import is_normalized

import numpy as np

#: Words kept in a worker's dictionary; it starts afresh beyond that, so its memory is bounded.
CACHE_WORDS = 400_000
#: Runs of punctuation after a word that are kept, the latest ones.
CACHE_MARKS = 4096
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than the space and line end; it makes a text irregular.
_ODD = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes visible Latin-1 bytes as themselves and numbers the others from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        steps = pre.get("pretokenizers", [pre])
        kinds = [p.get("type") for p in steps]
        norms = [n.get("type") for n in norm.get("normalizers", [norm])] if norm else []
        self.spaced = kinds == ["ByteLevel"] and steps[0].get("use_regex") and not steps[0].get("add_prefix_space") and not norm
        self.dropped = kinds == ["Split", "ByteLevel"] and steps[0].get("behavior") == "Removed" and norms == ["NFC", "Replace", "Lowercase"] and not steps[1].get("use_regex")
        letters = _byte_letters()
        self.letters, self.space = "".join(letters[b] for b in range(256)), letters[32]
        self.model, self.code = self.tokenizer.model, "H" if self.dtype.itemsize == 2 else "I"
        self.mark = lru_cache(CACHE_MARKS)(self.raw)
        self.line = self.raw("\n")
        self.largest = max(self.tokenizer.get_vocab().values())
        self.words: dict[str, bytes] = _Words(self)

    def raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _model(self, word: str, spaced: bool = False) -> bytes:
        shown = word if word.isascii() else codecs.charmap_decode(word.encode(), "strict", self.letters)[0]
        ids = [t.id for t in self.model.tokenize(self.space + shown if spaced else shown)]
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def word(self, word: str) -> bytes:
        """Ids of a word with a space before it; of one that starts with a line end, of both without."""
        if word[:1] == "\n":
            return self.line + self._plain(word[1:], "")
        return self._plain(word, " " if self.spaced else "")

    def _plain(self, word: str, before: str) -> bytes:
        # Latin letters that the normaliser only lower-cases, and the punctuation after them, which is a piece of its own: without a
        # letter after it no apostrophe is a contraction, and added tokens that begin with a mark don't end with one's last
        core = word.rstrip(punctuation)
        if core.isalpha() and (core.isascii() or max(core) < "\u0250" and is_normalized("NFC", core) and len(core.lower()) == len(core)):
            end = self.mark(word[len(core) :]) if len(core) < len(word) else b""
            if end and bool(before) == self.spaced and core in self.words:
                return self.words[core] + end
            return (self._model(core, bool(before)) if self.spaced else self._model(core.lower())) + end
        return self.raw(before + word)

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, little-endian in ``dtype``."""
        if not text:
            return b""
        if not (self.spaced or self.dropped):
            return self.raw(text)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        get = self.words.__getitem__
        odd = _ODD if not text.isascii() else _ODD[:7]
        if self.dropped:
            if not any(c in text for c in odd):
                return b"".join(map(get, text.replace("\n", " ").split(" ")))
            return b"".join(map(get, _CUT.split(text)))
        parts = text.replace("\n", " \n").split(" ")
        if "" in parts or "\n" in parts or any(c in text for c in odd):
            parts = _CUT.split(text)
        return self._plain(parts[0], "") + b"".join(map(get, parts[1:]))


class _Words(dict):
    def __init__(self, encoder: WordEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.encoder.word(word)
        return ids


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One for each file in a Python worker, kept while the worker lives."""
    return WordEncoder(path)
