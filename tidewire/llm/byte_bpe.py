"""Byte-level BPE of whole texts through the tokenizers library, stretch by stretch, with a worker's cache.

The vocabulary's pattern starts a new pre-token at any space before a visible character, so a text may be
cut there without changing its ids. A stretch's ids are kept as little-endian 32-bit bytes: a text's ids are
its stretches' bytes joined. What the cache lacks is cut by the pattern, and the library's BPE model merges
each new pre-token; texts that its normal route treats otherwise go through the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import regex

#: Entries of a worker's cache; stretches beyond that are made anew each time.
CACHE = 300_000

_PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_IRREGULAR = re.compile(r" (?=\s|\Z)")
#: White space beyond space, tab and line ends; texts without it need no search for irregular spaces.
_RARE = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_STRETCH = re.compile(r"(?= \S)")
#: Characters that libraries disagree on whether they are white space.
_UNSURE = re.compile("[\x1c-\x1f\x85᠎​⁠﻿]")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the others, in order, for the characters from U+0100.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _irregular(text: str) -> bool:
    """Whether a space stands before white space or at the end."""
    if "  " in text or " \n" in text or " \t" in text or " \r" in text or text[-1] == " ":
        return True
    rare = _RARE[:6] if text.isascii() else _RARE
    return any(c in text for c in rare) and _IRREGULAR.search(text) is not None


class Encoder(dict):
    """Ids of stretches by text; :meth:`encode` gives whole texts."""

    def __init__(self, path: str, bound: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.library, self.bound = Tokenizer.from_file(path), bound
        self.model, self.alphabet = self.library.model, byte_alphabet()
        self.space = self.alphabet[0x20]
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        kept = json.loads(self.library.to_str())
        before = kept["pre_tokenizer"] or {}
        by_bytes = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        #: Whether the vocabulary cuts texts by the pattern above and leaves them as they are.
        self.by_pattern = by_bytes and kept["normalizer"] is None and kept["post_processor"] is None

    def whole(self, text: str) -> bytes:
        """A text's ids by the library's normal route."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if not piece:
            return b""
        word = piece[1:] if piece[0] == " " else piece
        if word.isalpha():
            tokens = [piece]
        elif word[-1:] in ",." and word[:-1].isalpha():
            tokens = [piece[:-1], piece[-1]]
        elif _UNSURE.search(piece):
            return self.whole(piece)
        else:
            tokens = _PATTERN.findall(piece)
        if len(tokens) > 1:
            ids = b"".join(map(self.__getitem__, tokens))
        else:
            if piece.isascii() and word.isalpha():
                mapped = self.space + word if piece[0] == " " else word
            else:
                mapped = piece.encode().decode("latin-1").translate(self.alphabet)
            ids = b"".join([self.id_bytes[t.id] for t in self.model.tokenize(mapped)])
        if len(piece) < 64 and len(self) < self.bound:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, as little-endian 32-bit bytes; null counts as empty."""
        if not text:
            return b""
        if not self.by_pattern or any(s in text for s in self.special):
            return self.whole(text)
        if "\0" in text or _irregular(text):
            return b"".join(map(self.__getitem__, _STRETCH.split(text)))
        return b"".join(map(self.__getitem__, text.replace(" ", "\0 ").split("\0")))


_encoders: dict[str, Encoder] = {}


def encoder(path: str, bound: int = CACHE) -> Encoder:
    """The worker's encoder for the vocabulary at ``path``, with room for ``bound`` stretches at least."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, bound)
    own = _encoders[path]
    own.bound = max(own.bound, bound)
    return own
