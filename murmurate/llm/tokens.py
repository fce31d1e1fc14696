"""Vocabularies of public tokenizers, by the libraries that read them.

``ByteLevel`` puts a bounded cache of words in front of ``tokenizers``: a text is cut into
words by the vocabulary's own pattern and each different word is encoded once. Texts with
characters whose class depends on the library's Unicode tables, and texts that hold a
special token's string, go to the tokeniser whole, as do words above ``WORD`` characters.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import islice
from struct import pack

import numpy as np

#: Longest word that is cached, and half of how many words the cache holds.
WORD = 64
WORDS = 1 << 18
#: Letters, digits, marks and blanks that all versions of Unicode class alike.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7E¡-ɏ]*")


def _of_plain(pattern: str) -> re.Pattern:
    """A pattern over Unicode classes as one over the characters of plain texts."""
    plain = [chr(c) for c in (*range(0x20, 0x7F), *range(0xA1, 0x250))]
    for kind in "LN":
        members = "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == kind)
        named = rf"\p{{{kind}}}"
        pattern = re.sub(r"\[[^]]*\]", lambda found: found[0].replace(named, members), pattern).replace(named, f"[{members}]")  # noqa: B023
    return re.compile(pattern)


class _Words(dict):
    """The ids of words as bytes. Frequent words come early, so a quarter of the words, those that came first, stay when it is full."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        if len(word) > WORD:
            raise LongWordError
        if len(self) >= 2 * WORDS:
            self.older = dict(islice(self.items(), WORDS // 2))
            self.clear()
            self.update(self.older)
        code = self[word] = self.encode(word)
        return code


class LongWordError(Exception):
    """A text has a word that is not cached."""


class ByteLevel:
    """A ``tokenizers`` file of byte-level pieces whose words are cut by ``pattern``.

    With ``special`` a special token's string in a text counts as that token, without as plain text.
    """

    def __init__(self, path: str, pattern: str, special: bool):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.model = self.tokenizer.model
        self.split = _of_plain(pattern)
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        #: the character that stands for each byte
        self.shown = {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in kept)}
        self.known = _Words(self._word)

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a text, unsigned and little-endian."""
        if not _PLAIN.fullmatch(text) or any(mark in text for mark in self.marks):
            return self._whole(text)
        try:
            return np.frombuffer(b"".join(map(self.known.__getitem__, self.split.findall(text))), "<u4")
        except LongWordError:
            return self._whole(text)

    @property
    def older(self) -> dict[str, bytes]:
        return self.known.older

    def _word(self, word: str) -> bytes:
        """The ids of a word as the tokeniser's model gives them, for which each byte is a character."""
        plain = word.isascii() and word.isprintable()
        shown = word.replace(" ", self.shown[32]) if plain else word.encode().decode("latin-1").translate(self.shown)
        ids = [token.id for token in self.model.tokenize(shown)]
        return pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def pieces(self) -> list[bytes]:
        """The bytes of each token: its characters stand for bytes, the printable ones of Latin-1 for themselves."""
        byte = {shown: b for b, shown in self.shown.items()}
        found = [self.tokenizer.id_to_token(k) or "" for k in range(self.tokenizer.get_vocab_size())]
        return [bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode() for piece in found]


class Pieces:
    """A ``sentencepiece`` model; it adds the leading blank itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), "<u4")

    def pieces(self) -> list[bytes]:
        """The bytes of each piece: the lower block stands for a blank, ``<0xHH>`` for a byte."""
        model = self.model
        return [bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode() for k in range(model.get_piece_size())]


@lru_cache(maxsize=4)
def byte_level(path: str, pattern: str, special: bool = True) -> ByteLevel:
    return ByteLevel(path, pattern, special)


@lru_cache(maxsize=2)
def sentence_pieces(path: str) -> Pieces:
    return Pieces(path)
