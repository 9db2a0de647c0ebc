"""Token ids of whole texts, encoded word by word with a memory of the words already seen."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from struct import pack

import numpy as np

#: Words remembered by a worker; at this number the memory starts anew, which changes no result.
REMEMBERED_WORDS = 600_000
#: Python splits at these, the tokenizer doesn't take them for white space.
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

#: Fixed values of the split that the vocabulary file of `tokenizer_path` names, and words for which the pieces can be found here:
#: printable ASCII and the letters of Latin-1, which have one lower case and no other composed form.
_CLIP_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """Letters from ß to ÿ as byte-level vocabularies write them: bytes that Latin-1 prints stand for themselves, the others follow 255."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printed)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


_BYTE_LETTERS = _byte_letters()


def _splits_like_clip(tokenizer) -> bool:
    import json

    parts = json.loads(tokenizer.to_str())
    normalizers = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
    splits = (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    return normalizers == ["NFC", "Replace", "Lowercase"] and splits[0].get("pattern", {}).get("Regex") == _CLIP_SPLIT


class _WordIds(dict):
    """Ids of each word as bytes; a word that is missing is encoded when it is asked for."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = _splits_like_clip(self.tokenizer)
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        plain = self.plain and (word.isprintable() if word.isascii() else _PLAIN.fullmatch(word)) and "<|" not in word
        if not plain:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            ids = pack(f"<{len(ids)}I", *ids)
        elif word.isalpha():
            ids = self._piece(word.lower())
        else:
            ids = b"".join(map(self._piece, _PIECES.findall(word.lower())))
        self[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            tokens = self.tokenizer.model.tokenize(piece if piece.isascii() else piece.translate(_BYTE_LETTERS))
            ids = self.pieces[piece] = pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return ids


class WordEncoder:
    """Encodes a text like the tokenizer does without special tokens.

    For tokenizers that drop white space and never join characters across it, so that each run between
    white space has ids of its own.
    """

    def __init__(self, path: str):
        self.words = _WordIds(path)

    def encode(self, text: str, end: int) -> np.ndarray:
        """The ids of a text and, after them, the id `end`, as little-endian unsigned 32-bit integers."""
        if any(c in text for c in _NOT_SPACE):
            words = text.replace("\n", " ").replace("\t", " ").split(" ")
        else:
            words = text.split()
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
            self.words.pieces.clear()
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)) + end.to_bytes(4, "little"), "<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each file and worker."""
    return WordEncoder(path)
