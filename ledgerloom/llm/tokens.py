"""Token ids by a public vocabulary file, for many texts at once.

The vocabulary with word ends splits at white space before it merges, so a text's ids are those of its
pieces between ASCII white space, one after the other. Pieces are told apart by hash; each worker
remembers the ids of pieces that it has met, up to a bound, and has the library encode the others.
Capitals of ASCII fold into small letters, as the vocabulary does itself, except in pieces that could
hold a special string.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from ledgerloom.llm import words

#: Pieces that a worker remembers; bounds its memory, never its results.
REMEMBERED = 500_000
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
#: Contractions are pieces of their own, and a special string begins with these two.
_MARKS = ("'", "<|")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version(path: str) -> str:
    """The digest of a vocabulary file: it changes whenever counts could."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


@lru_cache(maxsize=2)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


class Encoder:
    """Ids of the pieces of texts; one for each worker and vocabulary."""

    def __init__(self, path: str):
        self.library = library(path)
        self.letters = {ord(c): self.library.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c != "÷"}
        self.keys = np.empty(0, np.uint64)
        self.first = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.pool = np.empty(1 << 16, np.uint32)
        self.filled = 0

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """The library's ids; a run of letters, or one with marks behind it, goes to its merges without the rest."""
        out: list[list[int] | None] = [None] * len(pieces)
        model, rest = self.library.model, []
        for i, piece in enumerate(pieces):
            if (plain := _PLAIN.fullmatch(piece)) and not any(mark in plain[2] for mark in _MARKS):
                word = plain[1] if piece.isascii() else plain[1].translate(self.letters)
                out[i] = [token.id for part in (word, plain[2]) if part for token in model.tokenize(part)]
            else:
                rest.append(i)
        if rest:
            for i, found in zip(rest, self.library.encode_batch([pieces[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = found.ids
        return out

    def places(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the pool, number of ids) of every piece, and for each row the number of pieces before it."""
        starts, ends, bounds = words.spans(data, offsets)
        folded = words.hashes(data, starts, ends, True)
        special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))) if len(data) else starts[:0]
        if len(special):
            odd = np.unique(np.searchsorted(starts, special, "right") - 1)
            folded[odd] = words.hashes(data, starts[odd], ends[odd], False) ^ np.uint64(0xA5A5A5A5A5A5A5A5)
        keys, at, back = np.unique(folded, return_index=True, return_inverse=True)
        found = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inner = found < len(self.keys)
        known[inner] = self.keys[found[inner]] == keys[inner]
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.keys) + len(new) > REMEMBERED and len(self.keys):
                self.keys, self.first, self.size, self.filled = self.keys[:0], self.first[:0], self.size[:0], 0
                new = np.arange(len(keys))
            raw = data.tobytes()
            lower = np.ones(len(new), bool)
            if len(special):
                lower = ~np.isin(at[new], odd)
            pieces = [raw[s:e].lower().decode() if low else raw[s:e].decode() for s, e, low in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), lower.tolist(), strict=True)]
            ids = self.encode(pieces)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for piece in ids for i in piece), np.uint32, int(size.sum()))
            while self.filled + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
            self.pool[self.filled : self.filled + len(flat)] = flat
            first = self.filled + np.cumsum(size) - size
            self.filled += len(flat)
            into = np.searchsorted(self.keys, keys[new])
            self.first = np.insert(self.first, into, first)
            self.size = np.insert(self.size, into, size)
            self.keys = np.insert(self.keys, into, keys[new])
            found = np.searchsorted(self.keys, keys)
        found = found[back]
        return self.first[found], self.size[found], bounds

    def counts(self, column: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        out = []
        for _, _, data, offsets in words.chunks(column):
            _, size, bounds = self.places(data, offsets)
            total = np.concatenate([[0], np.cumsum(size)])
            out.append(np.diff(total[bounds]))
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk's texts, and for each text the number of ids before it."""
        first, size, bounds = self.places(data, offsets)
        total = np.concatenate([[0], np.cumsum(size)])
        return self.pool[np.repeat(first - total[:-1], size) + np.arange(total[-1])], total[bounds]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
