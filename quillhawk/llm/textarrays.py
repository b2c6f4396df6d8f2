"""Tokens of many texts as flat arrays: no Python object per token.

A batch of lower-cased texts becomes one array of code points. Word borders come from a class table, word identities
from a 64-bit polynomial hash over random code-point values, both computed for the whole batch at once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Code points of one block; a longer text is a block of its own.
BLOCK_CHARS = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=2)
def _classes(kinds: str) -> np.ndarray:
    cat = unicodedata.category
    return np.fromiter((cat(chr(c))[0] in kinds for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return mix64(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x1234567))


@lru_cache(maxsize=1)
def _inverse() -> int:
    return pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Tokens:
    """Tokens of a block: ``hash`` and the text's place ``doc`` per token, ``text[start:end]`` is the token."""

    text: str
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    docs: int

    def word(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]]

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.docs)


def tokens(texts: list[str], digits: bool = False) -> Tokens:
    """Longest runs of letters (with ``digits``: of letters and numbers) of the lower-cased texts."""
    low = [t.lower() for t in texts]
    joined = "\n".join(low) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.zeros(len(codes) + 1, dtype=np.int8)
    inside[1:] = _classes("LN" if digits else "L")[codes]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    size = 1 << max(20, int(len(codes)).bit_length())
    np.cumsum(_values()[codes] * _powers(size, _BASE)[: len(codes)], out=sums[1:])
    h = mix64((sums[end] - sums[start]) * _powers(size, _inverse())[start] + (end - start).astype(np.uint64))
    bounds = np.cumsum(np.fromiter((len(t) + 1 for t in low), dtype=np.int64, count=len(low)))
    return Tokens(joined, start, end, np.searchsorted(bounds, start, side="right"), h, len(texts))


def blocks(rows: Iterable[tuple[list, list[str]]], chars: int = BLOCK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Regroups (ids, texts) batches so that no block holds more than ``chars`` code points or a single text."""
    ids, texts, size = [], [], 0
    for some_ids, some_texts in rows:
        for i, t in zip(some_ids, some_texts):
            if texts and size + len(t) > chars:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if texts:
        yield ids, texts


def text_batches(batches: Iterable, id_at: int = 0, text_at: int = 1) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of Arrow record batches; a null text counts as empty."""
    for b in batches:
        yield b.column(id_at).to_pylist(), [t or "" for t in b.column(text_at).to_pylist()]
