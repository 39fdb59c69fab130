"""Words of Arrow text columns as arrays of hashes, without a Python string per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from revtide.llm.common import text_bytes

#: Words are runs of anything but these (white space in the ASCII sense).
WHITE = bytes([0x20, *range(0x09, 0x0E)])
#: Words are runs of digits, lower-case letters and non-ASCII characters.
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_MULT = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = 0xD6E8FEB86659FD93
_GRAM_BASE = 0xA0761D6478BD642F
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers = np.ones(1, np.uint64)


def _word_powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        fill = np.full(max(n, 1024), _WORD_BASE, np.uint64)
        fill[0] = 1
        _powers = np.cumprod(fill, dtype=np.uint64)
    return _powers


@dataclass
class Words:
    """Words of several texts. ``first[d]`` is the number of the first word of text ``d``."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, d: int, keep: np.ndarray | None = None) -> bytes:
        """Words of text ``d`` (those that ``keep`` marks), joined by one space."""
        a, b = self.first[d], self.first[d + 1]
        raw = self.data
        spans = zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)
        if keep is None:
            return b" ".join(raw[s:e].tobytes() for s, e in spans)
        return b" ".join(raw[s:e].tobytes() for (s, e), k in zip(spans, keep.tolist(), strict=True) if k)


def split_words(texts: pa.Array, separators: bytes = WHITE, lower: bool = False) -> Words:
    """All words of ``texts`` (maximal runs of bytes that are not ``separators``) with 64-bit hashes."""
    data, offsets = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    table = np.ones(256, bool)
    table[np.frombuffer(separators, np.uint8)] = False
    inside = table[data]
    begin, end = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        begin[edges] |= inside[edges]
        end[edges - 1] |= inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(data, np.zeros(0, np.uint64), starts, ends, first)
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    codes = _BYTE_CODE[data[inside]] * _word_powers(int(lengths.max()))[place]
    return Words(data, mix(np.add.reduceat(codes, at)), starts, ends, first)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` hashes, by doubling."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    piece, size = hashes, 1
    whole: np.ndarray | None = None
    covered = 0
    rest = n
    while rest:
        if rest & 1:
            if whole is None:
                whole, covered = piece, size
            else:
                power = np.uint64(pow(_GRAM_BASE, size, _MASK + 1))
                m = min(len(whole), len(piece) - covered)
                whole, covered = whole[:m] * power + piece[covered : covered + m], covered + size
        rest >>= 1
        if rest:
            power = np.uint64(pow(_GRAM_BASE, size, _MASK + 1))
            piece, size = piece[:-size] * power + piece[size:], size * 2
    return mix(whole[: len(hashes) - n + 1] + np.uint64(n))


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Numbers of all words at which a run of ``n`` words of one text begins."""
    lengths = np.maximum(np.diff(first) - n + 1, 0)
    total = int(lengths.sum())
    base = np.repeat(first[:-1] - (np.cumsum(lengths) - lengths), lengths)
    return base + np.arange(total)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
