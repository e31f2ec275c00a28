"""Word tables of many texts at once: boundaries, hashes and per-text offsets as flat arrays.

Everything works on bytes of UTF-8: bytes of 0x80 and above belong to words in both word classes, and no other step
depends on where a code point begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK = 1 << 18

#: Byte classes: words are runs of bytes that are not white space, or not ASCII punctuation, space or control.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.ones(256, bool)
ALNUM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_bytes = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a sum of products are usable; ``salt`` gives independent values."""
    x = x ^ U((salt * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    if len(_powers.get(base, ())) < n:
        p = np.full(n, base, U)
        p[0] = 1
        _powers[base] = np.cumprod(p)
    return _powers[base][:n]


@dataclass
class Words:
    """``buf[starts[i]:ends[i]]`` is word i; text t has the words ``first[t]`` up to ``first[t + 1]``."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """One 64-bit value per word."""
        out = np.empty(len(self.starts), U)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + BLOCK)))
            lo, n = int(self.starts[i]), int(self.ends[j - 1] - self.starts[i])
            sums = np.zeros(n + 1, U)
            np.cumsum(_bytes[self.buf[lo : lo + n]] * powers(BASE, n), out=sums[1:])
            s, e = self.starts[i:j] - lo, self.ends[i:j] - lo
            out[i:j] = (sums[e] - sums[s]) * powers(INVERSE, n)[s] + (e - s).astype(U)
            i = j
        return mix(out)

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def split_words(texts: list[bytes], is_word: np.ndarray, lower: bool) -> Words:
    """Words of each text; a space, which belongs to no word, stands between the texts."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        buf = LOWER[buf]
    inside = is_word[buf].view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return Words(buf, starts, ends, np.searchsorted(starts, at))


def windows(hashes: np.ndarray, first: np.ndarray, size: int, salt: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` consecutive words inside one text, and the index of its first word."""
    n = len(hashes)
    if n < size:
        return np.empty(0, U), np.empty(0, np.int64)
    base = (BASE * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF | 1
    values = mix(hashes, salt)
    out = np.zeros(n - size + 1, U)
    for j in range(size) if size <= 12 else ():
        out += values[j : n - size + 1 + j] * U(pow(base, j, 1 << 64))
    if size > 12:
        inverse = pow(base, -1, 1 << 64)
        for lo in range(0, n - size + 1, BLOCK):
            part = values[lo : lo + BLOCK + size - 1]
            sums = np.zeros(len(part) + 1, U)
            np.cumsum(part * powers(base, len(part)), out=sums[1:])
            m = len(part) - size + 1
            out[lo : lo + m] = (sums[size:] - sums[:m]) * powers(inverse, len(part))[:m]
    left = np.repeat(first[1:], np.diff(first))[: n - size + 1]  # the end of each word's text
    at = np.flatnonzero(np.arange(n - size + 1) + size <= left)
    return mix(out[at], salt), at


def slices(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20, gaps: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with about ``limit`` bytes of their column ``text`` each, at least one row; null is empty.

    A part is what a task holds in arrays at a time, so memory follows the longest text, not the batch size. ``gaps`` also
    bounds its spaces and line ends, and so its words, which may be much shorter than usual.
    """
    for batch in batches:
        texts = batch.column("text")
        texts = texts.cast(pa.large_binary()).fill_null(b"").to_pylist() if len(texts) else []
        lo = size = between = 0
        for i, t in enumerate(texts):
            more = t.count(b" ") + t.count(b"\n") if gaps else 0
            if size and (size + len(t) > limit or gaps and between + more > gaps):
                yield batch.slice(lo, i - lo), texts[lo:i]
                lo, size, between = i, 0, 0
            size, between = size + len(t), between + more
        if lo < len(texts):
            yield batch.slice(lo), texts[lo:]
