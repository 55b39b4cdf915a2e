"""Words of Arrow text columns as 64-bit hashes, without a Python object a word.

A word is a run of code points in [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z became a-z: ASCII letters,
ASCII digits and everything beyond ASCII, so it can be cut out of the UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = 32
FOLD = np.full(256, SPACE, dtype=np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    FOLD[_b] = _b
for _b in range(0x41, 0x5B):
    FOLD[_b] = _b + 32
FOLD_BYTES = FOLD.tobytes()
#: Words between white space: only A-Z changes, and every white space byte is a space.
WHITE = np.arange(256, dtype=np.uint8)
WHITE[0x41:0x5B] += 32
WHITE[0x09:0x0E] = SPACE

BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
SLICE = 1 << 19
PIECE = 1 << 18
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def split(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD_BYTES).split() if text else []


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    """Words of the documents [lo, hi) of a column; word i is folded[start[i]:end[i]], document d has words first[d-lo] to first[d-lo+1]."""

    lo: int
    hi: int
    folded: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    prefix: list[np.ndarray]

    def word(self, i: int) -> bytes:
        return self.folded[self.start[i] : self.end[i]].tobytes()


def hashed(column: pa.Array, prefixes: tuple[int, ...] = (), fold: np.ndarray = FOLD) -> Iterator[Words]:
    """Slices of a string column (nulls have no words) of about SLICE bytes, a longer text alone.
    fold: what each byte becomes; words are the runs of other bytes than SPACE. prefixes: byte lengths; prefix[k][i] is the hash of word i's first prefixes[k] bytes, 0 for a shorter word."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offset = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offset, offset[lo] + SLICE, "right")) - 1)
        hi = min(hi, len(column))
        yield _cut(lo, hi, fold[raw[offset[lo] : offset[hi]]], offset[lo : hi + 1] - offset[lo], prefixes)
        lo = hi


def _cut(lo: int, hi: int, folded: np.ndarray, at: np.ndarray, prefixes: tuple[int, ...]) -> Words:
    n = len(folded)
    inside = folded != SPACE
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    value = np.zeros(len(start), dtype=np.uint64)
    prefix = [np.zeros(len(start), dtype=np.uint64) for _ in prefixes]
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, "right")))
        base, stop = start[i], end[j - 1]
        up, down = _grown(int(stop - base) + 1)
        total = np.zeros(stop - base + 1, dtype=np.uint64)
        np.cumsum((folded[base:stop].astype(np.uint64) + np.uint64(1)) * up[: stop - base], out=total[1:])
        s, e = start[i:j] - base, end[i:j] - base
        value[i:j] = mixed((total[e] - total[s]) * down[s])
        for k, length in enumerate(prefixes):
            cut = np.minimum(s + length, e)
            part = mixed((total[cut] - total[s]) * down[s] + np.uint64(length))
            prefix[k][i:j] = np.where(e - s >= length, part, np.uint64(0))
        i = j
    return Words(lo, hi, folded, start, end, np.searchsorted(start, at), value, prefix)


def shingles(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of so many words (one for each start; the last starts run out and are left off)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, length, dtype=np.uint64)
    for k in range(length):
        total = total * np.uint64(BASE) + hashes[k : k + n]
    return mixed(total)
