"""Vectorised word splitting and hashing over UTF-8 buffers (words are runs without ASCII white space)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tidewire.llm.common import utf8_view

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 256), _BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """Words of several texts, in order: byte ranges, owning row and words per row."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    per_row: np.ndarray
    first: np.ndarray  # n + 1 positions of each row's first word


def split(strings: pa.Array) -> Words:
    data, offsets = utf8_view(strings)
    n = len(strings)
    if len(data) == 0:
        zero = np.zeros(0, np.int64)
        return Words(data, zero, zero, zero, np.zeros(n, np.int64), np.zeros(n + 1, np.int64))
    space = (data == 32) | ((data >= 9) & (data <= 13))
    cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins = np.empty(len(data), bool)
    begins[0], begins[1:] = True, space[:-1]
    begins[cuts] = True
    finishes = np.empty(len(data), bool)
    finishes[-1], finishes[:-1] = True, space[1:]
    finishes[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = True
    word = ~space
    starts = np.flatnonzero(begins & word)
    ends = np.flatnonzero(finishes & word) + 1
    first = np.searchsorted(starts, offsets)
    per_row = np.diff(first)
    return Words(data, starts, ends, np.repeat(np.arange(n), per_row), per_row, first)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, byte by byte; other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


_BLOCK = 1 << 20


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, the same in every process; worked off in blocks of about a megabyte."""
    lengths = ends - starts
    out = np.empty(len(starts), np.uint64)
    running = np.cumsum(lengths)
    lo = 0
    while lo < len(starts):
        done = int(running[lo] - lengths[lo])
        hi = max(lo + 1, int(np.searchsorted(running, done + _BLOCK, "right")))
        size, begin = lengths[lo:hi], running[lo:hi] - lengths[lo:hi] - done
        at = np.arange(int(running[hi - 1]) - done, dtype=np.int64)
        values = data[at + np.repeat(starts[lo:hi] - begin, size)].astype(np.uint64) + np.uint64(1)
        values *= _power_table(int(size.max()))[at - np.repeat(begin, size)]
        out[lo:hi] = mix(np.add.reduceat(values, begin) + size.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
        lo = hi
    return out


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows that start at each position (len(h) - n + 1 of them)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9FB21C651E98DF25) + np.uint64(i + 1)
        out ^= out >> np.uint64(29)
    return mix(out)
