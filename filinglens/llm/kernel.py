"""Words and hashes of many texts at once, as numpy operations over their bytes.

A polynomial hash modulo 2**64 gives the hash of any byte span from two running sums, so words, n-grams
of words and fixed windows cost a few operations per byte whatever their length.
"""

from __future__ import annotations

import numpy as np

from filinglens.llm.common import kept_in_process

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE = (_BASE * 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
U = np.uint64

SPACES = bytes([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table_of(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


NOT_SPACE = ~table_of(SPACES)
LETTERS = table_of([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])

def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse; kept up to a million, longer ones made on demand."""
    kept = kept_in_process("powers", lambda: [np.ones(1, U), np.ones(1, U)])
    if len(kept[0]) > n:
        return kept[0], kept[1]
    out = []
    for b in (_BASE, _INVERSE):
        p = np.full(max(n, 1 << 20) + 1, b, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if n <= 1 << 21:
        kept[:] = out
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class Hashes:
    """Hash of any span [s, e) of ``buf``."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        up, self.down = powers(n)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((buf.astype(U) + U(1)) * up[:n], out=self.sums[1:])

    def span(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.sums[e] - self.sums[s]) * self.down[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))


def words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in ``inside``, and where each text's runs begin among them."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = inside[buf]
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(mask & ~before)
    return starts, np.flatnonzero(mask & ~after) + 1, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, first: np.ndarray, steps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word tuples (i, i+steps[0], ...) inside each text, and the index of their first word."""
    reach = steps[-1] if steps else 0
    n = len(hashes)
    if n <= reach:
        return np.zeros(0, U), np.zeros(0, np.int64)
    end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + reach < end)
    h = hashes[at]
    for k, step in enumerate(steps):
        h = mix(h * U(0x9E3779B97F4A7C15) + hashes[at + step] + U(k * 97 + step))
    return h, at


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Distinct hashed ``width``-word shingles of each text, sorted; shorter texts give their whole sequence as one."""
    low = LOWER[buf]
    s, e, first = words(low, offsets, NOT_SPACE)
    h = Hashes(low).span(s, e)
    g, at = grams(h, first, tuple(range(1, width)))
    where = np.searchsorted(at, first)
    out = []
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b == a:
            out.append(np.zeros(0, U))
        elif b - a < width:
            v = U(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    v = mix(np.array([v * U(0x9E3779B97F4A7C15) + x]))[0]
            out.append(np.array([v], U))
        else:
            out.append(np.unique(g[where[i] : where[i + 1]]))
    return out
