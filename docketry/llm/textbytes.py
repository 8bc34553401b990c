"""Vectorised work on the UTF-8 bytes of a whole Arrow batch of texts.

A batch is cut into runs of whole texts of about ``RUN_BYTES``, so the arrays in use stay small
however many rows a batch has.  Words are ``[^\\x20\\x09-\\x0D]+``: no byte of a multi-byte character
is white space, so words can be found among bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
# A fixed random value for each byte value, and an odd base whose inverse modulo 2**64 exists.
_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the worker's life."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(n, 2 * RUN_BYTES).bit_length()
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Run:
    """Consecutive texts: their bytes, where each begins (``at``, one more than texts), and their first row in the batch."""

    def __init__(self, data: np.ndarray, at: np.ndarray, first: int):
        self.data, self.at, self.first, self.n = data, at, first, len(at) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and for each text the number of words before it (one more than texts)."""
        if not len(self.data):
            empty = np.zeros(0, dtype=np.int64)
            return empty, empty, np.zeros(self.n + 1, dtype=np.int64)
        word = ~SPACE[self.data]
        edge = np.zeros(len(word) + 1, dtype=bool)
        edge[self.at] = True
        begin = word.copy()
        begin[1:] &= ~word[:-1] | edge[1:-1]
        end = word.copy()
        end[:-1] &= ~word[1:] | edge[1:-1]
        starts = np.flatnonzero(begin)
        return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, self.at)

    def prefix(self) -> np.ndarray:
        """Polynomial prefix hashes of the bytes; :meth:`spans` reads the hash of any span off them."""
        out = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[self.data] * powers(_BASE, len(self.data)), out=out[1:])
        return out

    @staticmethod
    def spans(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of spans: equal for equal bytes, whatever their place."""
        raw = (prefix[ends] - prefix[starts]) * powers(_INVERSE, len(prefix))[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """Per text, the number of bytes where ``mask`` holds."""
        total = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]


def runs(column: pa.Array, lower: bool = False, limit: int = RUN_BYTES) -> Iterator[Run]:
    """Cut a string or binary column (null: empty) into runs of whole texts."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, places, content = column.buffers()
    at = np.frombuffer(places, dtype=np.int64, count=n + 1, offset=8 * column.offset)
    data = np.frombuffer(content, dtype=np.uint8) if content else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        part = data[at[i] : at[j]]
        yield Run(LOWER[part] if lower else part, at[i : j + 1] - at[i], i)
        i = j


def firsts(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether each (group, value) is its first occurrence in order; ``group`` must ascend."""
    order = np.lexsort((value, group)) if len(value) else np.zeros(0, dtype=np.int64)
    g, v = group[order], value[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    out = np.zeros(len(order), dtype=bool)
    out[order[new]] = True  # lexsort is stable, so the first of equals is the earliest
    return out


def repeated(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether each (group, value) occurs more than once."""
    if not len(value):
        return np.zeros(0, dtype=bool)
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    same = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.empty(len(order), dtype=bool)
    out[order] = twice
    return out
