"""Vectorised text kernels shared by the Python-side operators.

Everything works on one Arrow slice of whole texts at a time: the UTF-8 buffer as numpy bytes and the
offsets of its documents. Hashes are polynomial fingerprints over random symbol values: two of them modulo a prime, 62 bits.
"""

import sys
import types

import numpy as np
import pyarrow as pa

#: Text bytes handled at once by a worker; a single longer document is handled alone, whole.
SLICE_BYTES = 4 << 20

_U = np.uint64
_rng = np.random.default_rng(0x5EED)
BYTE_VALUE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | _U(1)
#: A prime modulus: modulo a power of two, some long strings (Thue and Morse's) have equal fingerprints for every base.
PRIME = 2**31 - 1
_P = _U(PRIME)
_BASES = (0x3A5F1C27, 0x5D93E8B1)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, across tasks."""
    return sys.modules.setdefault("_worker_cache", types.ModuleType("_worker_cache")).__dict__


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(29))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def _mod(x: np.ndarray) -> np.ndarray:
    return x - (x // _P) * _P


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The first n powers of each base and of its inverse, kept by the worker."""
    cache = worker_cache()
    if len(cache.get("powers", (((),),))[0][0]) < n:
        size = max(n, 1 << 20)

        def of(base):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:  # doubles what is there
                more = min(done, size - done)
                out[done : done + more] = _mod(out[:more] * _U(pow(base, done, PRIME)))
                done += more
            return out

        cache["powers"] = [(of(b), of(pow(b, -1, PRIME))) for b in _BASES]
    return [(up[:n], down[:n]) for up, down in cache["powers"]]


class Rolling:
    """Fingerprints of any span of a symbol sequence in constant time."""

    def __init__(self, symbols: np.ndarray):
        self.halves = []
        for k, (up, down) in enumerate(powers(len(symbols) + 1)):
            sums = np.zeros(len(symbols) + 1, np.uint64)  # below 2^64 for any text that fits in memory
            np.cumsum(_mod(((symbols >> _U(31 * k)) & _P) * up[: len(symbols)]), out=sums[1:])
            self.halves.append((sums, down))

    def _joined(self, parts) -> np.ndarray:
        high, low = (_mod(_mod(total) * down) for total, down in parts)
        return (high << _U(31)) | low

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._joined((sums[end] - sums[start], down[start]) for sums, down in self.halves)

    def windows(self, length: int) -> np.ndarray:
        n = max(0, len(self.halves[0][0]) - length)
        return self._joined((sums[length:] - sums[:n], down[:n]) for sums, down in self.halves)


def slide_min(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of width values."""
    m, k = h, 1
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return np.minimum(m[: len(m) - (width - k)], m[width - k :]) if k < width else m


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Yields (first row, last row + 1, bytes, offsets): whole documents of about limit bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    n = len(column)
    if not n:
        return
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE):
    """Byte spans of the words of each document, and the first word of each document (with an end)."""
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    if len(data):
        at = offsets[:-1][offsets[:-1] < len(data)]
        first[at] |= inside[at]
        at = offsets[1:] - 1
        at = at[at >= 0]
        last[at] |= inside[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_values(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit value of each word."""
    return mix(Rolling(BYTE_VALUE[data]).spans(start, end))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
