"""Whole Arrow text columns as numpy arrays: words, hashes and n-grams without per-row loops."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Bytes hashed at once; bounds the 8-byte work arrays.
SEGMENT = 1 << 20
#: Bytes of text that callers work on at once.
CHUNK = 4 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits (public splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _byte_table(lower: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
    if lower:
        table[65:91] = table[97:123]
    return table


_TABLES = {flag: _byte_table(flag) for flag in (False, True)}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base is odd)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts.

    ``starts``/``ends`` are byte positions in ``data``; the words of text d are
    those from ``first[d]`` to ``first[d + 1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets, self.lower = data, offsets, lower
        solid = ~_SPACE[data]
        inner = np.ones(len(data) + 1, dtype=bool)
        inner[offsets] = False
        starts = solid.copy()
        starts[1:] &= ~(solid[:-1] & inner[1:-1])
        ends = solid
        ends = solid.copy()
        ends[:-1] &= ~(solid[1:] & inner[1:-1])
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, computed by prefix sums over the bytes."""
        n, out, at = len(self.starts), np.empty(len(self.starts), dtype=U64), 0
        table = _TABLES[self.lower]
        while at < n:
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.starts, low + SEGMENT)))
            high = self.ends[to - 1]
            power, inverse = powers(_BASE, int(high - low) + 1)
            total = np.zeros(int(high - low) + 1, dtype=U64)
            np.cumsum(table[self.data[low:high]] * power[:-1], out=total[1:])
            s, e = self.starts[at:to] - low, self.ends[at:to] - low
            out[at:to] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U64) * U64(0x2545F4914F6CDD1D))
            at = to
        return out

    def docs(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def ngrams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of n hashes, by prefix sums (one per start; shorter than the input by n - 1)."""
    if len(hashes) < n:
        return np.empty(0, dtype=U64)
    base = (_WORD_BASE + 2 * seed * 0x9E3779B1) % (1 << 64)
    power, inverse = powers(base, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=U64)
    np.cumsum(hashes * power[:-1], out=total[1:])
    return mix((total[n:] - total[:-n]) * inverse[: len(hashes) - n + 1] + U64(seed + n))


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``limit`` bytes, or of one longer text: (from, to, bytes, offsets)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of a task's batches, which at the end gives freed memory back to the system.

    Workers are kept for later tasks, also while other stages need the memory.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _powers.clear()  # up to 16 MiB for each base
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def ids_of(column: pa.Array) -> np.ndarray:
    """Integer ids; a null id counts as the smallest."""
    return pc.fill_null(column.cast(pa.int64()), -(1 << 63)).to_numpy(zero_copy_only=False)


def id_array(ids: np.ndarray) -> pa.Array:
    """Back to Arrow, the smallest as null again."""
    return pa.array(ids, pa.int64(), mask=ids == -(1 << 63))
