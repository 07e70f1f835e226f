"""Array kernels on UTF-8 bytes: word and shingle hashes of many texts at once, without a Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE = 1 << 18  # bytes that one kernel call works on, or one text if that is longer: its arrays stay in the cache


def trimmed(run: Callable) -> Callable:
    """The same batches; when a task ends, its worker gives free memory back, for it lives on and serves other tasks."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidy


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the published splitmix64 constants)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
FOLDED = BYTES.copy()
FOLDED[65:91] = BYTES[97:123]
PLACE = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) * U(2) + U(1)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
KEPT = 1 << 21
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base, and of its inverse modulo 2 to the 64. Those for texts beyond KEPT bytes are not kept."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        step = np.full(n if n > KEPT else KEPT, U(base))
        step[0] = 1
        made.append(np.multiply.accumulate(step))
    if n <= KEPT:
        _POWERS[:] = made
    return made[0][:n], made[1][:n]


def prefix(buf: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values[byte] * base**position, with a leading 0: the hash of any span is a difference."""
    out = np.empty(len(buf) + 1, U)
    out[0] = 0
    np.cumsum(values[buf] * powers(len(buf))[0], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(U))


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of runs of texts of about `size` bytes; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1))
        yield i, j - i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(buf: np.ndarray, at: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each text's first word (one more entry than texts)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~blank[buf]
    before = np.empty(len(buf), bool)
    before[0], before[1:] = False, solid[:-1]
    inner = at[:-1][at[:-1] < len(buf)]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = False, solid[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(buf: np.ndarray, at: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word (A-Z as a-z), and each text's first word."""
    starts, ends, first = words(buf, at, blank)
    return (spans(prefix(buf, FOLDED), starts, ends) if len(starts) else np.zeros(0, U)), starts, ends, first


def shingle_hashes(buf: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words in order, and each text's first; fewer words make one run of their own."""
    h, _, _, first = word_hashes(buf, at)
    count = np.diff(first)
    n = len(h)
    total = np.zeros(n, U)
    for k in range(size):
        total[: max(0, n - k)] += h[k:] * PLACE[k]
    owner = np.repeat(np.arange(len(count)), count)
    whole = np.arange(n) + size <= first[1:][owner]
    short = np.flatnonzero((count > 0) & (count < size))
    for d in short:  # one entry each; at most size-1 words
        i = first[d]
        m = int(count[d])
        own = (h[i : i + m] * PLACE[:m]).sum(keepdims=True)
        total[i : i + 1] = mix(own + U(m))
        whole[i] = True
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    return mix(total[whole]), np.concatenate(([0], np.cumsum(made)))
