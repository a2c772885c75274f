"""Vectorised hashes of words and of runs of bytes or words, over Arrow batches.

All hashes are functions of the content alone: equal runs have equal hashes in
every document, task and run. Texts are worked on in chunks of CHUNK bytes or
one text, so memory is bounded by the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def thrifty(rows: Callable) -> Callable:
    """An iterator function whose worker gives back what it has freed at the end of a task.

    Workers are kept for later tasks; without this, memory stays with them at the height of the task that needed most.
    """

    def thrifty_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        give_back()

    return thrifty_rows


def give_back() -> None:
    """Free memory of the allocators to the system, where they can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 1), base % 2**64, _U)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _powers[base] = have = np.cumprod(steps, dtype=_U)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class RunHashes:
    """Hashes of any run of a sequence of 64-bit values, from its prefix sums."""

    def __init__(self, values: np.ndarray, base: int = BASE):
        self.inverse = powers(pow(base, -1, 2**64), len(values) + 1)
        self.sums = np.zeros(len(values) + 1, _U)
        with np.errstate(over="ignore"):
            np.cumsum(values * powers(base, len(values)), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(_U))


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive texts; null texts are empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    valid = None if column.null_count == 0 else np.asarray(column.is_valid())
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        j = min(j, len(column))
        own = offsets[i : j + 1]
        body = data[own[0] : own[-1]]
        own = own - own[0]
        if valid is not None and not valid[i:j].all():  # what a null's slot holds is undefined
            lengths = np.where(valid[i:j], np.diff(own), 0)
            body = np.concatenate([body[a : a + n] for a, n in zip(own, lengths, strict=False)]) if len(lengths) else body[:0]
            own = np.concatenate([[0], np.cumsum(lengths)])
        yield i, body, own
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs other than ASCII white space), and how many words come before each text."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~_GAP[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | fresh))
    ends = np.flatnonzero(before & (~inside | fresh))
    return starts, ends, np.searchsorted(starts, offsets)


def word_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit value per word, with what ``word_bounds`` gives."""
    starts, ends, first = word_bounds(data, offsets)
    return RunHashes(data.astype(_U) + _U(1)).of(starts, ends), starts, ends, first
