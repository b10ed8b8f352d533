"""Numpy kernels over the bytes of many texts at once.

A block is a run of whole texts: ``data`` (bytes, UTF-8) and ``offsets`` (row i is
data[offsets[i]:offsets[i+1]]). Work goes block by block, so that memory follows the block size
or, if larger, the longest text.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20

_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def per_process(key: Hashable, make: Callable):
    """What ``make`` gives, made once per Python process. Functions of this package travel to
    the workers by value, with module globals of their own for each task, so what is dear to
    make is kept in a module of the process."""
    kept = sys.modules.setdefault("codeloom_process", ModuleType("codeloom_process")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def text_array(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, most: int = BLOCK
           ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, offsets) of runs of rows of at most ``most`` bytes."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        end = min(max(end, first + 1), rows)
        yield (first, end, data[offsets[first]:offsets[end]],
               offsets[first:end + 1] - offsets[first])
        first = end


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(name: str, base: int, n: int) -> np.ndarray:
    def make(size: int) -> np.ndarray:
        steps = np.full(size, base & _MASK, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    if n > BLOCK + 1:  # a text longer than a block: not kept
        return make(n)
    return per_process(f"powers {name}", lambda: make(BLOCK + 1))[:n]


def _byte_values(fold: bool) -> np.ndarray:
    def make() -> np.ndarray:
        codes = np.arange(256, dtype=np.uint64)
        if fold:
            codes[65:91] += np.uint64(32)
        return mix64((codes + np.uint64(1)) * np.uint64(_STEP)) | np.uint64(1)

    return per_process(f"bytes {fold}", make)


class Hashes:
    """64-bit hashes of any byte ranges of a block, from one prefix sum."""

    def __init__(self, data: np.ndarray, fold: bool = False):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values(fold)[data] * _powers("up", _STEP, len(data)),
                  dtype=np.uint64, out=self.sums[1:])
        self.down = _powers("down", pow(_STEP, -1, 1 << 64), len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        spans = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix64(spans + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs without white space, or of the bytes marked
    ``inside``; runs end with their row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    if inside is None:
        inside = per_process("inside", lambda: np.array(
            [not (b == 32 or 9 <= b <= 13) for b in range(256)]))[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def distinct(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Mask of the first of each equal (row, hash)."""
    if not len(row):
        return np.zeros(0, bool)
    key = hashes + mix64((row.astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(row), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    keep = np.zeros(len(row), bool)
    keep[order[new]] = True
    return keep


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words with A to Z in lower case, eight bytes at a time."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    folded = np.zeros(len(data) + 16, np.uint8)
    folded[:len(data)] = per_process("fold", lambda: np.frombuffer(
        bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)), np.uint8))[data]
    eights = np.ndarray((len(data) + 8,), "<u8", folded, strides=(1,))
    masks = per_process("masks", lambda: np.array(
        [(1 << 8 * k) - 1 for k in range(8)] + [_MASK], np.uint64))
    length = ends - starts
    out = mix64((eights[starts] & masks[np.minimum(length, 8)])
                + length.astype(np.uint64) * np.uint64(_STEP))
    live, at = np.flatnonzero(length > 8), 8
    while len(live):
        part = eights[starts[live] + at] & masks[np.minimum(length[live] - at, 8)]
        out[live] = mix64(out[live] * np.uint64(_STEP) + part)
        at += 8
        live = live[length[live] > at]
    return out


def shingles(hashes: np.ndarray, row: np.ndarray, rows: int, width: int = 5
             ) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct runs of ``width`` words per row, in row order; a row with
    fewer words has its whole sequence as one."""
    n = len(hashes)
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    factors = mix64(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        total[:n - k] += hashes[k:] * factors[k]
    starts = np.arange(n) + width <= first[row] + count[row]
    for c in range(1, width):  # short rows
        at = first[count == c]
        total[at] = sum(hashes[at + k] * factors[k] for k in range(c)) + np.uint64(c)
        starts[at] = True
    row, total = row[starts], mix64(total[starts])
    new = distinct(row, total)
    return row[new], total[new]


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..counts[0]-1, 0..counts[1]-1, and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def pack48(values: np.ndarray) -> bytes:
    """The low 48 bits of each value, 6 bytes each."""
    return np.ascontiguousarray(
        values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    small = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(small), 8), np.uint8)
    wide[:, :6] = small
    return wide.view("<u8").ravel().astype(np.uint64)
