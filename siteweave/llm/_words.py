"""Vectorised word handling on UTF-8 buffers, shared by the text operators.

A batch of texts is treated as one byte buffer.  Words are maximal runs of
bytes that are neither space nor TAB..CR, so no Python-level loop touches a
word and memory stays proportional to one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; bounds the temporary arrays, never the text.
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_MASK = (1 << 64) - 1


def _splitmix(state: int) -> Iterator[int]:
    while True:
        state = (state + 0x9E3779B97F4A7C15) & _MASK
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        yield z ^ (z >> 31)


def constants(n: int, seed: int, odd: bool = False) -> np.ndarray:
    """n pseudo-random 64-bit numbers that depend on the seed alone."""
    gen = _splitmix(seed)
    return np.array([next(gen) | int(odd) for _ in range(n)], dtype=U64)


_BYTE = constants(256, 11)
_BASE = int(constants(1, 12, odd=True)[0])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers = np.zeros(0, dtype=U64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        table = np.full(max(64, 1 << (n - 1).bit_length()), _BASE, dtype=U64)
        table[0] = 1
        _powers = np.multiply.accumulate(table)
    return _powers


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes; a longer text is its own range."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


class Words:
    """Words of texts ``first..last`` of a buffer: hashes and the texts they are in."""

    __slots__ = ("begin", "end", "hashes", "bounds", "data")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        base, stop = int(offsets[0]), int(offsets[-1])
        data = data[base:stop]
        if lower:
            data = _LOWER[data]
        self.data = data
        inside = ~_SPACE[data]
        n = len(data)
        texts = offsets - base
        first = inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            edge = texts[:-1][texts[:-1] < n]
            first[edge] = inside[edge]
        self.begin = np.flatnonzero(first)
        last = inside
        if n:
            last = inside.copy()
            last[:-1] &= ~inside[1:] | first[1:]
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.begin, texts)
        length = self.end - self.begin
        if not len(length):
            self.hashes = np.zeros(0, U64)
            return
        letters = data[inside]
        at = np.zeros(len(length), np.int64)
        np.cumsum(length[:-1], out=at[1:])
        place = np.arange(len(letters)) - np.repeat(at, length)
        value = _BYTE[letters] * _power_table(int(length.max()))[place]
        self.hashes = mix(np.add.reduceat(value, at) + length.astype(U64))


_STEP = constants(64, 13, odd=True)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words of one text; of the whole text if it is shorter."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    total = words[: n - width + 1] * _STEP[0]
    for j in range(1, width):
        total = total + words[j : n - width + 1 + j] * _STEP[j]
    return mix(total ^ U64(width))
