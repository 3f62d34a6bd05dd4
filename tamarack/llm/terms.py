"""Alphanumeric words of many texts at once, as arrays over Arrow's buffers.

A word is a run of the bytes 0-9, A-Z, a-z and 0x80-0xFF, A-Z in lower case: in UTF-8 these are the runs of digits,
letters of ASCII and all characters beyond it. Every step is a numpy operation over a block of bounded size, so a word
costs no Python object. Texts longer than a block are cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from tamarack.llm.words import _hashes as word_hashes

BLOCK_BYTES = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
INSIDE = np.zeros(256, dtype=bool)
INSIDE[48:58] = INSIDE[65:91] = INSIDE[97:123] = INSIDE[128:] = True


class Terms(NamedTuple):
    """The words of a block, in order: row in the column, place (from 0 in its text), first byte in the column's data,
    length in bytes and 64-bit hash."""

    row: np.ndarray
    place: np.ndarray
    start: np.ndarray
    length: np.ndarray
    hash: np.ndarray


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data of a string column as bytes, and where its rows begin and end there."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    _, offsets, values = column.buffers()
    if offsets is None or not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    ends = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(values, dtype=np.uint8) if values else np.empty(0, dtype=np.uint8), ends


def _cut(data: np.ndarray, lo: int, at: int) -> int:
    """The last place up to ``at`` where no word of data[lo:] is open, else the first one behind it."""
    back = np.flatnonzero(~INSIDE[data[lo:at]])
    if len(back):
        return lo + int(back[-1]) + 1
    step = 1 << 20
    for a in range(at, len(data), step):
        ahead = np.flatnonzero(~INSIDE[data[a : a + step]])
        if len(ahead):
            return a + int(ahead[0]) + 1
    return len(data)


def terms_of(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Terms]:
    """The words of a string column in blocks of about ``limit`` bytes; only a single word can make one longer.

    Nulls are texts without words.
    """
    data, ends = column_bytes(column)
    row, seen = 0, 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1)
        lo, hi = int(ends[row]), int(ends[to])
        if hi - lo <= limit:
            yield _block(data, lo, hi, ends[row:to], row, 0)
        else:  # one long text
            at, seen = lo, 0
            while at < hi:
                end = hi if hi - at <= limit else min(hi, _cut(data[:hi], at, at + limit))
                found = _block(data, at, end, np.array([at]), row, seen)
                seen += len(found.row)
                yield found
                at = end
        row = to


def _block(data: np.ndarray, lo: int, hi: int, begins: np.ndarray, row: int, seen: int) -> Terms:
    """Words of data[lo:hi], where texts begin at ``begins``; the first is of row ``row`` and had ``seen`` words before."""
    n = hi - lo
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = LOWER[data[lo:hi]]
    inside = INSIDE[data[lo:hi]]
    first = np.zeros(n + 1, dtype=bool)
    first[begins - lo] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= first[1:n] | ~inside[:-1]
    end[:-1] &= first[1:n] | ~inside[1:]
    starts = np.flatnonzero(start)
    lengths = np.flatnonzero(end) + 1 - starts
    text = np.searchsorted(begins - lo, starts, side="right") - 1
    place = np.arange(len(starts)) - np.searchsorted(text, text, side="left") if len(begins) > 1 else np.arange(len(starts)) + seen
    return Terms(text + row, place, starts + lo, lengths, word_hashes(padded, starts, lengths) if len(starts) else np.empty(0, dtype=np.uint64))


def joined(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes in lower case, one behind the other with a space behind each, and where each begins."""
    wide = length + 1
    ends = np.cumsum(wide)
    begins = ends - wide
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(begins - start, wide)
    out = LOWER[data[np.minimum(at, max(len(data) - 1, 0))]] if len(data) else np.empty(0, dtype=np.uint8)
    if len(ends):
        out[ends - 1] = 32
    return out, begins


class HashSet(NamedTuple):
    """Sorted distinct 64-bit hashes behind a table of bits that most others fail."""

    hashes: np.ndarray
    maybe: np.ndarray
    shift: np.uint64

    @classmethod
    def of(cls, hashes: np.ndarray) -> HashSet:
        hashes = np.unique(np.asarray(hashes, dtype=np.uint64))
        bits = min(26, max(12, int(16 * len(hashes)).bit_length()))
        shift = np.uint64(64 - bits)
        maybe = np.zeros(1 << bits, dtype=bool)
        maybe[hashes >> shift] = True
        return cls(hashes, maybe, shift)

    def find(self, hashes: np.ndarray, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` (where ``where`` holds) are in the set, and their places in it."""
        maybe = self.maybe[hashes >> self.shift]
        at = np.flatnonzero(maybe if where is None else maybe & where)
        if not len(at) or not len(self.hashes):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        equal = self.hashes[place] == hashes[at]
        return at[equal], place[equal]
