"""Words of many texts at once, as arrays.

A word is a run of bytes without 0x20 and 0x09-0x0D, A-Z in lower case. Texts are taken from Arrow's
buffer of concatenated strings as they are, in blocks of bounded size, and every step is a numpy
operation over a block, so a text costs no Python objects.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.ones(256, dtype=bool)
_INSIDE[[32, 9, 10, 11, 12, 13]] = False
#: Masks that keep the first k bytes of eight, little-endian.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    """The words of a block: hash, line (from 0 in the block); for each line with a word its text and place."""

    hash: np.ndarray
    line: np.ndarray
    text_of_line: np.ndarray
    pos_of_line: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of words; ``data`` has eight bytes behind the last word."""
    eights = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    short = eights[starts] & _FIRST[np.minimum(lengths, 8)]
    out = mix(short + _M3)
    long = np.flatnonzero(lengths > 8)
    if len(long):  # what is behind the first eight bytes, eight at a time, with their places
        more = (lengths[long] - 1) >> 3
        own = np.repeat(np.arange(len(long)), more)
        k = np.arange(len(own)) - np.repeat(np.cumsum(more) - more, more) + 1
        left = lengths[long][own] - 8 * k
        part = eights[starts[long][own] + 8 * k] & _FIRST[np.minimum(left, 8)]
        part = mix(part + (k.astype(np.uint64) + np.uint64(1)) * _M3)
        out[long] += np.add.reduceat(part, np.cumsum(more) - more)
    return mix(out + lengths.astype(np.uint64) * _M2)


def block_words(data: np.ndarray, begins: np.ndarray) -> Words:
    """Words of texts that stand one behind the other in ``data``; text i begins at ``begins[i]``."""
    n = len(data)
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = _LOWER[data]
    inside = _INSIDE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[begins] = True
    first[0] = True
    start = inside.copy()
    start[1:] &= first[1:n] | ~inside[:-1]
    end = inside.copy()
    end[:-1] &= first[1:n] | ~inside[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    if not len(starts):
        none = np.empty(0, dtype=np.int64)
        return Words(none.astype(np.uint64), none, none, none)
    text = np.searchsorted(begins, starts, side="right") - 1
    feeds = np.flatnonzero(data == 10)
    place = np.searchsorted(feeds, starts)  # line feeds before the word
    new = np.r_[True, (text[1:] != text[:-1]) | (place[1:] != place[:-1])]
    at = np.flatnonzero(new)
    text_of_line = text[at]
    pos = place[at] - np.searchsorted(feeds, begins)[text_of_line]
    return Words(_hashes(padded, starts, ends - starts), np.cumsum(new) - 1, text_of_line, pos)


def _feed_before(data: np.ndarray, lo: int, at: int) -> int:
    """Behind the last line feed of data[lo:at], else behind the first one from ``at`` on, else the end."""
    back = np.flatnonzero(data[lo:at] == 10)
    if len(back):
        return lo + int(back[-1]) + 1
    step = 1 << 20
    for a in range(at, len(data), step):
        ahead = np.flatnonzero(data[a : a + step] == 10)
        if len(ahead):
            return a + int(ahead[0]) + 1
    return len(data)


def words_of(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, Words]]:
    """(rows, words) for blocks of a string column: rows[i] is the row of the block's text i.

    A block holds about ``limit`` bytes. Texts longer than that are cut at line feeds, so only a
    single line can make a block longer; ``pos_of_line`` counts from the beginning of the text.
    Nulls are texts without words.
    """
    if not len(column):
        return
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values else np.empty(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[end])
        if hi - lo <= limit:
            yield np.arange(row, end), block_words(data[lo:hi], offsets[row:end] - lo)
        else:  # one long text
            text, at, feeds = data[lo:hi], 0, 0
            while at < len(text):
                to = len(text) if len(text) - at <= limit else _feed_before(text, at, at + limit)
                found = block_words(text[at:to], np.zeros(1, dtype=np.int64))
                yield np.array([row]), found._replace(pos_of_line=found.pos_of_line + feeds)
                feeds += int(np.count_nonzero(text[at:to] == 10))
                at = to
        row = end
