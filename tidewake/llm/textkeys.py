"""64-bit keys of words and shingles, computed over whole Arrow text columns by numpy.

A word is a run of bytes other than space and tab to carriage return; A-Z are lower-cased
first. Keys are 64 bits wide: two of a billion different words share one with probability
below 3 %, two words of a pair of documents practically never.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes hashed at a time: the temporary arrays take about sixty times as much.
PIECE = 1 << 19

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (multiply and shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


LETTER = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
LETTER[SPACE] = 0
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """At least the first ``n`` powers of the odd base."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 1024) + n // 2, _STEP, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column (NULL as empty) and the n + 1 offsets."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def batches(iterator, column: str, size: int = 1 << 22):
    """Arrow batches cut to about ``size`` bytes of text or a single row, each with the bytes and
    offsets of its text column."""
    for batch in iterator:
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            part = batch.slice(at, end - at)
            yield part, *text_bytes(part.column(column))
            at = end


def _pieces(data: np.ndarray, edge: np.ndarray):
    """Ranges of about PIECE bytes that end at white space or where a text begins."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data):
            hit = np.flatnonzero(SPACE[data[end : end + PIECE]] | edge[end : min(len(data), end + PIECE)])
            if len(hit):
                end += int(hit[0])
                break
            end += PIECE
        end = min(end, len(data))
        yield at, end
        at = end


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of every word in order, and the index of each text's first word (n + 1 of them)."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    keys, places = [], []
    for at, end in _pieces(data, edge):
        piece = LOWER[data[at:end]]
        space = SPACE[piece]
        first = ~space
        first[1:] &= space[:-1] | edge[at + 1 : end]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        piece = piece[starts[0] :]
        places.append(starts + at)
        starts = starts - starts[0]
        lengths = np.diff(np.append(starts, len(piece)))
        within = np.arange(len(piece)) - np.repeat(starts, lengths)
        keys.append(mix(np.add.reduceat(LETTER[piece] * powers(int(lengths.max()))[within], starts)))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(keys), np.searchsorted(np.concatenate(places), offsets)


def shingle_keys(words: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct keys of its runs of ``width`` words; a text of fewer words
    has one for all of them, a text without words has none."""
    count = np.diff(first)
    ends = np.repeat(first[1:], count)
    index = np.arange(len(words))
    padded = np.append(words, np.zeros(width, np.uint64))
    key = np.zeros(len(words), np.uint64)
    for j in range(width):
        key = key * _STEP + np.where(index + j < ends, padded[j : j + len(words)], np.uint64(0))
    key = mix(key)
    kept = np.maximum(count - (width - 1), np.minimum(count, 1))
    return [np.unique(key[a : a + n]) for a, n in zip(first[:-1].tolist(), kept.tolist())]
