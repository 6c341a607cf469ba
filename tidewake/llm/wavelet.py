"""Wavelet matrix: a sequence of integers as bit planes with rank and select.

Plane k holds bit k (from the highest) of every value, in an order in which the planes before
it have stably moved zeros to the front. Beside each plane stands the number of ones before
every block of 512 bits. One byte string holds a sequence, its planes and the documents it is
made of; it answers access, count and occurrence queries without being decoded.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"WVM1"
BLOCK = 512
#: Magic, bits of a value, values, documents.
HEAD = "<4sIQQ"


def encode(values: np.ndarray, bits: int, doc_ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """File image of a sequence; ``doc_ids`` and ``sizes`` name the documents and their lengths."""
    n, order = len(values), values
    parts = [doc_ids.astype("<i8").tobytes(), sizes.astype("<i8").tobytes()]
    for k in range(bits - 1, -1, -1):
        one = order & order.dtype.type(1 << k) != 0
        plane = np.packbits(one, bitorder="little")
        filled = np.zeros(-(-n // BLOCK) * (BLOCK // 8), np.uint8)
        filled[: len(plane)] = plane
        ones = np.bitwise_count(filled.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1)
        parts += [filled.tobytes(), np.append(0, np.cumsum(ones)).astype("<u4").tobytes()]
        order = np.concatenate((np.compress(~one, order), np.compress(one, order)))
    return struct.pack(HEAD, MAGIC, bits, n, len(doc_ids)) + b"".join(parts)


class WaveletMatrix:
    """Reader of a file image; nothing is unpacked before it is asked for."""

    def __init__(self, image: bytes):
        magic, self.bits, self.n, docs = struct.unpack_from(HEAD, image)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        at = struct.calcsize(HEAD)
        self.doc_ids = np.frombuffer(image, "<i8", docs, at)
        self.sizes = np.frombuffer(image, "<i8", docs, at + 8 * docs)
        at += 16 * docs
        blocks = -(-self.n // BLOCK)
        self.planes, self.ranks = [], []
        for _ in range(self.bits):
            self.planes.append(np.frombuffer(image, np.uint8, blocks * (BLOCK // 8), at))
            at += blocks * (BLOCK // 8)
            self.ranks.append(np.frombuffer(image, "<u4", blocks + 1, at))
            at += 4 * (blocks + 1)

    def _ones(self, k: int, i: int) -> int:
        """Ones before position i of plane k."""
        block = i // BLOCK
        start = block * (BLOCK // 8)
        whole = int(np.bitwise_count(self.planes[k][start : i // 8]).sum())
        part = int(self.planes[k][i // 8] & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0
        return int(self.ranks[k][block]) + whole + part

    def _zeros(self, k: int) -> int:
        return self.n - int(self.ranks[k][-1])

    def _locate(self, k: int, one: bool, j: int) -> int:
        """Position of the j-th (from 0) one or zero of plane k."""
        counts = self.ranks[k].astype(np.int64)
        if not one:
            counts = np.arange(len(counts)) * BLOCK - counts
        block = int(np.searchsorted(counts, j, side="right")) - 1
        bits = np.unpackbits(self.planes[k][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[j - int(counts[block])])

    def access(self, i: int) -> int:
        """Value at position i."""
        value = 0
        for k in range(self.bits):
            one = self.planes[k][i // 8] >> (i % 8) & 1
            value = value << 1 | int(one)
            i = self._zeros(k) + self._ones(k, i) if one else i - self._ones(k, i)
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Start of the value's run in the last order, and how many lie before position i."""
        start = 0
        for k in range(self.bits):
            if value >> (self.bits - 1 - k) & 1:
                start, i = self._zeros(k) + self._ones(k, start), self._zeros(k) + self._ones(k, i)
            else:
                start, i = start - self._ones(k, start), i - self._ones(k, i)
        return start, i - start

    def rank(self, value: int, i: int) -> int:
        """Occurrences of a value before position i (0 to n)."""
        return self._range(value, i)[1] if 0 <= value < 1 << self.bits else 0

    def select(self, value: int, j: int) -> int:
        """Position of the j-th (from 0) occurrence of a value."""
        if not 0 <= j < self.rank(value, self.n):
            raise IndexError(j)
        at = self._range(value, 0)[0] + j
        for k in range(self.bits - 1, -1, -1):
            one = bool(value >> (self.bits - 1 - k) & 1)
            at = self._locate(k, one, at - self._zeros(k) if one else at)
        return at

    def values(self) -> np.ndarray:
        """The whole sequence, undoing the planes from the last to the first."""
        order = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n, bitorder="little").astype(bool)
            zeros = self._zeros(k)
            above = np.empty_like(order)
            above[np.flatnonzero(~one)] = order[:zeros]
            above[np.flatnonzero(one)] = order[zeros:]
            order = above | (one.astype(order.dtype) << order.dtype.type(self.bits - 1 - k))
        return order
