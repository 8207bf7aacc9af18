"""Words and word n-grams of Arrow text columns as numpy arrays, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once, if one document is not longer; bounds the memory of a task.
SLICE = 1 << 19
#: The first k bytes of eight, for k from 0.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their bounds; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def slices(bounds: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or of one longer text."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of texts ``i`` to ``j``: byte bounds ``start`` and ``end``, ``doc`` (from 0), 64-bit ``hash``.

    ``first`` holds the number of the first word of every text and, last, the number of words.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, i: int, j: int, lower: bool = False, hashed: bool = True):
        at = bounds[i : j + 1] - bounds[i]
        part = data[bounds[i] : bounds[j]]
        n = len(part)
        # Differences of bytes wrap, so a range takes one comparison.
        word = (part != 32) & (part - np.uint8(9) > 4)
        begins = np.zeros(n + 1, bool)
        begins[at[:-1]] = True
        before = np.r_[False, word[:-1]] if n else word
        self.start = np.flatnonzero(word & (~before | begins[:n]))
        after = np.r_[word[1:], False] if n else word
        begins[n] = True
        self.end = np.flatnonzero(word & (~after | begins[1:])) + 1
        self.bytes = part
        self.first = np.searchsorted(self.start, at)
        self.doc = np.repeat(np.arange(j - i), np.diff(self.first))
        if lower and hashed:
            part = part + ((part - np.uint8(65) < 26).view(np.uint8) << 5)
        self.hash = self._hashes(part) if hashed else None

    def _hashes(self, part: np.ndarray) -> np.ndarray:
        """Every eight bytes of a word are mixed with their place, and the results added and mixed again.

        The mixing is not linear, so that words built to collide under a polynomial do not.
        """
        size = self.end - self.start
        padded = np.concatenate([part, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(part) + 1, "<u8", padded, strides=(1,))
        salt = mixed(np.arange(int(size.max() + 7 >> 3) if len(size) else 1, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        own = mixed((eight[self.start] & _FIRST[np.minimum(size, 8)]) ^ salt[0])
        long = np.flatnonzero(size > 8)
        if len(long):
            # The other blocks of longer words.
            blocks = (size[long] - 1) >> 3
            first = np.cumsum(blocks) - blocks
            place = np.arange(int(blocks.sum())) - np.repeat(first, blocks) + 1
            at = np.repeat(self.start[long], blocks) + 8 * place
            left = np.minimum(np.repeat(size[long], blocks) - 8 * place, 8)
            value = mixed((eight[at] & _FIRST[left]) ^ salt[place])
            own[long] += np.add.reduceat(value, first)
        return mixed(own + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def grams(self, width: int) -> np.ndarray:
        """Hash of the ``width`` words from every word on; meaningless where ``fits`` is false."""
        n = len(self.start)
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out[: n - k] = out[: n - k] * np.uint64(0xA0761D6478BD642F) + self.hash[k:] if n > k else out[: n - k]
        return mixed(out + np.uint64(width))

    def fits(self, width: int) -> np.ndarray:
        """Whether ``width`` words of the same text follow from every word on."""
        left = self.first[1:][self.doc] - np.arange(len(self.start))
        return left >= width
