"""Sets of hashed word shingles of whole texts, computed over Arrow buffers in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_rng = np.random.default_rng(20240229)
BYTES = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(0, 1 << 62)) * 4 + 1
PLACE = _rng.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit words (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Hashes of the words of many texts: polynomials over bytes modulo 2**64, taken from one running sum of a block."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def hashes(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: bytes of texts one after another; starts: where each starts, and the end. Gives word hashes, and the word at which each text starts."""
        n = len(data)
        if n + 1 > len(self.up):
            self.up, self.down = _powers(BASE, n + 1), _powers(pow(BASE, -1, 1 << 64), n + 1)
        data = LOWER[data]
        solid = np.zeros(n + 2, bool)
        solid[1:-1] = ~SPACE[data]
        first = np.zeros(n + 1, bool)
        first[starts] = True
        begin = np.flatnonzero(solid[1:-1] & (~solid[:-2] | first[:-1]))
        end = np.flatnonzero(solid[1:-1] & (~solid[2:] | first[1:])) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTES[data] * self.up[:n], out=total[1:])
        words = mix((total[end] - total[begin]) * self.down[begin] + (end - begin).astype(np.uint64))
        return words, np.searchsorted(begin, starts)


def shingle_sets(texts: pa.Array, n: int, words: Words) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``n`` words as sorted 64-bit hashes; the whole sequence if it has fewer words.

    Words are runs other than of the ASCII white space, A-Z lower-cased. A null text has no words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        to = min(to, len(texts))
        got, begins = words.hashes(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        whole = np.zeros(max(0, len(got) - n + 1), np.uint64)
        for j in range(n):
            whole += got[j : j + len(whole)] * PLACE[j]
        whole = mix(whole)
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(whole[a : b - n + 1])
            elif b > a:
                yield mix((got[a:b] * PLACE[: b - a]).sum(keepdims=True) + PLACE[63 - (b - a)])
            else:
                yield np.zeros(0, np.uint64)
        at = to
