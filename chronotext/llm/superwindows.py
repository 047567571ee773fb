"""Windows of consecutive words, packed into super-windows that share a minimizer.

A window of WINDOW words has WINDOW - K + 1 runs of K words; the one with the least hash (the leftmost of equals) is its
minimizer. It depends on the window's words alone, so equal windows of different documents have equal minimizers at equal
offsets, and consecutive windows with one minimizer make one row instead of many.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_digest, xxh3_64_intdigest

B1 = np.uint64(0x9E3779B97F4A7C15)  # odd, so a power of it has an inverse modulo 2**64
B2 = np.uint64(0xC2B2AE3D27D4EB4F)
_SLOTS = 1 << 20


class WordHashes(dict):
    """Hash of each word seen; emptied when it grows past a bound. Fewer `bits` make collisions likely, for tests."""

    def __init__(self, seed: int = 7, bits: int = 64):
        super().__init__()
        self.seed, self.mask = seed, (1 << bits) - 1

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word, self.seed) & self.mask
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), base, np.uint64), dtype=np.uint64)])[: max(n, 1)]


def rolling(words: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of each run of `size` words."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(base, n), dtype=np.uint64)])
    return _mix((total[size:] - total[:-size]) * _powers(inverse, n - size + 1))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of `width` values, by doubling."""
    out, have = x, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Pieces:
    """The super-windows of many documents at once, as arrays.

    doc: number of the document; first: its word number where the first window starts; count: windows; minimizer: hash
    of the minimizer; digest: 64 bits of the words covered. A document of over a million words is cut at fixed places; the
    rows there are shorter, no window is lost and none changes its minimizer.
    """

    def __init__(self, documents: list[list[bytes]], hashes: WordHashes, window: int, k: int):
        self.window, self.words, self.hashes = window, [w for d in documents for w in d], hashes
        n = len(self.words)
        sizes = np.fromiter(map(len, documents), np.int64, len(documents))
        stops = np.cumsum(sizes)
        self.h = np.fromiter(map(hashes.__getitem__, self.words), np.uint64, n)
        parts = []
        for at in range(0, max(n - window + 1, 0), _SLOTS - window):
            piece = self.h[at : at + _SLOTS - 1]
            if len(piece) >= window:
                parts.append(self._piece(piece, at, np.repeat(stops, sizes), k))
        self.start, self.count, self.minimizer = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
        self.doc = np.searchsorted(stops, self.start, side="right")
        self.first = self.start - np.concatenate([np.zeros(1, np.int64), stops])[self.doc]

    def _piece(self, h: np.ndarray, at: int, stop_of: np.ndarray, k: int):
        grams = rolling(h, k, B1)
        packed = (grams & np.uint64(~(_SLOTS - 1) & 0xFFFFFFFFFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        place = (_sliding_min(packed, self.window - k + 1) & np.uint64(_SLOTS - 1)).astype(np.int64)
        n = len(place)
        valid = np.arange(at + self.window, at + self.window + n) <= stop_of[at : at + n]
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
        first, stops = np.flatnonzero(new), np.append(np.flatnonzero(new | ~valid), n)
        count = stops[np.searchsorted(stops, first, side="right")] - first
        return first + at, count, grams[place[first]].view(np.int64)

    def digest(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.int64)
        line = b" ".join(self.words)
        ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1) - 1
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
        spans = zip(starts[self.start].tolist(), ends[self.start + self.count + self.window - 2].tolist(), strict=True)
        found = np.frombuffer(b"".join([xxh3_64_digest(line[s:e], self.hashes.seed) for s, e in spans]), ">u8").astype(np.uint64)
        return (found & np.uint64(self.hashes.mask)).view(np.int64)


def window_hashes(documents: list[list[bytes]], hashes: WordHashes, window: int, first: list[np.ndarray], count: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of each document from the places `first`, so many as `count` says: the document's number, the window's first
    word, and two 64-bit hashes of its words."""
    docs, places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
    for n, (words, f, c) in enumerate(zip(documents, first, count, strict=True)):
        if len(f):
            h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
            at = np.repeat(f, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            docs.append(np.full(len(at), n))
            places.append(at)
            found.append(np.stack([rolling(h, window, b)[at].view(np.int64) for b in (B1, B2)], axis=1))
    return np.concatenate(docs), np.concatenate(places), np.concatenate(found)
