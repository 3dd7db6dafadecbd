"""Vectorised words, word hashes and word-window hashes over many texts at once.

A word is a maximal run of bytes other than the six ASCII white-space characters. Hashes are
64-bit polynomials with a random value for each byte, passed through a bit mixer, so that equal
words have equal hashes wherever they stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

GAP = re.compile(rb"[\x20\x09-\x0d]")
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same values, but A-Z count as a-z.
BYTE_FOLDED = BYTE.copy()
BYTE_FOLDED[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 2**64)
CHUNK_BYTES = 1 << 19
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64; kept while they are small."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for base in (BASE, BASE_INV):
        a = np.full(n, base, np.uint64)
        a[0] = 1
        made.append(np.cumprod(a, dtype=np.uint64))
    if n <= 4 * CHUNK_BYTES:
        _powers[:] = made
    return made[0], made[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Mixed polynomial hashes of any spans of an array of 64-bit values."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(max(1, len(values)))
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair."""
    return Spans(values)(start, end)


def chunked(texts: list[bytes | None], most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about ``most`` bytes, with the index of the first; null reads as empty."""
    at, size, run = 0, 0, []
    for i, t in enumerate(texts):
        t = t or b""
        if run and size + len(t) > most:
            yield at, run
            at, size, run = i, 0, []
        run.append(t)
        size += len(t) + 1
    if run:
        yield at, run


def _cuts(data: bytes) -> Iterator[tuple[int, int]]:
    """Stretches of some ``CHUNK_BYTES`` that end behind white space, as the data does, so that no word is cut."""
    at = 0
    while at < len(data):
        space = GAP.search(data, min(at + CHUNK_BYTES, len(data) - 1))
        yield at, space.end()
        at = space.end()


class Words:
    """Words of a run of texts: start and end in ``data``, 64-bit hash, and each text's range of words.

    Hashes don't depend on the place, so they are taken stretch by stretch: what a long text takes beside itself
    is three numbers a word.
    """

    def __init__(self, texts: list[bytes], fold: bool = False):
        self.data = b"\n".join(texts) + b"\n"
        values = BYTE_FOLDED if fold else BYTE
        found = [], [], []
        for at, end in _cuts(self.data):
            raw = np.frombuffer(self.data, np.uint8, end - at, at)
            edge = np.flatnonzero(np.diff(SPACE[raw], prepend=True))
            first, last = edge[0::2], edge[1::2]
            for kept, part in zip(found, (first + at, last + at, spans(values[raw], first, last)), strict=True):
                kept.append(part)
        self.start, self.end, self.hash = (x[0] if len(x) == 1 else np.concatenate(x) for x in found)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.base = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.start, self.base)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of k words that lies in one text, by start; and whether it does."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        hashes = np.empty(n - k + 1, np.uint64)
        for start in range(0, n - k + 1, CHUNK_BYTES):
            some = self.hash[start : start + CHUNK_BYTES + k - 1]
            at = np.arange(len(some) - k + 1)
            hashes[start : start + len(at)] = spans(some, at, at + k)
        text = np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), np.diff(self.first))
        return hashes, text[: n - k + 1] == text[k - 1 :]
