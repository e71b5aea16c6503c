"""Words of texts as 64-bit hashes, whole batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SEGMENT = 1 << 18  # bytes hashed at once, of which about 100 times as many are in use meanwhile; a longer text is cut at white space
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: list[np.ndarray] = []

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SEGMENT + 1024)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _hash_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words `[^ \\t-\\r]+` of a piece of text, A-Z lower-cased."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = ~_SPACE[raw]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The words of each text in order, as hashes. The same word has the same hash everywhere."""
    pack: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        starts, hashes = _hash_segment(b" ".join(pack))
        borders = np.cumsum([0, *(len(x) + 1 for x in pack)])
        at = np.searchsorted(starts, borders)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield hashes[a:b]

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > SEGMENT:
            if pack:
                yield from flush()
                pack, size = [], 0
            parts, a = [], 0
            while a < len(data):
                b = min(len(data), a + SEGMENT)
                while b < len(data) and not _SPACE[data[b]]:
                    b += 1
                parts.append(_hash_segment(data[a:b])[1])
                a = b
            yield np.concatenate(parts)
            continue
        if size + len(data) > SEGMENT and pack:
            yield from flush()
            pack, size = [], 0
        pack.append(data)
        size += len(data) + 1
    if pack:
        yield from flush()


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the `k`-word shingles; fewer words than `k` are one shingle, no words none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    step = np.uint64(0xD6E8FEB86659FD93)
    width = min(n, k)
    total = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        total = total * step + words[j : n - width + 1 + j]
    return np.unique(mix(total + np.uint64(width)))
