"""Vectorised hashes over batches of texts."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
#: A random number for each byte, and odd multipliers.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODD = _rng.integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * ODD[0]
    return h ^ (h >> np.uint64(29))


def window_hashes(data: np.ndarray, doublings: int) -> np.ndarray:
    """Hash of the 2**doublings bytes from each position."""
    h, width = BYTE[data], 1
    for k in range(doublings):
        h = h[:-width] * ODD[1 + k] + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return h


def sliding(h: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over width values from each position."""
    have = 1
    while have * 2 <= width:
        h = best(h[:-have], h[have:])
        have *= 2
    return best(h[: len(h) - (width - have)], h[width - have :]) if width > have else h


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        base = int(ODD[12])
        for k, b in enumerate((base, pow(base, -1, 1 << 64))):
            table = np.full(n, b, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text); letters A-Z count as lower case."""
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(ends) > len(starts):  # a leading space is no end
        ends = ends[-len(starts) :] if len(starts) else ends[:0]
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * power[:-1], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * ODD[13])
    bounds = np.cumsum([len(r) + 1 for r in raw])
    return words, np.diff(np.searchsorted(starts, bounds), prepend=0)


def shingle_sets(raw: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document numbers) of the distinct shingles of each text, sorted by document and hash.

    A text with fewer words than size, but one at least, has one shingle of all its words.
    """
    words, counts = word_hashes(raw)
    doc = np.repeat(np.arange(len(raw)), counts)
    parts, docs = [], []
    if len(words) >= size:
        h = words[: len(words) - size + 1] * ODD[2]
        for j in range(1, size):
            h = mix(h + words[j : len(words) - size + 1 + j]) * ODD[2]
        inside = doc[: len(h)] == doc[size - 1 :]
        parts.append(mix(h[inside]))
        docs.append(doc[: len(h)][inside])
    first = np.cumsum(counts) - counts
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            h = words[first[short]] * ODD[3]
            for j in range(1, n):
                h = mix(h + words[first[short] + j]) * ODD[3]
            parts.append(mix(h + np.uint64(n)))
            docs.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, d = np.concatenate(parts), np.concatenate(docs)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[keep], d[keep]
