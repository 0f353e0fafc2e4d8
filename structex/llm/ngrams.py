"""Hashes of word n-grams and MinHash signatures, over whole batches of texts at once."""

from __future__ import annotations

import numpy as np

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACES = (_RNG.integers(1, 2**63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words `[^\\x20\\x09-\\x0D]+`, and each text's number of words."""
    return word_places(texts, lower)[:2]


def word_places(texts: list[bytes], lower: bool = False, spaces: np.ndarray = _SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes, and where each word begins and ends in all texts joined; spaces says of each byte if it parts words."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ~spaces[data]
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _upto(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=prefix[1:])
    hashes = mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    counts = np.searchsorted(starts, bounds[1:]) - np.searchsorted(starts, bounds[:-1])
    return hashes, counts, starts, ends


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text, one text after another, and their numbers.

    A text with fewer words than size has one n-gram, all its words; without words it has none.
    """
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    begins = ends - counts
    numbers = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    total = int(numbers.sum())
    if not total:
        return np.empty(0, np.uint64), numbers
    at = np.repeat(begins - (np.cumsum(numbers) - numbers), numbers) + np.arange(total)
    left = np.repeat(ends, numbers) - at
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    mixed = np.zeros(total, np.uint64)
    for place in range(size):
        mixed += np.where(left > place, padded[at + place] * _PLACES[place], np.uint64(0))
    return mix(mixed), numbers


def slices(texts: list[bytes], limit: int = 1 << 20):
    """Ranges of texts of about limit bytes together, so that scratch arrays stay small."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


class MinHash:
    """Signatures of n_hashes minima under independent linear maps of 32-bit n-gram hashes."""

    def __init__(self, n_hashes: int, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.factor = rng.integers(0, 2**32, n_hashes, dtype=np.uint32) | np.uint32(1)
        self.shift = rng.integers(0, 2**32, n_hashes, dtype=np.uint32)

    def signatures(self, hashes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """One row per text; texts without n-grams get rows of the greatest value."""
        out = np.full((len(numbers), len(self.factor)), 0xFFFFFFFF, np.uint32)
        have = np.flatnonzero(numbers)
        if not len(have):
            return out
        offsets = (np.cumsum(numbers) - numbers)[have]
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        for k, (factor, shift) in enumerate(zip(self.factor, self.shift, strict=True)):
            y = x * factor + shift
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            out[have, k] = np.minimum.reduceat(y, offsets)
        return out
