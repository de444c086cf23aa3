"""Words and their hashes for whole batches of texts, in numpy without a Python object per word."""

from __future__ import annotations

import numpy as np

#: Bytes that separate words: space and 0x09-0x0D.
SPACES = (0x20, *range(0x09, 0x0E))
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3: spreads every input bit over 64 bits."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers (splitmix64)."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * U64(0x9E3779B97F4A7C15)) | U64(1)


def byte_codes(seed: int, lower: bool, separators: tuple[int, ...]) -> np.ndarray:
    """A random number for each byte, 0 for separators; with lower, A-Z count as a-z."""
    codes = stream(256, seed)
    if lower:
        codes[0x41:0x5B] = codes[0x61:0x7B]
    codes[list(separators)] = 0
    return codes


class Words:
    """Words of a batch: byte ranges [start, end), the text of each, and the first word of each text (first[i]..first[i+1])."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, separators: tuple[int, ...] = SPACES):
        self.raw, self.at, self.separators = raw, at, separators
        space = np.zeros(256, bool)
        space[list(separators)] = True
        inside = ~space[raw]
        begins, ends = inside.copy(), inside.copy()
        if len(raw):
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edge = at[(at > 0) & (at < len(raw))]
            begins[edge] = inside[edge]
            ends[edge - 1] = inside[edge - 1]
        self.begins = begins
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)

    def place(self) -> np.ndarray:
        """The position of each byte in its word (of no meaning for separators)."""
        at = np.arange(len(self.raw)) - self.start[np.maximum(np.cumsum(self.begins) - 1, 0)]
        at[: self.start[0]] = 0
        return at

    def hashes(self, lower: bool = False, seed: int = 1, prefixes: tuple[int, ...] = ()) -> np.ndarray | list[np.ndarray]:
        """A 64-bit hash of each word: the sum of byte code times position code, mixed. With prefixes, a list: that and the hash of as many bytes of each."""
        if not len(self.start):
            return [np.zeros(0, U64)] * (1 + len(prefixes)) if prefixes else np.zeros(0, U64)
        place = self.place()
        codes = stream(int(place.max()) + 1, seed + 100)[place]
        codes *= byte_codes(seed, lower, self.separators)[self.raw]
        whole = mix(np.add.reduceat(codes, self.start))
        if not prefixes:
            return whole
        return [whole, *(mix(np.add.reduceat(np.where(place < n, codes, U64(0)), self.start) + U64(n)) for n in prefixes)]


def sequences(hashes: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """The hash of each k consecutive words, starting at each word (those that cross texts have to be left out by the caller)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total, codes = np.zeros(n, U64), stream(k, seed)
    for i in range(k):
        total += hashes[i : i + n] * codes[i]
    return mix(total)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i]+1, ... (lengths[i] of them) one after another."""
    if not len(lengths) or not lengths.sum():
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(before - starts, lengths)
