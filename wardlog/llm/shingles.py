"""Word shingles of whole texts as 64-bit hashes, and minhashes over them (numpy, inside tasks).

Words are runs of characters other than space and \\x09-\\x0D after lower-casing A-Z; `bytes.lower`
and `bytes.split` do exactly that on UTF-8. A shingle's hash is a polynomial over the bytes of its
words joined by one space, taken from prefix sums, so the cost does not depend on shingle length.
"""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_CODES = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


class _Powers:
    """Powers of the multiplier and of its inverse, grown as longer texts come."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 14)
            steps = np.full(size, MULTIPLIER, np.uint64)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps = np.full(size, INVERSE, np.uint64)
            steps[0] = 1
            self.down = np.multiply.accumulate(steps)
        return self.up, self.down


POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than `width` make one shingle; none make none."""
    if not text:
        return np.empty(0, np.uint64)
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    up, down = POWERS.get(len(joined) + 1)
    prefix = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(BYTE_CODES[joined] * up[:len(joined)], out=prefix[1:])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) >= width:
        starts, ends = starts[:len(words) - width + 1], ends[width - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.unique(mix((prefix[ends] - prefix[starts]) * down[starts]))


def minhash_seeds(count: int) -> np.ndarray:
    return np.random.default_rng(75).integers(0, 1 << 63, count, dtype=np.uint64)


def minhashes(hashes: np.ndarray, seeds: np.ndarray, block: int = 4096) -> np.ndarray:
    """One 32-bit minhash per seed; blocks keep the memory small for very long texts."""
    out = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), block):
        part = hashes[at:at + block]
        x = (part[None, :] ^ seeds[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        np.minimum(out, x.min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)
