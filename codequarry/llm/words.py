"""Words of whole texts as 64-bit fingerprints, in numpy.

A fingerprint depends on the bytes alone, so every task and machine agrees. Two different items
share one with probability 2**-64.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BASE, STEP = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
BLOCK = 1 << 20

#: Word bytes of `[^\x20\x09-\x0D]+`; bytes of longer UTF-8 sequences are never white space.
WORD = np.ones(256, dtype=bool)
WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, modulo 2**64, for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 4096, 2 * len(have[0]) if have and len(have[0]) < 2 * BLOCK else 0)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            up = np.full(size, b, dtype=U64)
            up[0] = 1
            both.append(np.cumprod(up, dtype=U64))
        _powers[base] = have = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(text: str | None, lower: bool = False) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return LOWER[data] if lower else data


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word, and the byte after its last."""
    flags = np.zeros(len(data) + 2, dtype=np.int8)
    flags[1:-1] = WORD[data]
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    return edges[::2], edges[1::2]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A fingerprint per word; worked out in blocks, so that long texts need little memory."""
    out = np.empty(len(starts), dtype=U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
        lo, part = starts[i], data[starts[i]:ends[j - 1]]
        up, down = powers(BASE, len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=U64)
        np.cumsum((part.astype(U64) + U64(1)) * up[:len(part)], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(STEP))
        i = j
    return out


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    data = text_bytes(text, lower)
    return hash_words(data, *spans(data))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A fingerprint for each run of `size` words, by the word it starts at."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    out = np.empty(n, dtype=U64)
    for i in range(0, n, BLOCK):
        part = hashes[i:i + BLOCK + size - 1]
        up, down = powers(STEP, len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=U64)
        np.cumsum(part * up[:len(part)], out=sums[1:])
        out[i:i + BLOCK] = mix((sums[size:] - sums[:-size]) * down[:len(part) - size + 1] + U64(size))
    return out


def shingle_set(text: str | None, size: int, lower: bool = True) -> np.ndarray:
    """Sorted distinct fingerprints of the runs of `size` words; a shorter text is one run."""
    hashes = word_hashes(text, lower)
    return np.unique(windows(hashes, min(size, len(hashes)))) if len(hashes) else hashes


def pack(values: np.ndarray, keep: int = 8) -> bytes:
    """The `keep` highest bytes of each value, byte plane by byte plane: equal planes compress."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(planes[:, 8 - keep:].T).tobytes()


def unpack(data: bytes, keep: int = 8) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(keep, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, 8 - keep:] = planes.T
    return out.view(U64).ravel()
