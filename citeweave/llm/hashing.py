"""Vectorised 64-bit hashes of words and of runs of words, over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

M64 = (1 << 64) - 1
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes whose texts are hashed at once.
CHUNK = 1 << 20

_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_of_byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(n: int) -> list[np.ndarray]:
    """BASE**0 to BASE**n and the same of its inverse; kept up to a few chunks, a longer text makes its own."""
    if len(_powers[0]) > n:
        return _powers
    out = []
    for b in (BASE, BASE_INVERSE):
        x = np.full(max(n, CHUNK) + 1, b, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    if n <= 4 * CHUNK:
        _powers[:] = out
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, starts, ends, buffer): a hash for each word (run without ASCII white space) of the texts laid end
    to end; text k has words first[k] to first[k + 1]; starts and ends are places in buffer."""
    sizes = np.array([0, *(len(t) + 1 for t in texts)], np.int64)
    buffer = np.frombuffer(b" ".join([*texts, b""]) if texts else b"", np.uint8)
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = ~_space[buffer]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(buffer))
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_of_byte[buffer] * up[: len(buffer)], dtype=np.uint64, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, np.cumsum(sizes)), starts, ends, buffer


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k consecutive words, by the place of its first word; empty if there are fewer than k."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    up, down = powers(len(hashes))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64, out=total[1:])
    n = len(hashes) - k + 1
    return mix((total[k:] - total[:n]) * down[:n] + np.uint64(k))
