"""Vectorised hashing of byte strings.

Hashed: prefix sums of a polynomial over random byte codes, modulo 2^64. Quick for windows of one buffer, but some pairs of long
strings collide under every base, so what it finds equal has to be compared in full. word_hashes: 128 bits of each of many short
strings, without such pairs.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); x is overwritten."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(8)
def codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)


#: Bytes by their lower-case form.
LOWER = np.array([x + 32 if 65 <= x <= 90 else x for x in range(256)], np.uint8)
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
#: Longer strings are hashed one by one.
LONG = 64


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int, second: bool) -> list[np.ndarray]:
    """One 64-bit hash of buf[start:end] for each pair, or two that share no step: eight bytes at a time are mixed into a state,
    each step a bijection of the state, so strings of one length that differ in their last eight bytes only never collide."""
    size = end - start
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    out = [mix(size.astype(U) * U(k) + U(seed)) for k in ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F) if second else (0x9E3779B97F4A7C15,))]
    at = np.flatnonzero((size > 0) & (size <= LONG))
    lane = 0
    while len(at):
        x = eight[start[at] + lane] & _TAIL[np.minimum(size[at] - lane, 8)]
        out[0][at] = mix(out[0][at] ^ x)
        if second:
            out[1][at] = mix((out[1][at] + x) * U(0xD6E8FEB86659FD93) + U(seed))
        lane += 8
        at = at[size[at] > lane]
    for i in np.flatnonzero(size > LONG).tolist():
        d = hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=16, salt=seed.to_bytes(16, "little")).digest()
        for k, h in enumerate(out):
            h[i] = int.from_bytes(d[8 * k : 8 * k + 8], "little")
    return out


_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            x = np.full(size, base, U)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0][:n], _POWERS[1][:n]


class Hashed:
    """Hashes of the slices of one byte buffer."""

    def __init__(self, buf: np.ndarray, seed: int = 1):
        up, self.down = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, U)
        np.cumsum(codes(seed)[buf] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Raw hash of buf[start:end] for each pair."""
        return (self.sums[end] - self.sums[start]) * self.down[start]


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2] if len(col) else None
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int):
    """Row ranges (i, j) of at most limit bytes each, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
