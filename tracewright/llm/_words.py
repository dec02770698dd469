"""Vectorised words and shingles of Arrow string columns.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.
A word is hashed as a polynomial over random byte codes modulo 2^64, taken from running
sums over the whole slice, so that no Python code runs per word.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

U = np.uint64
_RANDOM = np.random.default_rng(20240601)
_CODES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
for _c in range(65, 91):
    _CODES[_c] = _CODES[_c + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = int(_RANDOM.integers(1, 1 << 62)) * 2 + 1
_FACTORS = _RANDOM.integers(1, 1 << 62, 64, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finalizer of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, U), np.full(n, inverse, U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n + 1).bit_length())
    up, down = _powers(size)
    return up[: n + 1], down[: n + 1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and each row's offset into them (one more than rows)."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def spaces(raw: np.ndarray) -> np.ndarray:
    """Which bytes are white space, told without a table."""
    return (raw == 32) | (raw - np.uint8(9) < 5)


def words(column: pa.Array, separates: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the offset of each row's first word (one more than rows).

    separates: for each byte whether it stands between words.
    """
    raw, at = text_bytes(column)
    n = len(raw)
    if not n:
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    inside = ~(spaces(raw) if separates is _SPACE else separates[raw])
    edge = np.empty(n + 1, bool)
    edge[0] = edge[-1] = False  # bounds of rows, as all of them are
    np.logical_and(inside[1:], inside[:-1], out=edge[1:-1])
    edge[at] = False
    np.logical_not(edge, out=edge)  # where no word goes on
    starts = np.flatnonzero(inside & edge[:-1])
    ends = np.flatnonzero(inside & edge[1:]) + 1
    up, down = powers(n)
    sums = np.empty(n + 1, U)
    sums[0], own = 0, sums[1:]
    np.take(_CODES, raw, out=own, mode="clip")
    own *= up[:n]
    np.cumsum(own, out=own)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U)), np.searchsorted(starts, at)


def shingles(hashes: np.ndarray, at: np.ndarray, k: int):
    """For each row the hashes of its k-word shingles, in text order; a shorter row is one shingle."""
    n = len(hashes)
    full = np.zeros(max(0, n - k + 1), U)
    for j in range(k):
        full += hashes[j : n - k + 1 + j] * _FACTORS[j]
    full = mix(full)
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= k:
            yield full[a : b - k + 1]
        elif b > a:
            yield mix((hashes[a:b] * _FACTORS[: b - a]).sum(dtype=U, keepdims=True) + _FACTORS[k + b - a : k + b - a + 1])
        else:
            yield full[:0]
