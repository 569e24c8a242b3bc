"""Bucket identifiers of byte strings, computed for a whole text at once with numpy."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S1, _S2 = np.uint64(29), np.uint64(32)
_BASE = 0xD1342543DE82EF95
_MARK = np.uint64(40)


def pair_ids(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The identifier of a bucket refined by the identifier at a later offset: equal pairs, and only they, are equal
    (up to collisions of 64 bits)."""
    x = first * _M1
    x ^= x >> _S2
    x += second
    x *= _M2
    x ^= x >> _S1
    return x


def bucket_ids(data: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each of the lengths (8 to 4096), the identifiers of all strings of that length, by start.

    Starts with buckets of 8 bytes. A bucket of a longer string is the pair of the bucket at its start and the bucket at
    a later offset; each level reuses the identifiers of the level before.
    """
    out: dict[int, np.ndarray] = {}
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    ids = np.lib.stride_tricks.sliding_window_view(padded, 8)[: max(0, n - 7)]
    ids = np.ascontiguousarray(ids).view("<u8").reshape(-1)
    ids = pair_ids(ids, ids)
    size, wanted = 8, sorted(lengths)
    for length in wanted:
        while size * 2 <= length:
            ids = pair_ids(ids[: max(0, len(ids) - size)], ids[size:])
            size *= 2
        if size < length:
            gap = length - size
            out[length] = pair_ids(ids[: max(0, len(ids) - gap)], ids[gap:])
        else:
            out[length] = ids
    return out


def _powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


def prefix_marks(data: np.ndarray, length: int) -> np.ndarray:
    """For each start, 24 bits of the string of this length: those of a polynomial in its bytes, from sums over prefixes.

    It shares nothing with bucket_ids, so strings that one of the two takes for equal are told apart by the other.
    """
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
    x = (sums[length:] - sums[:-length]) * _powers(pow(_BASE, -1, 1 << 64), n)
    x ^= x >> _S2
    x *= _M2
    return x >> _MARK


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of this many values, the place of its least value, the first of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, size = values, np.arange(len(values)), 1

    def joined(step: int) -> None:
        nonlocal best, at
        left, right = best[:-step], best[step:]
        later = right < left
        at = np.where(later, at[step:], at[:-step])
        best = np.where(later, right, left)

    while size * 2 <= width:
        joined(size)
        size *= 2
    if size < width:
        joined(width - size)
    return at
