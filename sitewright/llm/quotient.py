"""Counting quotient filters: lossless, compact counters of fixed-width keys.

A key of several 64-bit words is permuted invertibly, so that it looks random. The leading bits of the result
are its quotient, all other bits its remainder; nothing is thrown away, so a filter counts exactly and gives its
keys back. Entries stand in order of quotient and remainder. Which quotients occur is one bit a quotient,
where a quotient's run of entries ends one bit an entry; remainders take the bytes they need, counts one byte
unless they are large. As filters are sorted alike, two of them merge by one pass, and a range of quotients
is a filter of its own: that is how shards are cut and brought together.
"""

from __future__ import annotations

import struct

import numpy as np

from sitewright.llm.common import ship

_ROUNDS = 2
_HEAD = "<IIQIB"
_LARGE = 255


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _steps(width: int) -> list[tuple[int, int, int]]:
    """(word changed, word it is changed by, key) of every round."""
    return [(i, (i + 1) % width, 1 + r * width + i) for r in range(_ROUNDS) for i in reversed(range(width))]


def permuted(words: list[np.ndarray]) -> list[np.ndarray]:
    out = [w.copy() for w in words]
    for i, by, key in _steps(len(out)):
        out[i] ^= _mix(out[by], key)
    return out


def restored(words: list[np.ndarray]) -> list[np.ndarray]:
    out = [w.copy() for w in words]
    for i, by, key in reversed(_steps(len(out))):
        out[i] ^= _mix(out[by], key)
    return out


def counted(words: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct permuted keys in order, and their summed counts. Inputs that are sorted runs are merged as such."""
    n = len(words[0])
    counts = np.ones(n, np.int64) if counts is None else counts
    if not n:
        return words, counts
    order = np.argsort(words[0], kind="stable")
    for _ in range(2):
        own = [w[order] for w in words]
        same = own[0][1:] == own[0][:-1]
        differ = np.zeros(n - 1, bool)
        for w in own[1:]:
            differ |= w[1:] != w[:-1]
        if not (same & differ).any():
            break
        order = np.lexsort(words[::-1])  # two keys share their first word: sort by all of them
    start = np.flatnonzero(np.r_[True, ~same | differ])
    return [w[start] for w in own], np.add.reduceat(counts[order], start)


def merged(filters: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    words = [np.concatenate(w) for w in zip(*(f[0] for f in filters))]
    return counted(words, np.concatenate([f[1] for f in filters]))


def shard_of(first: np.ndarray, shards: int) -> np.ndarray:
    """Shards are equal ranges of quotients."""
    return ((first >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _remainders(first: np.ndarray, bits: int) -> bytes:
    width = -(-bits // 8)
    return first.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def dump(words: list[np.ndarray], counts: np.ndarray) -> bytes:
    """The filter of sorted, distinct, permuted keys."""
    n = len(counts)
    low, high = int(words[0][0]), int(words[0][-1])
    # About as many quotients as entries.
    kept = max(8, (max(high - low, 1) // n).bit_length())
    quotient = words[0] >> np.uint64(kept)
    base = int(quotient[0])
    occupied = np.zeros(int(quotient[-1]) - base + 1, bool)
    occupied[(quotient - np.uint64(base)).astype(np.int64)] = True
    ends = np.r_[quotient[1:] != quotient[:-1], True]
    rest = words[0] & np.uint64((1 << kept) - 1)
    large = counts >= _LARGE
    small = np.where(large, _LARGE, counts).astype(np.uint8)
    parts = [np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), _remainders(rest, kept)]
    parts += [w.astype("<u8").tobytes() for w in words[1:]] + [small.tobytes(), counts[large].astype("<u8").tobytes()]
    return struct.pack(_HEAD, n, len(words), base, len(occupied), kept) + b"".join(parts)


def load(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    n, width, base, quotients, kept = struct.unpack_from(_HEAD, data)
    at = struct.calcsize(_HEAD)

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(data, np.uint8, size, at - size)

    occupied = np.flatnonzero(np.unpackbits(take(-(-quotients // 8)), count=quotients)).astype(np.uint64)
    ends = np.unpackbits(take(-(-n // 8)), count=n)
    run = np.cumsum(ends) - ends
    size = -(-kept // 8)
    rest = np.zeros((n, 8), np.uint8)
    rest[:, :size] = take(n * size).reshape(n, size)
    first = (occupied[run] + np.uint64(base) << np.uint64(kept)) | rest.view("<u8").reshape(-1)
    words = [first] + [take(8 * n).view("<u8").copy() for _ in range(width - 1)]
    counts = take(n).astype(np.int64)
    large = counts == _LARGE
    counts[large] = take(8 * int(large.sum())).view("<u8")
    return words, counts


ship(__name__)
