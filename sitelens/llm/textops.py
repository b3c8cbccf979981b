"""Vectorised words, word hashes and rolling windows over batches of texts.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Hashes are
64-bit polynomial sums over per-byte constants, taken from prefix sums, and
mixed at the end; words over ``LONG`` bytes take a cryptographic digest
instead, as the sums of very long strings can be made to collide.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import zstandard

LONG = 256
SEGMENT = 1 << 20
U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd: it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * _STEP)
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]

_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        n = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.full(n, U(base), U)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


class Words(NamedTuple):
    hashes: np.ndarray  # uint64 by word
    first: np.ndarray   # word index of each text's first word, and the total


def words(texts: list[bytes], lower: bool = False) -> Words:
    """Word hashes of the texts, in order."""
    value = LOWER_VALUE if lower else BYTE_VALUE
    whole = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    offset = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offset[1:])
    starts, hashes = [], []
    at = 0
    while at < len(whole):
        end = min(at + SEGMENT, len(whole))
        while end < len(whole) and not SEPARATOR[whole[end - 1]]:
            more = SEPARATOR[whole[end:end + SEGMENT]]
            end += int(more.argmax()) + 1 if more.any() else len(more)
        buf = whole[at:end]
        sep = SEPARATOR[buf]
        before = np.empty_like(sep)
        before[0] = True
        before[1:] = sep[:-1]
        start, stop = np.flatnonzero(before & ~sep), np.flatnonzero(sep & ~before)
        up, down = powers(len(buf) + 1)
        total = np.zeros(len(buf) + 1, U)
        np.cumsum(value[buf] * up[:len(buf)], out=total[1:])
        size = stop - start
        h = mix((total[stop] - total[start]) * down[start] + size.astype(U) * _STEP)
        for i in np.flatnonzero(size > LONG):
            word = buf[start[i]:stop[i]].tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(word.lower() if lower else word, digest_size=8).digest(), "little")
        starts.append(start + at)
        hashes.append(h)
        at = end
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return Words(np.concatenate(hashes) if hashes else np.zeros(0, U), np.searchsorted(start, offset))


def rolling(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the n words from each index on, over text borders as well;
    ``fits`` tells which windows lie in one text."""
    if len(hashes) < n:
        return np.zeros(0, U)
    up, down = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(mix(hashes + U(salt)) * up[:len(hashes)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[:len(hashes) - n + 1])


def fits(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, text ordinal) of each window of n words inside a text."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    skipped = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(len(text)) + skipped, text


def groups(changed: np.ndarray) -> np.ndarray:
    """Start index of each run; ``changed[i]``: entry i + 1 differs from entry i."""
    return np.concatenate(([0], np.flatnonzero(changed) + 1))


_zip, _unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes of their differences."""
    d = np.diff(a.astype(np.int64), prepend=np.int64(0))
    return _zip.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(_unzip.decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket by the upper 32 bits."""
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int32)


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A stable order by bucket and (bucket, from, to) in that order."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 65536 else bucket, kind="stable")
    if not len(order):
        return order, []
    s = bucket[order]
    at = groups(s[1:] != s[:-1])
    return order, [(int(s[a]), int(a), int(b)) for a, b in zip(at, [*at[1:], len(s)])]
