"""Hashed word shingles of whole texts, in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
LIMIT = 1 << 20  # bytes handled at once
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_ISSPACE = np.zeros(256, bool)
_ISSPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
_PLACE = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | _U(1)


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            cls.up = np.cumprod(np.concatenate([[_U(1)], np.full(n, _U(_BASE))]))
            cls.down = np.cumprod(np.concatenate([[_U(1)], np.full(n, _U(inverse))]))
        return cls.up[:n], cls.down[:n]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of hashes, and their inverses modulo 2**64."""
    return _Powers.upto(n)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of raw, A-Z lower-cased."""
    b = np.frombuffer(raw.lower(), np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_ISSPACE[b]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(b) + 1)
    total = np.concatenate([[_U(0)], np.cumsum(BYTE_HASH[b] * up[: len(b)])])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def _cut(raw: bytes) -> Iterator[bytes]:
    """Parts of a very long text that end at white space."""
    at = 0
    while at < len(raw):
        end = at + LIMIT
        while end < len(raw) and not _ISSPACE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end


def shingle_sets(texts: list[bytes | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; a text of fewer words is one shingle, an empty one none."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        t = t or b""
        if len(t) > LIMIT:
            yield from _sets(held, words)
            held, size = [], 0
            yield _of(np.concatenate([word_hashes(x)[0] for x in _cut(t)]), words)
            continue
        held.append(t)
        size += len(t)
        if size >= LIMIT:
            yield from _sets(held, words)
            held, size = [], 0
    yield from _sets(held, words)


def _sets(held: list[bytes], words: int) -> Iterator[np.ndarray]:
    if not held:
        return
    hashes, start = word_hashes(b" ".join(held))
    ends = np.cumsum([len(x) + 1 for x in held])
    bound = np.concatenate([[0], np.searchsorted(start, ends)])
    if len(hashes) >= words:
        n = len(hashes) - words + 1
        runs = mix(sum((hashes[k : k + n] * _PLACE[k] for k in range(words)), np.zeros(n, np.uint64)))
    for a, b in zip(bound, bound[1:]):
        yield np.unique(runs[a : b - words + 1]) if b - a >= words else _of(hashes[a:b], words)


def _of(hashes: np.ndarray, words: int) -> np.ndarray:
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < words:
        return mix(np.array([(hashes * _PLACE[:n]).sum() + _U(n)], np.uint64))
    return np.unique(mix(sum((hashes[k : k + n - words + 1] * _PLACE[k] for k in range(words)), np.zeros(n - words + 1, np.uint64))))


def signature(s: np.ndarray) -> bytes:
    """128 bits that two equal sets share."""
    import hashlib

    return hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()
