"""Byte n-grams of whole texts in NumPy: counting them, and looking up a value for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

BLOCK = 1 << 19  # bytes handled at once


def mask(n: int) -> np.uint64:
    return np.uint64((1 << (8 * n)) - 1)


def blocks(texts: list[bytes], n: int, limit: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in blocks of about `limit` bytes: (bytes, n-grams, starts, text numbers).

    The n-gram at a byte is that byte in the lowest 8 bits, the one before it in the next, and so on;
    zeros stand before a text.  Of a text longer than a block, each block has a part, with the n-1 bytes
    before it still in its n-grams.  Empty texts are in no block.
    """
    pad = bytes(n - 1)
    held: list[tuple[int, bytes, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, len(t), limit):
            before = (pad + t[max(0, at - n + 1) : at])[-(n - 1) :] if n > 1 else b""
            held.append((i, before, t[at : at + limit]))
            size += len(held[-1][2])
            if size >= limit:
                yield _block(held, n)
                held, size = [], 0
    if held:
        yield _block(held, n)


def _block(held: list[tuple[int, bytes, bytes]], n: int):
    raw = np.frombuffer(b"".join(x for _, a, b in held for x in (a, b)), np.uint8)
    lengths = np.array([len(b) for _, _, b in held])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    own = np.arange(lengths.sum()) + np.repeat((np.arange(len(held)) + 1) * (n - 1), lengths)
    grams = np.zeros(len(raw), np.uint64)
    for k in range(n):
        grams[k:] |= raw[: len(raw) - k].astype(np.uint64) << np.uint64(8 * k)
    return raw[own], grams[own], starts, np.array([i for i, _, _ in held])


def counted(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(grams) if grams else np.zeros(0, np.uint64), return_counts=True)


class Values:
    """A row of `width` values for each n-gram, from `of(distinct n-grams)`, remembered in a table of fixed size."""

    def __init__(self, of: Callable[[np.ndarray], np.ndarray], width: int, bits: int = 20):
        self.of, self.shift = of, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.rows = np.zeros((1 << bits, width), np.float32)

    def __getitem__(self, grams: np.ndarray) -> np.ndarray:
        slot = (grams * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        out = self.rows[slot]
        odd = np.flatnonzero(self.keys[slot] != grams)
        if len(odd):
            new, where = np.unique(grams[odd], return_inverse=True)
            rows = self.of(new).astype(np.float32)
            out[odd] = rows[where]
            slot = (new * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
            _, first = np.unique(slot, return_index=True)  # one n-gram to a slot
            self.keys[slot[first]], self.rows[slot[first]] = new[first], rows[first]
        return out


def find(keys: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values at the sorted keys, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(at), values.dtype)
    i = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
    return np.where(keys[i] == at, values[i], 0)
