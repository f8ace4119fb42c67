"""Peeling of three-slot key graphs (shared by hash filters and perfect hashes).

Each key owns three slots in three consecutive segments of an array.  A slot
that only one unpeeled key still touches fixes that key; peeling such keys wave
by wave orders them so that, walking back, each key has a slot of its own that
no later key needs.
"""

from __future__ import annotations

import numpy as np

SEEDS = 64


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over uint64 values (wrapping multiply and shift steps)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def layout(n: int) -> tuple[int, int]:
    """(segment length, number of first segments) for n keys."""
    if n < 2:
        return 4, 1
    length = 1 << max(2, min(18, int(np.log(n) / np.log(3.33) + 2.25)))
    size = int(n * max(1.13, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 1
    return length, max(1, -(-size // length) - 2)


def slots(keys: np.ndarray, seed: int, length: int, firsts: int) -> np.ndarray:
    """(3, n) slot numbers: a first segment by the high bits, then its two neighbours."""
    h = mix(keys, seed)
    start = ((h >> np.uint64(32)) * np.uint64(firsts) >> np.uint64(32)).astype(np.int64) * length
    mask = np.uint64(length - 1)
    a = (h & mask).astype(np.int64)
    b = ((h >> np.uint64(18)) & mask).astype(np.int64)
    c = (mix(keys, seed + 1000) & mask).astype(np.int64)
    return np.stack([start + a, start + length + b, start + 2 * length + c])


def peel(where: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Waves of (key, own slot): returns keys, slots and wave ends, or None if stuck."""
    n = where.shape[1]
    flat = where.ravel()
    count = np.bincount(flat, minlength=size)
    # The sum of the key numbers at a slot names the key once the count is one.
    total = np.zeros(size, dtype=np.int64)
    np.add.at(total, flat, np.tile(np.arange(n, dtype=np.int64), 3))
    keys, own, ends, done = [], [], [], 0
    ready = np.flatnonzero(count == 1)
    while len(ready):
        ready = ready[count[ready] == 1]
        key, at = np.unique(total[ready], return_index=True)
        if not len(key):
            break
        keys.append(key)
        own.append(ready[at])
        done += len(key)
        ends.append(done)
        touched = where[:, key].ravel()
        np.subtract.at(count, touched, 1)
        np.subtract.at(total, touched, np.tile(key, 3))
        ready = np.unique(touched[count[touched] == 1])
    if done < n:
        return None
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(keys) if keys else none, np.concatenate(own) if own else none, np.array(ends, dtype=np.int64))


def peelable(keys: np.ndarray) -> tuple[int, int, int, np.ndarray, tuple]:
    """A seed under which distinct ``keys`` peel, with the layout, slots and waves."""
    length, firsts = layout(len(keys))
    for seed in range(SEEDS):
        where = slots(keys, seed, length, firsts)
        waves = peel(where, (firsts + 2) * length)
        if waves is not None:
            return seed, length, firsts, where, waves
        if seed % 4 == 3:
            firsts += 1 + firsts // 16
    raise ValueError("keys do not peel: are they distinct?")
