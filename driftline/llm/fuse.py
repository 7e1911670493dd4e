"""Binary fuse filters: static sets of 64-bit keys with false positives and no false negatives.

Three places per key, from neighbouring segments of one array of 8-bit fingerprints; the exclusive or of the
places gives the key's fingerprint. About 9 bits per key, one false positive in 256 keys.
Built by peeling: keys that are alone at a place are taken off until none is left, then filled in backwards.
"""

from __future__ import annotations

import math
import struct

import numpy as np

_HEAD = struct.Struct("<QIII")
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def _places(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """Three rows of places: one in each of three segments in a row, the first of them chosen by the hash."""
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    base = first * np.uint64(length)
    mask = np.uint64(length - 1)
    a = base + (h & mask)
    b = base + np.uint64(length) + ((h >> np.uint64(18)) & mask)
    c = base + np.uint64(2 * length) + ((h * _M1 >> np.uint64(40)) & mask)
    return np.stack([a, b, c]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter of the given keys (unsigned 64-bit; repeats count once)."""
    keys = np.unique(np.asarray(keys, dtype=np.uint64))
    n = len(keys)
    if not n:
        return b""
    length = 1 << max(2, int(math.log(n, 3.33) + 2.25) if n > 1 else 2)
    for attempt in range(64):
        size = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2))) * (1 + attempt / 32)
        segments = max(1, math.ceil(n * size / length) - 2)
        seed = 0x9E3779B97F4A7C15 * (attempt + 1) % (1 << 63)
        order = _peel(keys, seed, length, segments)
        if order is not None:
            return _fill(keys, seed, length, segments, order)
    raise RuntimeError("no seed gives a filter")


def _peel(keys, seed, length, segments):
    """Rounds of (keys, place): every key that is alone at a place in that round; None if some are never alone."""
    h = _mix(keys, seed)
    places = _places(h, length, segments)
    slots = (segments + 2) * length
    count = np.bincount(places.ravel(), minlength=slots)
    which = np.zeros(slots, dtype=np.int64)
    index = np.arange(len(keys))
    for row in places:
        np.bitwise_xor.at(which, row, index)
    rounds, left = [], len(keys)
    alone = np.flatnonzero(count == 1)
    while len(alone):
        taken, first = np.unique(which[alone], return_index=True)
        rounds.append((taken, alone[first]))
        gone = places[:, taken]
        np.subtract.at(count, gone.ravel(), 1)
        np.bitwise_xor.at(which, gone.ravel(), np.tile(taken, 3))
        left -= len(taken)
        near = np.unique(gone.ravel())
        alone = near[count[near] == 1]
    return rounds if left == 0 else None


def _fill(keys, seed, length, segments, rounds) -> bytes:
    h = _mix(keys, seed)
    places, prints = _places(h, length, segments), _prints(h)
    table = np.zeros((segments + 2) * length, dtype=np.uint8)
    for taken, at in reversed(rounds):
        # keys of one round share no place at which they are alone, so all can be set at once
        others = table[places[0, taken]] ^ table[places[1, taken]] ^ table[places[2, taken]]
        table[at] ^= prints[taken] ^ others
    return _HEAD.pack(seed, length, segments, len(keys)) + table.tobytes()


def contains(filter_: bytes, keys: np.ndarray) -> np.ndarray:
    """True for every key of the set, and for about one in 256 others."""
    keys = np.asarray(keys, dtype=np.uint64)
    if not filter_:
        return np.zeros(len(keys), dtype=bool)
    seed, length, segments, _ = _HEAD.unpack_from(filter_)
    table = np.frombuffer(filter_, dtype=np.uint8, offset=_HEAD.size)
    h = _mix(keys, seed)
    a, b, c = _places(h, length, segments)
    return (table[a] ^ table[b] ^ table[c]) == _prints(h)
