"""Static binary-fuse filters: three slots of eight bits for each key, in three neighbouring segments."""

from __future__ import annotations

import struct

import numpy as np

from flowfeat.llm.common import by_value, mixed

by_value(__name__)

_U = np.uint64
_HEAD = "<QIII"


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key (3 x n) and its fingerprint byte."""
    h = mixed(keys + _U(seed))
    # the high 32 bits choose where the first of three neighbouring segments begins
    first = ((h >> _U(32)) * _U(segments) >> _U(32)).astype(np.int64) * segment
    g = mixed(h)
    mask = _U(segment - 1)
    place = np.stack([first + i * segment + ((g >> _U(18 * i)) & mask).astype(np.int64) for i in range(3)])
    return place, (h ^ (h >> _U(24))).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter of distinct 64-bit keys: no key of the set is ever missed, about one in 256 others passes."""
    keys = np.unique(np.asarray(keys, _U))
    n = len(keys)
    segment = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    room = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    segments = max(1, -(-int(n * room) // segment) - 2)
    for attempt in range(1000):
        if attempt and attempt % 20 == 0:
            segments += max(1, segments // 10)
        seed = int(mixed(np.array([attempt + 1], _U))[0])
        table = _peel(keys, seed, segment, segments)
        if table is not None:
            return struct.pack(_HEAD, seed, n, segment, segments) + table.tobytes()
    raise RuntimeError("no filter found")


def _peel(keys: np.ndarray, seed: int, segment: int, segments: int) -> np.ndarray | None:
    n, size = len(keys), (segments + 2) * segment
    place, print8 = _slots(keys, seed, segment, segments)
    number = np.arange(n, dtype=np.int64)
    count = np.zeros(size, np.int32)
    chain = np.zeros(size, np.int64)
    for row in place:
        np.add.at(count, row, 1)
        np.bitwise_xor.at(chain, row, number)
    rounds, left = [], n
    alone = np.flatnonzero(count == 1)
    while len(alone):
        key, pick = np.unique(chain[alone], return_index=True)
        slot = alone[pick]
        rounds.append((key, slot))
        left -= len(key)
        touched = place[:, key]
        for row in touched:
            np.subtract.at(count, row, 1)
            np.bitwise_xor.at(chain, row, key)
        touched = np.unique(touched)
        alone = touched[count[touched] == 1]
    if left:
        return None
    table = np.zeros(size, np.uint8)
    for key, slot in reversed(rounds):
        spots = place[:, key]
        value = print8[key]
        for row in spots:
            value = value ^ table[row]
        table[slot] = value ^ table[slot]
    return table


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    seed, n, segment, segments = struct.unpack_from(_HEAD, blob)
    if not n:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(blob, np.uint8, offset=struct.calcsize(_HEAD))
    place, print8 = _slots(np.asarray(keys, _U), seed, segment, segments)
    return (table[place[0]] ^ table[place[1]] ^ table[place[2]]) == print8
