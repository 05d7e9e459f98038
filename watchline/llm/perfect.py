"""Minimal perfect hashes of distinct strings, by levels of bits.

A level has GAMMA bits for each key that is left; keys alone on their bit stay there, the others go on to the next level with
another hash. A key's slot is the number of set bits before its own, over all levels, so n keys have the slots 0 to n - 1.
The keys themselves are held in the order of their slots, and a look-up counts only if it finds its own key.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import hash_words, mixed

GAMMA = 2


def _bit(hashes, level, size):
    return (mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Keys in the order of their slots, and the bits of the levels; keys past the last level are told apart by themselves."""

    def __init__(self, keys, levels):
        self.keys, self.levels, base = keys, [], 0
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.levels.append((words, base + np.cumsum(counts) - counts))
            base += int(counts.sum())
        self.twins = {k: base + i for i, k in enumerate(keys.slice(base).to_pylist())}

    @classmethod
    def build(cls, keys):
        """`keys`: Arrow array of distinct strings."""
        hashes = hash_words(keys)
        slot, base, levels = np.full(len(keys), -1), 0, []
        _, first = np.unique(hashes, return_index=True)
        twins = np.setdiff1d(np.arange(len(keys)), first)  # keys whose 64-bit hash another key has: no level parts them
        left = np.sort(first)
        while len(left):
            size = max(64, -(-GAMMA * len(left) // 64) * 64)
            at = _bit(hashes[left], len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            mine = alone[at]
            slot[left[mine]] = base + (np.cumsum(alone) - 1)[at[mine]]
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            base += int(alone.sum())
            left = left[~mine]
        slot[twins] = base + np.arange(len(twins))
        return cls(keys.take(pa.array(np.argsort(slot))), levels)

    def packed(self):
        """The levels as bytes, and the number of 64-bit words of each."""
        return b"".join(words.tobytes() for words, _ in self.levels), [len(words) for words, _ in self.levels]

    @classmethod
    def unpacked(cls, keys, data, sizes):
        return cls(keys, np.split(np.frombuffer(data, "<u8"), np.cumsum(sizes[:-1], dtype=np.int64)) if sizes else [])

    def __len__(self):
        return len(self.keys)

    def slots(self, words, hashes):
        """Slot of every word of an Arrow array, -1 for those that are no key."""
        out = np.full(len(words), -1)
        if not len(self.keys):
            return out
        left = np.arange(len(words))
        for level, (bits, before) in enumerate(self.levels):
            at = _bit(hashes[left], level, 64 * len(bits))
            word, inside = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> inside) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << inside) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (before[at >> 6] + below)[hit]
            left = left[~hit]
        found = np.flatnonzero(out >= 0)
        same = pc.equal(self.keys.take(pa.array(out[found])), words.take(pa.array(found))).to_numpy(zero_copy_only=False)
        out[found[~same]] = -1
        if self.twins:
            for i in np.flatnonzero(out < 0).tolist():
                out[i] = self.twins.get(words[i].as_py(), -1)
        return out
