"""A cuckoo filter over 64-bit keys: buckets of four 16-bit fingerprints."""

from __future__ import annotations

import numpy as np

SLOTS, KICKS = 4, 500
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class CuckooFilter:
    """Approximate set with deletion: no false negatives for what was inserted
    and not deleted; a false positive has a chance of about 8 / 65536."""

    def __init__(self, n_buckets: int, slots: np.ndarray | None = None):
        assert n_buckets & (n_buckets - 1) == 0, "a power of two"
        self.n = n_buckets
        self.slots = np.zeros((n_buckets, SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def build(cls, keys: np.ndarray, room: int = 0) -> CuckooFilter:
        """A filter of all ``keys``, at most four fifths full, doubled until all fit."""
        n = 4
        while n * SLOTS * 0.8 < max(len(keys), room):
            n *= 2
        while True:
            out = cls(n)
            if out.insert(keys):
                return out
            n *= 2

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = mix(np.asarray(keys).astype(np.int64).view(np.uint64))
        prints = (x & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        first = ((x >> np.uint64(20)) & np.uint64(self.n - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket, prints):
        step = mix(np.atleast_1d(np.asarray(prints)).astype(np.uint64)) & np.uint64(self.n - 1)
        out = np.atleast_1d(np.asarray(bucket)) ^ step.astype(np.int64)
        return out if np.ndim(bucket) else out[0]

    def insert(self, keys: np.ndarray) -> bool:
        """Insert all keys; False where one found no place (the filter is then spoilt)."""
        prints, first, second = self._places(keys)
        rest = np.arange(len(prints))
        for home in (first, second):  # whole arrays at a time: the r-th new key of a bucket goes to its r-th free slot
            order = rest[np.argsort(home[rest], kind="stable")]
            buckets = home[order]
            rank = np.arange(len(order)) - np.searchsorted(buckets, buckets)
            free = np.argsort(self.slots[buckets] != 0, axis=1, kind="stable")
            room = (self.slots[buckets] == 0).sum(axis=1)
            fits = rank < room
            at = free[np.flatnonzero(fits), rank[fits]]
            self.slots[buckets[fits], at] = prints[order[fits]]
            rest = order[~fits]
        turn = 0
        for k in rest.tolist():
            held, bucket = prints[k], int(first[k])
            for _ in range(KICKS):
                empty = np.flatnonzero(self.slots[bucket] == 0)
                if len(empty):
                    self.slots[bucket, empty[0]] = held
                    break
                turn = (turn + 1) % SLOTS
                held, self.slots[bucket, turn] = self.slots[bucket, turn], held
                bucket = int(self._other(bucket, held))
            else:
                return False
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        return ((self.slots[first] == prints[:, None]) | (self.slots[second] == prints[:, None])).any(axis=1)

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted before; others must not be given."""
        for held, *homes in zip(*self._places(keys), strict=True):
            for bucket in homes:
                at = np.flatnonzero(self.slots[bucket] == held)
                if len(at):
                    self.slots[bucket, at[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.slots.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, held: bytes) -> CuckooFilter:
        slots = np.frombuffer(held, "<u2").reshape(-1, SLOTS).copy()
        return cls(len(slots), slots)
