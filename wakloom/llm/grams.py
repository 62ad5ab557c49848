"""Rolling hashes of code points and a read-only hash index, both on whole arrays."""

from __future__ import annotations

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit keys."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(cps: np.ndarray, size: int) -> np.ndarray:
    """Hash of cps[i : i + size] for every i; built by doubling. Ends of rows are not looked at."""
    if len(cps) < size:
        return np.zeros(0, np.uint64)
    power, have = mix(cps.astype(np.uint64) + _MUL), 1
    out, out_len = None, 0
    need = size
    while True:
        if need & 1:
            if out is None:
                out, out_len = power, have
            else:
                n = min(len(out), len(power) - out_len)
                out, out_len = out[:n] * _MUL + mix(power[out_len : out_len + n]), out_len + have
        need >>= 1
        if not need:
            return out
        n = len(power) - have
        power = mix(power[:n] * _MUL + power[have:])
        have *= 2


def row_hash(cps: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One hash for each row of code points; 0 for an empty row."""
    n = np.diff(off)
    pos = np.arange(len(cps)) - np.repeat(off[:-1], n)
    terms = mix(cps.astype(np.uint64) * _MUL + mix(pos.astype(np.uint64)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    return np.where(n > 0, mix(total[off[1:]] - total[off[:-1]] + n.astype(np.uint64)), np.uint64(0))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class Index:
    """Keys with their postings, for lookups of many keys at once."""

    def __init__(self, keys: np.ndarray, bits: int = 22) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        small = np.int32 if len(keys) < 1 << 31 else np.int64
        self.order, self.first = order.astype(small), first.astype(small)
        self.count = np.diff(np.append(first, len(keys))).astype(small)
        self.bits = bits
        self._there = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_there": None}  # made anew where it is used

    @property
    def there(self) -> np.ndarray:
        if self._there is None:
            there = np.zeros(1 << self.bits, bool)
            there[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True
            self._there = there
        return self._there

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in keys, place in the indexed keys) of every match."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.there[(keys >> np.uint64(64 - self.bits)).astype(np.int64)])
        k = np.searchsorted(self.keys, keys[at])
        k[k == len(self.keys)] = 0
        hit = self.keys[k] == keys[at]
        at, k = at[hit], k[hit]
        n = self.count[k].astype(np.int64)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.order[np.repeat(self.first[k], n) + step].astype(np.int64)
