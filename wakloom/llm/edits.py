"""Edit distances of many pairs at once: Myers' bit-parallel columns, one lane per pair.

A pattern takes one bit per character in words of 64 bits; a text is walked one
character at a time for all pairs together. Patterns and texts of any length,
empty ones included.
"""

from __future__ import annotations

import numpy as np

_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
_LANES = 2048


class Patterns:
    """Bit masks of a set of texts, for each character of any of them."""

    def __init__(self, cps: np.ndarray, off: np.ndarray) -> None:
        self.length = np.diff(off)
        self.words = np.maximum(1, -(-self.length // 64))
        self.alphabet = np.unique(cps)
        n, w = len(self.length), int(self.words.max(initial=1))
        row = np.repeat(np.arange(n), self.length)
        pos = np.arange(len(cps)) - off[:-1][row]
        code = np.searchsorted(self.alphabet, cps)
        # The last character stands for all that are in no pattern.
        self.kinds = len(self.alphabet) + 1
        self.masks = np.zeros((w, n * self.kinds), np.uint64)
        np.bitwise_or.at(self.masks, (pos >> 6, row * self.kinds + code), _ONE << (pos & 63).astype(np.uint64))

    def codes(self, cps: np.ndarray) -> np.ndarray:
        table = np.full(int(self.alphabet.max(initial=0)) + 2, len(self.alphabet), np.int32)
        table[self.alphabet] = np.arange(len(self.alphabet))
        return table[np.minimum(cps, len(table) - 1)]


def distances(pat: Patterns, which: np.ndarray, codes: np.ndarray, start: np.ndarray, length: np.ndarray, anywhere: bool = False) -> np.ndarray:
    """Distance of pattern which[i] to codes[start[i] : start[i] + length[i]].

    anywhere: the least distance to any part of that text instead of to all of it.
    """
    out = np.zeros(len(which), np.int64)
    order = np.lexsort((-length, pat.words[which]))
    k = 0
    while k < len(order):
        w = int(pat.words[which[order[k]]])
        lanes = order[k : k + _LANES]
        lanes = lanes[pat.words[which[lanes]] == w]
        out[lanes] = _walk(pat, which[lanes], codes, start[lanes], length[lanes], w, anywhere)
        k += len(lanes)
    return out


def _walk(pat, which, codes, start, length, w, anywhere):
    """Lanes come longest text first, so those still open are a prefix."""
    n = len(which)
    m = pat.length[which]
    pv, mv = np.full((w, n), _ALL), np.zeros((w, n), np.uint64)
    top = (np.maximum(m - 1, 0) & 63).astype(np.uint64)
    score = m.astype(np.int64)
    best = score.copy()
    open_at = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), "right").tolist()
    base = which.astype(np.int64) * pat.kinds
    enter = np.uint64(0 if anywhere else 1)
    eq, xv, xh, ph, mh, t = (np.empty(n, np.uint64) for _ in range(6))
    for j, live in enumerate(open_at):
        if live < len(eq):
            eq, xv, xh, ph, mh, t = (x[:live] for x in (eq, xv, xh, ph, mh, t))
        slot = codes[start[:live] + j] + base[:live]
        plus, minus = enter, np.uint64(0)
        for b in range(w):
            p, q = pv[b, :live], mv[b, :live]
            np.take(pat.masks[b], slot, out=eq, mode="clip")
            np.bitwise_or(eq, q, out=xv)
            if b:
                eq |= minus
            np.bitwise_and(eq, p, out=xh)
            xh += p
            xh ^= p
            xh |= eq
            np.bitwise_or(xh, p, out=ph)
            np.invert(ph, out=ph)
            ph |= q
            np.bitwise_and(p, xh, out=mh)
            shift = top[:live] if b == w - 1 else np.uint64(63)
            up, down = (ph >> shift) & _ONE, (mh >> shift) & _ONE
            ph <<= _ONE
            ph |= plus
            mh <<= _ONE
            if b:
                mh |= minus
            np.bitwise_or(xv, ph, out=t)
            np.invert(t, out=t)
            np.bitwise_or(t, mh, out=p)
            np.bitwise_and(ph, xv, out=q)
            plus, minus = up, down
        score[:live] += (up - down).view(np.int64)
        if anywhere:
            np.minimum(best[:live], score[:live], out=best[:live])
    if anywhere:
        return best
    return np.where(m == 0, length, score)
