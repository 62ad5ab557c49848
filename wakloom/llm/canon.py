"""One written form for texts that print alike.

Whole Arrow batches become numpy code-point arrays; every step below is a
table gather, a repeat or a masked copy over all rows at once. No Python
string call is made per row.

The order is: look each code point up (compatibility forms, equal shapes,
kinds of blank, invisible characters), put the marks over and under a letter
into one order, compose what was typed in pieces, cut blanks at the ends.

Defined results: null stays null; an empty text stays empty; a text of blanks
and invisible characters only becomes empty. Lengths are not limited. Case,
digits, tone marks and the number of inner blanks are kept.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_TOP = 0x110000
_SPREAD = np.uint32(0xFFFFFFFF)  # more than one code point comes out, or none

_NIKHAHIT, _AA, _AM, _E, _AE = 0x0E4D, 0x0E32, 0x0E33, 0x0E40, 0x0E41

# Letters of other scripts and of the Thai block that print like
# another letter.
_SAME_SHAPE = {
    "АВЕЅІЈКМНОРСТУХЗ": "ABESIJKMHOPCTYX3",
    "аеѕіјорсухһԁԛԝӏ": "aesijopcyxhdqwl",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "οϲϳ": "ocj",
    "ԌԚԜՏՕ": "GQWSO",
    "օսոһ": "ounh",
    "‐‑": "--",
    "ๅ": "า",
}
# A digit is a difference, so no letter is read as one.
_SHAPES = {ord(a): ord(b) for k, v in _SAME_SHAPE.items() for a, b in zip(k, v, strict=True) if not b.isdigit()}

# Characters without ink that the general category does not tell.
_NO_INK = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}

# Rank of a Thai mark within its cluster; others go by their
# combining class.
_THAI_RANK = {0x0E38: 103, 0x0E39: 103, 0x0E3A: 104, 0x0E31: 105, 0x0E34: 105, 0x0E35: 105, 0x0E36: 105, 0x0E37: 105, 0x0E47: 105, 0x0E4D: 106, 0x0E48: 107, 0x0E49: 107, 0x0E4A: 107, 0x0E4B: 107, 0x0E4C: 108}


def is_blank(ch: str) -> bool:
    return ch.isspace() or unicodedata.category(ch) == "Zs"


def _image(cp: int) -> list[int]:
    """What one code point stands for, by itself."""
    if cp == _AM or 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
        return [cp]
    out = []
    for ch in unicodedata.normalize("NFKD", chr(cp)):
        c = ord(ch)
        if is_blank(ch):
            out.append(32)
        elif c in _NO_INK or unicodedata.category(ch) in ("Cf", "Cc"):
            continue
        else:
            out.append(_SHAPES.get(c, c))
    return out


class Fold:
    """Lookup tables that fill up as code points are met."""

    def __init__(self) -> None:
        self.known = np.zeros(_TOP, bool)
        self.image = np.arange(_TOP, dtype=np.uint32)
        self.rank = np.zeros(_TOP, np.uint8)
        self.joins = np.zeros(_TOP, bool)
        self.spread: dict[int, list[int]] = {}
        pairs = {(0x0E34 << 21) | _NIKHAHIT: 0x0E36}
        for cp in range(0x11FFF):
            d = unicodedata.decomposition(chr(cp))
            if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
                a, b = (int(x, 16) for x in d.split())
                pairs[(a << 21) | b] = cp
        self.pair_key = np.array(sorted(pairs), np.uint64)
        self.pair_to = np.array([pairs[int(k)] for k in self.pair_key], np.uint32)
        self.joins[(self.pair_key & np.uint64(0x1FFFFF)).astype(np.int64)] = True
        self.joins[0x1161:0x1176] = self.joins[0x11A8:0x11C3] = True

    def learn(self, cps: np.ndarray) -> None:
        new = np.unique(cps[~self.known[cps]])
        for cp in new.tolist():
            to = _image(cp)
            if len(to) == 1:
                self.image[cp] = to[0]
            else:
                self.image[cp] = _SPREAD
                self.spread[cp] = to
            for c in to or [cp]:
                self.rank[c] = _THAI_RANK.get(c, unicodedata.combining(chr(c)))
        self.known[new] = True

    def __call__(self, cps: np.ndarray, off: np.ndarray, blanks: str = "trim") -> tuple[np.ndarray, np.ndarray]:
        """(code points, row offsets) to their one form. blanks: trim, drop or keep."""
        if not len(cps):
            return cps, off
        if not self.known[cps].all():
            self.learn(cps)
        out = self.image[cps]
        wide = np.flatnonzero(out == _SPREAD)
        if len(wide):
            out, off = self._spread(cps, out, wide, off)
        starts = np.zeros(len(out) + 1, bool)
        starts[off] = True
        out, off, starts = self._order(out, off, starts)
        out, off = self._thai(out, off, starts)
        out, off = self._compose(out, off)
        if blanks == "drop":
            return cut(out, off, out != 32)
        return trim(out, off) if blanks == "trim" else (out, off)

    def _spread(self, cps, out, wide, off):
        n = np.ones(len(out), np.int64)
        images = [self.spread[c] for c in cps[wide].tolist()]
        n[wide] = [len(x) for x in images]
        ends = np.cumsum(n)
        at = np.repeat(np.arange(len(out)), n)
        new = out[at]
        inner = np.flatnonzero(new == _SPREAD)
        new[inner] = np.array([c for x in images for c in x], np.uint32)
        return new, np.concatenate(([0], ends))[off]

    def _order(self, out, off, starts):
        r = self.rank[out]
        bad = (r[:-1] > r[1:]) & (r[1:] > 0) & ~starts[1:-1]
        if bad.any():
            run = np.cumsum((r == 0) | starts[:-1])
            hit = np.zeros(run[-1] + 1, bool)
            hit[run[:-1][bad]] = True
            idx = np.flatnonzero(hit[run])
            out[idx] = out[idx][np.lexsort((r[idx], run[idx]))]
        return out, off, starts

    def _thai(self, out, off, starts):
        """Two signs E are AE; nikhahit with AA behind it, a tone mark between or not, is AM."""
        keep = None
        nik = np.flatnonzero(out == _NIKHAHIT)
        if len(nik):
            keep = np.ones(len(out), bool)
            for gap in (1, 2):
                i = nik[nik + gap < len(out)]
                ok = out[i + gap] == _AA
                for g in range(1, gap + 1):
                    ok &= ~starts[i + g]
                if gap == 2:
                    ok &= self.rank[out[i + 1]] == 107
                i = i[ok]
                out[i + gap] = _AM
                keep[i] = False
        e = out == _E
        two = e[:-1] & e[1:] & ~starts[1:-1]
        if two.any():
            keep = np.ones(len(out), bool) if keep is None else keep
            first = e.copy()
            first[1:] &= ~two
            idx = np.flatnonzero(e)
            pos = idx - np.maximum.accumulate(np.where(first[idx], idx, 0))
            opens = idx[(pos % 2 == 0) & np.append(two, False)[idx]]
            out[opens] = _AE
            keep[opens + 1] = False
        return (out, off) if keep is None else cut(out, off, keep)

    def _compose(self, out, off):
        while True:
            i = np.flatnonzero(self.joins[out])
            if not len(i):
                return out, off
            starts = np.zeros(len(out) + 1, bool)
            starts[off] = True
            i = i[(i > 0) & ~starts[i]]
            a, b = out[i - 1].astype(np.int64), out[i].astype(np.int64)
            key = (a.astype(np.uint64) << np.uint64(21)) | b.astype(np.uint64)
            k = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            to = np.where(self.pair_key[k] == key, self.pair_to[k], 0)
            lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
            to = np.where(lv, 0xAC00 + ((a - 0x1100) * 21 + (b - 0x1161)) * 28, to)
            lvt = (a >= 0xAC00) & (a <= 0xD7A3) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
            to = np.where(lvt, a + (b - 0x11A7), to)
            i, to = i[to > 0], to[to > 0]
            if not len(i):
                return out, off
            free = np.ones(len(i), bool)
            free[1:] = i[1:] - i[:-1] > 1
            i, to = i[free], to[free]
            out[i - 1] = to
            keep = np.ones(len(out), bool)
            keep[i] = False
            out, off = cut(out, off, keep)


def cut(cps, off, keep):
    """Keep the marked code points."""
    n = np.concatenate(([0], np.cumsum(keep)))
    return cps[keep], n[off]


def trim(cps, off):
    n = np.diff(off)
    full = np.flatnonzero(n > 0)
    if not len(full) or not ((cps[off[full]] == 32) | (cps[off[full + 1] - 1] == 32)).any():
        return cps, off
    ink = cps != 32
    c = np.concatenate(([0], np.cumsum(ink)))
    before, all_ = np.repeat(c[off[:-1]], n), np.repeat(c[off[1:]], n)
    return cut(cps, off, ink | ((c[1:] > before) & (c[1:] < all_)))


def to_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An Arrow string array as code points, row offsets and null marks."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    null = np.asarray(col.is_null())
    if null.any():
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    raw = memoryview(data)[off[0] : off[-1]] if data is not None else b""
    off = off - off[0]
    try:
        cps = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        texts = [str(raw[a:b], "utf-8", "replace") for a, b in zip(off, off[1:])]
        cps = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        return cps, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64), null
    if len(cps) == len(raw):
        return cps, off, null
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return cps, np.concatenate(([0], np.cumsum(lead)))[off], null


def byte_width(cps: np.ndarray) -> np.ndarray:
    return 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)


def to_arrow(cps: np.ndarray, off: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode()
    ends = np.concatenate(([0], np.cumsum(byte_width(cps)))) if len(data) != len(cps) else np.arange(len(cps) + 1)
    at = ends[off].astype(np.int64)
    mask = None if null is None or not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little"))
    out = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(at), pa.py_buffer(data), mask)
    return out.cast(pa.string())


_FOLD: Fold | None = None


def fold() -> Fold:
    global _FOLD
    if _FOLD is None:
        _FOLD = Fold()
    return _FOLD


def pieces_of(col: pa.Array, n_bytes: int = 1 << 20) -> Iterator[pa.Array]:
    """Slices of about n_bytes, so that work arrays stay in the cache; one longer text stays whole."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64))
    at = 0
    while at < len(col):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + n_bytes, "right"))
        to = max(at + 1, to)
        yield col.slice(at, to - at)
        at = to


def canon_arrow(col: pa.Array, blanks: str = "trim") -> pa.Array:
    """The one form of each text."""
    done = []
    for part in pieces_of(col):
        cps, off, null = to_points(part)
        out, off = fold()(cps, off, blanks)
        done.append(to_arrow(out, off, null))
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def look_alike(column, blanks: str = "trim"):
    """The one form of a string column, as a column. See the module for what counts."""
    from pyspark.sql import functions as F

    @F.arrow_udf("string")
    def one_form(col: pa.Array) -> pa.Array:
        return canon_arrow(col, blanks)

    return one_form(column)
