"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

Texts are cut into pieces without a regular expression. Code points are looked
up in a table of classes (letter, number, blank, other); where a piece begins
is decided for all positions at once from the classes around it and from where
runs begin and end. The pieces, as slices of the UTF-8 bytes, are hashed and
looked up in a table of pieces already merged; a piece found is compared byte
by byte with the one in the table, so unlike pieces of one hash never get each
other's ids. Only new ones go through pair merging. Where each id ends in the
text's bytes is kept beside the ids (spans).

Defined results: null and empty texts have no ids (an empty list). No special
token is added, their strings in a text are ordinary text. Texts of any length
are encoded whole.
"""

from __future__ import annotations

import base64
import os
import secrets
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakloom.llm.canon import byte_width, pieces_of, to_points
from wakloom.llm.grams import mix

_LETTER, _NUMBER, _BLANK, _OTHER = 1, 2, 3, 4
# Fixed values: \s of the pattern, and what an apostrophe takes with it.
_BLANKS = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_ONE, _TWO = "sdmt", ("ll", "ve", "re")
_MOST_CACHED = 1 << 20  # pieces; then the table starts anew


def default_vocabulary() -> str:
    try:
        import public_tokenizers as P

        return str(P.path("byte_bpe_50k.tiktoken"))
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Classes:
    def __init__(self) -> None:
        self.of = np.zeros(0x110000, np.uint8)

    def __call__(self, cps: np.ndarray) -> np.ndarray:
        k = self.of[cps]
        if not k.all():
            for c in np.unique(cps[k == 0]).tolist():
                kind = unicodedata.category(chr(c))[0]
                self.of[c] = _BLANK if c in _BLANKS else {"L": _LETTER, "N": _NUMBER}.get(kind, _OTHER)
            k = self.of[cps]
        return k


def piece_starts(cps: np.ndarray, off: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Where pieces begin, as marks on code points."""
    n = len(cps)
    first = np.zeros(n + 1, bool)
    first[off] = True
    first = first[:n]
    last = np.append(first[1:], True)
    blank, space = k == _BLANK, cps == 32
    before = np.concatenate(([0], k[:-1]))
    before[first] = 0
    after = np.append(k[1:], 0)
    after[last] = 0
    led = np.concatenate(([False], space[:-1])) & ~first  # a space stands before
    start = first | ((k != before) & ~(~blank & led))
    # Of several blanks before a text, the last one is cut off: it goes with the text if it is a space.
    start |= blank & (before == _BLANK) & (after != _BLANK) & (after != 0)
    # An apostrophe that begins a piece of its own takes certain letters with it.
    q = np.flatnonzero((cps == 39) & start & (after == _LETTER))
    if len(q):
        a = cps[q + 1]
        one = np.isin(a, [ord(c) for c in _ONE])
        two = np.zeros(len(q), bool)
        room = q + 2 < n
        room[room] &= ~first[q[room] + 2]
        b = np.where(room, cps[np.minimum(q + 2, n - 1)], 0)
        for x, y in _TWO:
            two |= (a == ord(x)) & (b == ord(y))
        two &= ~one
        for hit, size in ((one, 2), (two, 3)):
            i = q[hit]
            start[i + 1] = False
            rest = i + size
            rest = rest[rest < n]
            start[rest] = True
    return start


class Encoder:
    """Pieces to ids, with a table of the pieces met so far."""

    def __init__(self, name: str, data: bytes) -> None:
        import tiktoken

        ranks = read_ranks(data)
        self.merge = tiktoken.Encoding(name, pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.classes = Classes()
        self.byte_key = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.width = np.zeros(max(ranks.values()) + 1, np.int32)  # bytes of each id
        for piece, i in ranks.items():
            self.width[i] = len(piece)
        self._base = secrets.randbits(64) | 1
        self._powers = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self._fresh()

    def _fresh(self) -> None:
        self.keys = np.zeros(1 << 22, np.uint64)
        self.slot = np.zeros(1 << 22, np.int32)
        self.n_ids = np.zeros(1 << 12, np.int32)
        self.at = np.zeros(1 << 12, np.int64)
        self.known = 0
        self.flat = np.zeros(1 << 14, np.int32)
        self.used = 0
        self.size, self.begin = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)  # of each piece's bytes in text
        self.text = np.zeros(1 << 16, np.uint8)
        self.filled = 0
        self.twins: dict[bytes, int] = {}  # pieces whose hash another piece has

    def _power(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of an odd number and of its inverse, modulo 2**64."""
        if len(self._powers[0]) < n:
            out = []
            for b in (self._base, pow(self._base, -1, 1 << 64)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
            self._powers = out[0], out[1]
        return self._powers

    def hashes(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of each slice raw[at[i] : at[i + 1]], the same wherever the slice stands."""
        up, down = self._power(len(raw) + 1)
        total = np.empty(len(raw) + 1, np.uint64)
        total[0] = 0
        np.cumsum(self.byte_key[raw] * up[: len(raw)], out=total[1:])
        size = np.diff(at).astype(np.uint64)
        h = mix((total[at[1:]] - total[at[:-1]]) * down[at[:-1]] + size)
        h[h == 0] = 1
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in the table of pieces, -1 for a new one."""
        mask = np.int64(len(self.keys) - 1)
        s = (h >> np.uint64(20)).astype(np.int64) & mask
        k = self.keys[s]
        out = np.where(k == h, self.slot[s], -1)
        todo = np.flatnonzero((k != h) & (k != 0))
        while len(todo):
            s[todo] = (s[todo] + 1) & mask
            k = self.keys[s[todo]]
            hit = k == h[todo]
            out[todo[hit]] = self.slot[s[todo[hit]]]
            todo = todo[~hit & (k != 0)]
        return out

    def _learn(self, piece: bytes) -> int:
        """The place of a new piece."""
        ids = self.merge(piece)
        if self.known == len(self.n_ids):
            self.n_ids, self.at, self.size, self.begin = (np.append(x, np.zeros_like(x)) for x in (self.n_ids, self.at, self.size, self.begin))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        while self.filled + len(piece) > len(self.text):
            self.text = np.append(self.text, np.zeros_like(self.text))
        self.flat[self.used : self.used + len(ids)] = ids
        self.text[self.filled : self.filled + len(piece)] = np.frombuffer(piece, np.uint8)
        self.n_ids[self.known], self.at[self.known] = len(ids), self.used
        self.size[self.known], self.begin[self.known] = len(piece), self.filled
        self.known += 1
        self.used += len(ids)
        self.filled += len(piece)
        return self.known - 1

    def _add(self, h: np.ndarray, raw: bytes, at: np.ndarray, which: np.ndarray) -> None:
        mask = len(self.keys) - 1
        for i, x in zip(which.tolist(), h[which].tolist(), strict=True):
            place = self._learn(raw[at[i] : at[i + 1]])
            s = (x >> 20) & mask
            while self.keys[s]:
                s = (s + 1) & mask
            self.keys[s], self.slot[s] = x, place

    def _unlike(self, raw: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which slices are not, byte by byte, the pieces found for them."""
        size = np.diff(at)
        long = size != self.size[place]
        to = np.repeat(self.begin[place] - at[:-1], size) + np.arange(len(raw))
        off = np.flatnonzero(self.text.take(to, mode="clip") != raw)
        return np.union1d(np.flatnonzero(long), np.searchsorted(at, off, "right") - 1)

    def pieces(self, col: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts, where pieces begin in them, and how many pieces came before each text."""
        cps, off, _ = to_points(col)
        start = piece_starts(cps, off, self.classes(cps))
        ends = np.concatenate(([0], np.cumsum(byte_width(cps))))
        first = np.flatnonzero(start)
        count = np.concatenate(([0], np.cumsum(start)))
        return cps.tobytes().decode("utf-32-le").encode(), np.append(ends[first], ends[-1]), count[off]

    def __call__(self, col: pa.Array) -> pa.ListArray:
        return self.spans(col)[0]

    def spans(self, col: pa.Array, ends_too: bool = False) -> tuple[pa.ListArray, pa.ListArray | None]:
        """The ids of each text and, if asked for, how many of its bytes they and those before them take."""
        if self.known > _MOST_CACHED:
            self._fresh()
        raw, at, row = self.pieces(col)
        data = np.frombuffer(raw, np.uint8)
        h = self.hashes(data, at)
        place = self.find(h)
        new = np.flatnonzero(place < 0)
        if len(new):
            _, one = np.unique(h[new], return_index=True)
            self._add(h, raw, at, new[one])
            place[new] = self.find(h[new])
        for i in self._unlike(data, at, place).tolist():
            piece = raw[at[i] : at[i + 1]]
            if piece not in self.twins:
                self.twins[piece] = self._learn(piece)
            place[i] = self.twins[piece]
        n = self.n_ids[place].astype(np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.at[place] - ends + n, n)]
        cut = np.concatenate(([0], ends))[row]
        cuts = pa.array(cut.astype(np.int32))
        if not ends_too:
            return pa.ListArray.from_arrays(cuts, pa.array(ids)), None
        taken = np.concatenate(([0], np.cumsum(self.width[ids], dtype=np.int64)))
        behind = taken[1:] - np.repeat(taken[cut[:-1]], np.diff(cut))
        return pa.ListArray.from_arrays(cuts, pa.array(ids)), pa.ListArray.from_arrays(cuts, pa.array(behind))


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str, data: bytes) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name, data)
    return _ENCODERS[name]


def _vocabulary(spark: SparkSession, path: str | None) -> tuple[str, object]:
    """(name, broadcast of the file): executors need not have it. A vocabulary is a file of bounded size, some MB."""
    path = path or default_vocabulary()
    with open(path, "rb") as f:
        return os.path.basename(path), spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, id_col: str, text_col: str, path: str | None = None, spans: bool = False) -> DataFrame:
    """id_col and ids (array of int) of every row. path: the vocabulary file, as ranks, read by the driver.

    spans: also ends (array of long), for each id how many of the text's UTF-8
    bytes it and those before it take: ids[i] stands for bytes ends[i - 1] to
    ends[i], from 0.
    """
    name, sent = _vocabulary(df.sparkSession, path)
    more = [T.StructField("ends", T.ArrayType(T.LongType()))] if spans else []
    schema = T.StructType([df.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType())), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, sent.value)
        for b in batches:
            at = 0
            for part in pieces_of(b.column(1), 1 << 20):
                ids, ends = enc.spans(part, spans)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), ids, *([ends] if spans else [])], names=schema.names)
                at += len(part)

    return df.select(id_col, text_col).mapInArrow(run, schema)


class Decoder:
    """Ids to bytes by one table of all ids' bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        by_id = sorted((i, piece) for piece, i in ranks.items())
        self.size = np.zeros(by_id[-1][0] + 2, np.int64)
        self.size[[i for i, _ in by_id]] = [len(p) for _, p in by_id]
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(p for _, p in by_id), np.uint8)

    def __call__(self, lists: pa.Array) -> pa.Array:
        """Bytes that are no UTF-8, as of ids cut out of a text, become replacement characters."""
        off, ids = np.asarray(lists.offsets).astype(np.int64), np.asarray(lists.values)[lists.offsets[0].as_py() :]
        off = off - off[0]
        ids = ids[: off[-1]]
        size = self.size[ids]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        raw = self.bytes[np.repeat(self.begin[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        null, cut = lists.is_null().to_pylist(), ends[off].tolist()
        return pa.array([None if no else raw[a:b].decode("utf-8", "replace") for no, a, b in zip(null, cut, cut[1:], strict=False)], pa.string())


_DECODERS: dict[str, Decoder] = {}


def decoder(spark: SparkSession, path: str | None = None) -> Callable[[Column], Column]:
    """A column function: ids back to text."""
    name, sent = _vocabulary(spark, path)

    @F.arrow_udf("string")
    def to_text(ids: pa.Array) -> pa.Array:
        if name not in _DECODERS:
            _DECODERS[name] = Decoder(read_ranks(sent.value))
        return _DECODERS[name](ids)

    return to_text
