"""Abusive, hateful and sexual passages by compression distance.

A window of text that a dictionary of such passages shortens more than a
dictionary of ordinary text does is near to them. Two zstandard dictionaries
are trained, one on the windows of the passages that make toxic documents
toxic, one on the windows of ordinary ones; they and the threshold are fitted
on whole texts of at most MOST_TOXIC and MOST_PLAIN labelled documents. The
windows of every document are then compressed with both, whole texts, and the
largest difference in bytes is the document's score.

What is compressed: letters, marks and digits of the one form in lower case,
stretched letters shortened, digits and signs that stand for letters inside a
word read as those letters, one byte a character.

Defined results: null texts and texts without letters score 0. Labels that are
null are left out; of several labels of a document the mean counts, an even
mean is left out. Without labels of both kinds every score is 0.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakloom.llm.canon import cut, fold, pieces_of, to_points
from wakloom.llm.grams import Index, distinct, rolling, row_hash
from wakloom.session import forget, settle

MOST_TOXIC, MOST_PLAIN = 1_500, 5_000  # labelled documents fitted on
WINDOW, STRIDE = 40, 20
GRAM, SUPPORT, SURE = 6, 2, 4.0
CITED = 12  # so many grams of passages in a row are a passage, fewer a word that may be cited
DICT_BYTES = 110_000  # of a trained dictionary at most
TWICE, THRICE = 2, 3  # training keeps what recurs: passages count twice, ordinary windows that cite them thrice more
LEVEL = 3

# Signs and digits written for letters.
_FOR_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
_ALSO_ENDS = "!|"


class Signs:
    """Code points to one byte each: what counts, and what it is inside a word."""

    def __init__(self) -> None:
        self.known = np.zeros(0x110000, bool)
        self.plain = np.zeros(0x110000, np.uint8)
        self.inside = np.zeros(0x110000, np.uint8)
        self.latin = np.zeros(0x110000, bool)

    def _byte(self, ch: str) -> int:
        c = ord(ch)
        if 0x0E00 <= c < 0x0E80:
            return c - 0x0E00 + 0x80
        return c if c < 0x80 else 1 + c % 31

    def learn(self, cps: np.ndarray) -> None:
        for c in np.unique(cps).tolist():
            ch = chr(c)
            low = ch.lower()[0]
            base = unicodedata.normalize("NFD", low)[0]
            if unicodedata.category(ch)[0] in "LMN":
                self.plain[c] = self._byte(base)
            self.inside[c] = self._byte(_FOR_LETTERS[ch]) if ch in _FOR_LETTERS else self.plain[c]
            self.latin[c] = "a" <= base <= "z"
        self.known[cps] = True


_SIGNS: Signs | None = None


def spelled(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, row offsets)."""
    global _SIGNS
    _SIGNS = _SIGNS or Signs()
    cps, off, _ = to_points(col)
    cps, off = fold()(cps, off, "keep")
    if not _SIGNS.known[cps].all():
        _SIGNS.learn(cps[~_SIGNS.known[cps]])
    out = _SIGNS.plain[cps]
    latin = _SIGNS.latin[cps]
    sign = (out != _SIGNS.inside[cps]) & ~latin
    if sign.any():
        # A word: letters and such signs side by side. A sign is a letter between two letters; all but those
        # that also end sentences are so at an end of two letters or more.
        solid = latin | sign
        first = np.zeros(len(cps) + 1, bool)
        first[off] = True
        begin = solid & (first[:-1] | ~np.concatenate(([False], solid[:-1])))
        word = np.cumsum(begin) - 1
        total = np.concatenate(([0], np.cumsum(latin)))
        letters = np.bincount(word[solid], latin[solid])
        swap = np.flatnonzero(sign)
        before = total[swap] - total[np.flatnonzero(begin)[word[swap]]]
        after = letters[word[swap]] - before
        loose = np.isin(cps[swap], [ord(c) for c in _ALSO_ENDS])
        is_letter = ((before > 0) & (after > 0)) | (~loose & ((before > 1) | (after > 1)))
        out[swap[is_letter]] = _SIGNS.inside[cps[swap[is_letter]]]
    out, off = cut(out, off, out != 0)
    if len(out) > 2:  # of three or more of a letter, one
        first = np.zeros(len(out) + 1, bool)
        first[off] = True
        same = (out[1:] == out[:-1]) & ~first[1:-1]
        head = np.append(True, ~same)
        idx = np.flatnonzero(head)
        long = np.repeat(np.diff(np.append(idx, len(out))) > 2, np.diff(np.append(idx, len(out))))
        out, off = cut(out, off, head | ~long)
    return out, off


def windows(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of overlapping windows that cover all rows."""
    n = np.diff(off)
    count = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)))
    row = np.repeat(np.arange(len(n)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(step * STRIDE, np.maximum(n[row] - WINDOW, 0))
    return row, off[:-1][row] + start, np.minimum(WINDOW, n[row])


class Model:
    """Two dictionaries and a threshold."""

    def __init__(self, toxic: bytes = b"", plain: bytes = b"", threshold: float = 1e9) -> None:
        self.toxic, self.plain, self.threshold = toxic, plain, threshold
        self._two = None

    def __getstate__(self):
        return self.toxic, self.plain, self.threshold

    def __setstate__(self, state):
        self.__init__(*state)

    def _compressors(self):
        if self._two is None:
            self._two = []
            for d in (self.toxic, self.plain):
                params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, dict_size=len(d), write_content_size=False, write_dict_id=False)
                z = zstandard.ZstdCompressionDict(d)
                z.precompute_compress(compression_params=params)
                self._two.append(zstandard.ZstdCompressor(dict_data=z, compression_params=params))
        return self._two

    def gains(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Bytes the toxic dictionary saves over the ordinary one, for each window."""
        if not len(start) or not self.toxic:
            return np.zeros(len(start), np.int64)
        cuts = np.stack((start, length), axis=1).astype("<u8").tobytes()
        text, sizes = raw.tobytes(), []
        for z in self._compressors():
            out = z.multi_compress_to_buffer(zstandard.BufferWithSegments(text, cuts), threads=1)
            sizes.append(np.fromiter(map(len, out), np.int64, len(out)))
        return sizes[1] - sizes[0]

    def scores(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The largest gain of each text; 0 for one without letters."""
        row, start, length = windows(off)
        best = np.zeros(len(off) - 1, np.int64)
        np.maximum.at(best, row, self.gains(raw, start, length))
        return best


def _grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the gram at each position, 0 where it runs over the end of its row; and the row."""
    grams = rolling(raw.astype(np.uint32), GRAM)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(grams)]
    grams[np.arange(len(grams)) + GRAM > off[1:][row]] = 0
    return grams, row


def _docs_with(grams: np.ndarray, row: np.ndarray, index: Index, n_rows: int) -> np.ndarray:
    """In how many rows each key of the index stands."""
    at, key = index.find(grams)
    once = distinct(key * n_rows + row[at])
    return np.bincount(once // n_rows, minlength=len(index.keys))


def passages(raw: np.ndarray, off: np.ndarray, toxic: np.ndarray) -> tuple[list[bytes], Index]:
    """Parts of the toxic texts whose grams are far likelier there, and an index of those grams.

    A gram must stand in SUPPORT unlike toxic texts and in more of them than
    chance gives, by SURE standard deviations. Labels may be wrong: some ordinary
    texts with the gram are allowed where many toxic ones hold it.
    """
    grams, row = _grams(raw, off)
    mine = toxic[row] if len(row) else np.zeros(0, bool)
    _, first = np.unique(row_hash(raw.astype(np.uint32), off), return_index=True)
    fresh = np.zeros(len(off), bool)
    fresh[first] = True
    use = mine & (grams != 0) & fresh[row]
    index = Index(distinct(grams[use]))
    n = len(off)
    bad = _docs_with(grams[use], row[use], index, n)
    plain = ~mine & (grams != 0)
    good = _docs_with(grams[plain], row[plain], index, n)
    chance = toxic.sum() / len(toxic)  # how sure it is that the gram's share of toxic texts isn't by chance
    sure = (bad - (bad + good) * chance) / np.sqrt(np.maximum(1, bad + good) * chance * (1 - chance))
    hot_keys = Index(index.keys[(bad >= SUPPORT) & (sure > SURE)])
    at, _ = hot_keys.find(grams)
    hot = np.zeros(len(grams) + 2, bool)
    hot[at[mine[at]] + 1] = True
    edge = np.flatnonzero(hot[1:] != hot[:-1])
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return [], hot_keys
    join = (begin[1:] - end[:-1] > GRAM) | (row[begin[1:]] != row[begin[:-1]])  # small holes are part of a passage
    begin, end = begin[np.append(True, join)], end[np.append(join, True)]
    long = end - begin >= GRAM
    return [raw[b : e + GRAM - 1].tobytes() for b, e in zip(begin[long].tolist(), end[long].tolist(), strict=True)], hot_keys


def _train(samples: list[bytes]) -> bytes:
    """A dictionary of what recurs in the samples. Too few to train on are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)


def _cuts(raw: np.ndarray, off: np.ndarray) -> list[bytes]:
    text, (_, start, length) = raw.tobytes(), windows(off)
    return [text[a : a + n] for a, n in zip(start.tolist(), length.tolist(), strict=True)]


def _dictionaries(raw: np.ndarray, off: np.ndarray, toxic: np.ndarray) -> Model:
    bad, hot = passages(raw, off, toxic)
    # Where a text labelled ordinary holds grams of the passages in a long run, its label is wrong; the run is left out
    # of the ordinary text. Shorter ones are words that are cited.
    grams, _ = _grams(raw, off)
    at, _ = hot.find(grams)
    plain = ~np.repeat(toxic, np.diff(off))
    mark = np.zeros(len(raw) + 2, bool)
    mark[at + 1] = True
    edge = np.flatnonzero(mark[1:] != mark[:-1])
    begin, end = edge[::2], edge[1::2]
    run = end - begin >= CITED
    for b, e in zip(begin[run].tolist(), end[run].tolist(), strict=True):
        plain[b : e + GRAM - 1] = False
    kept, kept_off = cut(raw, off, plain)
    place = np.cumsum(plain) - 1
    cites = np.zeros(len(kept) + 1, np.int64)
    cites[place[at[plain[at]]] + 1] = 1
    cites = np.cumsum(cites)
    _, start, length = windows(kept_off)
    ordinary = _cuts(kept, kept_off)
    cited = [ordinary[i] for i in np.flatnonzero(cites[start + length] > cites[start]).tolist()]
    sizes = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(p) for p in bad], dtype=np.int64)))
    parts = _cuts(np.frombuffer(b"".join(bad), np.uint8), sizes)
    return Model(_train((bad + parts) * TWICE) if bad else b"", _train(ordinary + cited * THRICE))


def fit(raw: np.ndarray, off: np.ndarray, toxic: np.ndarray, weight: float = 1.0) -> Model:
    """Dictionaries of all labelled texts (spelled); the threshold from texts the dictionaries did not see: of each half by those of the other.

    weight: how many ordinary labelled texts one of those given stands for, for each toxic one a toxic one stands for.
    """
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return Model()
    half = np.arange(len(toxic)) % 2 == 0
    score = np.zeros(len(toxic), np.int64)
    for part in (half, ~half):
        if toxic[part].any() and not toxic[part].all():
            model = _dictionaries(*cut_rows(raw, off, part), toxic[part])
            score[~part] = model.scores(*cut_rows(raw, off, ~part))
    model = _dictionaries(raw, off, toxic)
    model.threshold = best_threshold(score, toxic, weight)
    return model


def best_threshold(score: np.ndarray, toxic: np.ndarray, weight: float) -> float:
    """The middle of the thresholds whose F1, ordinary texts taken weight times, is within 0.003 of the best."""
    w = np.where(toxic, 1.0, weight)
    f1 = np.array([2 * w[(score >= t) & toxic].sum() / max(1.0, w[score >= t].sum() + w[toxic].sum()) for t in range(1, WINDOW)])
    at = np.flatnonzero(f1 >= f1.max() - 0.003) + 1
    return float(at[len(at) // 2])


def cut_rows(raw: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(off)
    return raw[np.repeat(rows, size)], np.concatenate(([0], np.cumsum(size[rows])))


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Whole texts, spelled, and marks of at most MOST_TOXIC and MOST_PLAIN labelled documents, first by hash, and the weight of a plain one against a toxic one."""
    mean = labels.where("toxic is not null").groupBy(doc_id).agg(F.avg("toxic").alias("_mean")).where("_mean <> 0.5")
    marks = settle(mean.select(doc_id, (F.col("_mean") > 0.5).alias("_toxic")), "labels")
    n = {r._toxic: r.n for r in marks.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64(doc_id), F.col(doc_id)]
    chosen = marks.where("_toxic").orderBy(*order).limit(MOST_TOXIC).unionAll(marks.where("not _toxic").orderBy(*order).limit(MOST_PLAIN))
    # At most MOST_TOXIC + MOST_PLAIN rows. Their texts come to the driver spelled, one byte a letter.
    rows = docs.select(doc_id, text).where(F.col(text).isNotNull()).join(F.broadcast(chosen), doc_id)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in pieces_of(b.column(1), 1 << 20):
                raw, off = spelled(part)
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), texts, b.column(2).slice(at, len(part))], names=[doc_id, "t", "_toxic"])
                at += len(part)

    schema = T.StructType([docs.schema[doc_id], T.StructField("t", T.BinaryType()), T.StructField("_toxic", T.BooleanType())])
    got = rows.select(doc_id, text, "_toxic").mapInArrow(spell, schema).toArrow().sort_by(doc_id)
    forget(marks)
    texts = got.column("t").to_pylist()
    off = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(t) for t in texts], dtype=np.int64)))
    weight = max(1.0, n.get(False, 0) / MOST_PLAIN) / max(1.0, n.get(True, 0) / MOST_TOXIC)
    return np.frombuffer(b"".join(texts), np.uint8), off, np.array(got.column("_toxic").to_pylist(), bool), weight


def toxic_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (bytes saved by the toxic dictionary in the worst window), toxic (score at the threshold or over)."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(*labelled(docs, labels, doc_id, text)))
    schema = T.StructType([docs.schema[doc_id], T.StructField("score", T.LongType()), T.StructField("toxic", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            at = 0
            for part in pieces_of(b.column(1), 1 << 20):
                score = model.scores(*spelled(part))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(score), pa.array(score >= model.threshold)], names=[doc_id, "score", "toxic"])
                at += len(part)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def toxic_rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """source, n_docs, n_toxic, rate; documents without a source come under null."""
    flagged = toxic_scores(docs, labels).join(docs.select("doc_id", "source"), "doc_id")
    return flagged.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("toxic").alias("n_toxic"), F.avg(F.col("toxic").cast("double")).alias("rate"))
