"""Held-out passages inside a training corpus.

Only letters, marks and digits count, in lower case and in one form. A leak is
a window of `run` such characters of an item that stands in a document with at
most `budget` edits. Items are cut on a fixed grid into pieces so short that
every window holds budget + 1 whole ones; an edit spoils one piece, so one
piece of a leaked window stands in the document unchanged. Exact piece hits
come from a hash index; each is verified by Myers' bit-parallel distance of the
windows around the piece to the text around the hit.

The items are the query set. They are walked in blocks of bounded size, whose
index is broadcast. The corpus is read and put into its one form once and never
shuffled: a task holds HELD_POINTS code points of it at a time against one block
after another, and only (item, document) pairs leave it.

Defined results: null and short texts (fewer than run characters that count)
leak nothing. Items and documents repeated under other ids count each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakloom.llm.canon import cut, fold, pieces_of, to_points
from wakloom.llm.edits import Patterns, distances
from wakloom.llm.grams import Index, rolling

RUN = 40
BLOCK_POINTS, HELD_POINTS = 6_000_000, 8_000_000


class Inked:
    """Lower case for letters, marks and digits; 0 for all else."""

    def __init__(self) -> None:
        self.known = np.zeros(0x110000, bool)
        self.image = np.zeros(0x110000, np.uint32)

    def __call__(self, cps: np.ndarray) -> np.ndarray:
        if not self.known[cps].all():
            for c in np.unique(cps[~self.known[cps]]).tolist():
                ch = chr(c)
                if unicodedata.category(ch)[0] in "LMN":
                    low = ch.lower()
                    self.image[c] = ord(low) if len(low) == 1 else c
                self.known[c] = True
        return self.image[cps]


_INKED: Inked | None = None


def letters_only(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    global _INKED
    _INKED = _INKED or Inked()
    cps, off, _ = to_points(col)
    cps, off = fold()(cps, off, "keep")
    cps = _INKED(cps)
    return cut(cps, off, cps != 0)


class Items:
    """The index over one block of items."""

    def __init__(self, ids: np.ndarray, cps: np.ndarray, off: np.ndarray, run: int, budget: int) -> None:
        self.ids, self.cps, self.off, self.run, self.budget = ids, cps, off, run, budget
        self.size = (run + 1) // (budget + 2)
        grams = rolling(cps, self.size)
        row = np.repeat(np.arange(len(ids)), np.diff(off))[: len(grams)]
        pos = np.arange(len(grams)) - off[:-1][row]
        use = (pos % self.size == 0) & (pos + self.size <= np.diff(off)[row])
        self.row, self.pos = row[use], pos[use]
        self.index = Index(grams[use])

    def find(self, cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item row, document row) of every leak."""
        at, mine = self.index.find(rolling(cps, self.size))
        doc = np.searchsorted(off, at, "right") - 1
        item = self.row[mine]
        ok = at + self.size <= off[doc + 1]
        ok &= np.diff(self.off)[item] >= self.run
        at, mine, doc, item = at[ok], mine[ok], doc[ok], item[ok]
        key = item.astype(np.int64) * max(1, len(off)) + doc
        order = np.argsort(key, kind="stable")
        found: list[np.ndarray] = []
        while len(order):  # one hit of each open pair at a time: a pair is done with its first leak
            k = key[order]
            first = np.append(True, k[1:] != k[:-1])
            turn = order[first]
            leak = self._verify(at[turn], self.pos[mine[turn]], item[turn], doc[turn], cps, off)
            done = key[turn][leak]
            found.append(done)
            rest = order[~first]
            order = rest[~np.isin(key[rest], done)]
        pairs = np.concatenate(found) if found else np.zeros(0, np.int64)
        return pairs // max(1, len(off)), pairs % max(1, len(off))

    def _verify(self, at, pos, item, doc, cps, off) -> np.ndarray:
        """Does any window of the item around its piece stand in the document around the hit?"""
        ok = np.zeros(len(at), bool)
        for k in range(0, len(at), 2000):
            s = slice(k, k + 2000)
            ok[s] = self._verify_part(at[s], pos[s], item[s], doc[s], cps, off)
        return ok

    def _verify_part(self, at, pos, item, doc, cps, off):
        shift = self.run - self.size  # the piece may lie this far inside a window
        lead = np.arange(shift + 1)
        begin = (pos[:, None] - lead).ravel()
        hit = np.repeat(np.arange(len(at)), shift + 1)
        back = np.tile(lead, len(at))
        length = np.diff(self.off)[item]
        fits = (begin >= 0) & (begin + self.run <= length[hit])
        begin, hit, back = begin[fits], hit[fits], back[fits]
        if not len(hit):
            return np.zeros(len(at), bool)
        lo = np.maximum(at[hit] - back - self.budget, off[doc[hit]])
        hi = np.minimum(at[hit] - back + self.run + self.budget, off[doc[hit] + 1])
        # Without a budget a window that runs over an end of the document can't fit.
        near = hi - lo >= self.run - self.budget
        begin, hit, lo, hi = begin[near], hit[near], lo[near], hi[near]
        window = self.off[:-1][item[hit]] + begin
        which, inverse = np.unique(window, return_inverse=True)
        points = self.cps[(which[:, None] + np.arange(self.run)).ravel()]
        pat = Patterns(points, np.arange(len(which) + 1) * self.run)
        base = int(lo.min(initial=0))
        codes = pat.codes(cps[base : int(hi.max(initial=0))])
        d = distances(pat, inverse, codes, lo - base, hi - lo, anywhere=True)
        ok = np.zeros(len(at), bool)
        ok[hit[d <= self.budget]] = True
        return ok


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple]:
    size = items.agg(F.sum(F.coalesce(F.length(text_col), F.lit(0)) + 20)).first()[0] or 0  # rows without text count too
    n = 1 + size // BLOCK_POINTS
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64(id_col), F.lit(n)) == k)
        t = part.select(id_col, text_col).toArrow()
        if t.num_rows:
            yield (t.column(0).to_numpy(), *letters_only(t.column(1).combine_chunks()))


def leaks(items: DataFrame, docs: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text", run: int = RUN, budget: int = 0) -> DataFrame:
    """item_id, doc_id of every document in which a window of an item stands (see the module)."""
    spark = docs.sparkSession
    sent = [spark.sparkContext.broadcast(Items(*block, run, budget)) for block in _blocks(items, item_id, text)]
    schema = T.StructType([T.StructField(item_id, T.LongType()), docs.schema[doc_id]])

    def matched(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        for one in sent:
            index = one.value
            if len(sent) > 1:
                one.__dict__.pop("_value", None)  # a worker keeps one block only
            for ids, cps, off in held:
                item, doc = index.find(cps, off)
                yield pa.RecordBatch.from_arrays([pa.array(index.ids[item], pa.int64()), ids.take(pa.array(doc))], names=[item_id, doc_id])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            at = 0
            for part in pieces_of(b.column(1), 1 << 20):
                held.append((b.column(0).slice(at, len(part)), *letters_only(part)))
                at += len(part)
                size += len(held[-1][1]) + len(part)
                if len(sent) == 1 or size > HELD_POINTS:
                    yield from matched(held)
                    held, size = [], 0
        if held:
            yield from matched(held)

    return docs.select(doc_id, text).mapInArrow(probe, schema)


def leaked_documents(items: DataFrame, docs: DataFrame, budget: int = 0) -> DataFrame:
    """doc_id, n_items, items: each document concerned with the items in it, and their splits."""
    pairs = leaks(items, docs, budget=budget).join(items.select("item_id", "split"), "item_id")
    return pairs.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("items"), F.array_sort(F.collect_set("split")).alias("splits"))
