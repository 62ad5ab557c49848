"""How often every distinct term occurs, and in how many records.

First a global dictionary is made: every block of records gives its distinct
terms, these are spread over partitions by hash and numbered there in their
order, so a term has the same identifier in every run. Then the blocks are
encoded by it and counted in arrays: for each range of RANGE identifiers, which
of them the block holds, how often and in how many records. Only these arrays
meet, and are added range by range into one dense array. Marks are made on
identifiers; terms come back from the dictionary at the end.

However hot a term is, a block passes it on once. A term repeated inside a
record counts once for records.

Defined results: null and empty terms are left out, also inside arrays; null
and empty arrays hold no term. Terms are compared byte by byte as stored.
Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakloom.session import settle

RANGE = 1 << 16  # identifiers whose counts make one array
_BLOCK_TERMS = 400_000  # distinct terms held before a block's counts are passed on


def _count(lists: pa.ListArray) -> pa.Table:
    """term, n_occ, n_rec of one batch of records."""
    row, term = pc.list_parent_indices(lists), pc.list_flatten(lists)
    full = pc.fill_null(pc.greater(pc.binary_length(term), 0), False)
    row, coded = np.asarray(row.filter(full)).astype(np.int64), term.filter(full).dictionary_encode()
    code, n = np.asarray(coded.indices).astype(np.int64), len(coded.dictionary)
    occ = np.bincount(code, minlength=n)
    once = np.unique(row * max(n, 1) + code)
    rec = np.bincount(once % max(n, 1), minlength=n)
    return pa.table({"term": coded.dictionary, "n_occ": occ.astype(np.int64), "n_rec": rec.astype(np.int64)})


def _sum(parts: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(parts).group_by("term").aggregate([("n_occ", "sum"), ("n_rec", "sum")])
    return t.select(["term", "n_occ_sum", "n_rec_sum"]).rename_columns(["term", "n_occ", "n_rec"])


def block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0
    for b in batches:
        parts.append(_count(b.column(0)))
        held += len(parts[-1])
        if held > _BLOCK_TERMS:
            parts = [_sum(parts)]
            held = len(parts[0])
            if held > _BLOCK_TERMS // 2:
                yield from parts[0].to_batches()
                parts, held = [], 0
    if parts:
        yield from _sum(parts).to_batches()


def number_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted terms of one partition, repeats side by side, to identifiers."""
    from pyspark import TaskContext

    base, known, before = TaskContext.get().partitionId() << 40, 0, None
    for b in batches:
        terms = b.column(0).dictionary_encode().dictionary  # sorted rows: in their order, each once
        if len(terms) and terms[0].as_py() == before:
            terms = terms[1:]
        if len(terms):
            before = terms[-1].as_py()
            yield pa.RecordBatch.from_arrays([terms, pa.array(base + known + np.arange(len(terms)))], names=["term", "term_id"])
            known += len(terms)


def dictionary_of(blocks: DataFrame) -> DataFrame:
    """term, term_id: every distinct term with its global identifier, written down."""
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(blocks.select("term").repartition(n, "term").sortWithinPartitions("term").mapInArrow(number_terms, "term string, term_id long"), "dictionary")


def count_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term_id, n_occ, n_rec) to arrays for each range of identifiers: place in the range, counts."""
    for b in batches:
        ids, occ, rec = (np.asarray(c).astype(np.int64) for c in b.columns)
        order = np.argsort(ids, kind="stable")
        ids, occ, rec = ids[order], occ[order], rec[order]
        if len(ids):  # blocks that met in the join: an identifier once
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            ids, occ, rec = ids[first], np.add.reduceat(occ, first), np.add.reduceat(rec, first)
        part = ids // RANGE
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(ids)) if len(ids) else np.zeros(1, np.int64)
        lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x)) for x in (ids % RANGE, occ, rec)]
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), *lists], names=["range", "at", "n_occ", "n_rec"])


def sum_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays sorted by range, added into one dense array for the range that is open."""
    open_, sums = None, np.zeros((2, RANGE), np.int64)

    def done() -> pa.RecordBatch:
        at = np.flatnonzero(sums[0])
        return pa.RecordBatch.from_arrays([pa.array(open_ * RANGE + at), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["term_id", "n_occ", "n_rec"])

    for b in batches:
        ranges = np.asarray(b.column(0))
        lists = [b.column(i) for i in (1, 2, 3)]
        off = np.asarray(lists[0].offsets)
        at, occ, rec = (np.asarray(x.values) for x in lists)
        for i, r in enumerate(ranges.tolist()):
            if r != open_:
                if open_ is not None:
                    yield done()
                open_ = r
                sums[:] = 0
            s = slice(off[i], off[i + 1])  # an array has a place once
            sums[0, at[s]] += occ[s]
            sums[1, at[s]] += rec[s]
    if open_ is not None:
        yield done()


def term_frequency(df: DataFrame, column: str, src: str, rare_max: int = 2, common_percent: int = 1) -> DataFrame:
    """src, term, term_id, n_occ, n_rec, n_records, is_rare, is_common.

    is_rare: at most rare_max occurrences. is_common: in more than
    common_percent of the records that hold a term at all (n_records).
    """
    one = F.col(column) if df.schema[column].dataType.typeName() == "array" else F.array(column)
    records = df.select(one.alias("terms"))
    blocks = settle(records.mapInArrow(block_counts, "term string, n_occ long, n_rec long"), "blocks")
    known = dictionary_of(blocks)
    encoded = blocks.join(known, "term").select("term_id", "n_occ", "n_rec")
    arrays = encoded.mapInArrow(count_arrays, "range long, at array<long>, n_occ array<long>, n_rec array<long>")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = arrays.repartition(n, "range").sortWithinPartitions("range").mapInArrow(sum_arrays, "term_id long, n_occ long, n_rec long")
    total = records.agg(F.count_if(F.exists("terms", lambda t: F.length(t) > 0)).alias("n_records")).withColumn("src", F.lit(src))
    # total is one row, whatever the size of df.
    counts = sums.withColumn("src", F.lit(src)).join(F.broadcast(total), "src").select(
        "src", "term_id", "n_occ", "n_rec", "n_records", (F.col("n_occ") <= rare_max).alias("is_rare"), (F.col("n_rec") * 100 > F.col("n_records") * common_percent).alias("is_common")
    )
    return counts.join(known, "term_id").select("src", "term", "term_id", "n_occ", "n_rec", "n_records", "is_rare", "is_common")


def marks(counts: DataFrame) -> DataFrame:
    """src, term, mark: one row for each term and mark."""
    mark = F.array_compact(F.array(F.when(F.col("is_rare"), "rare"), F.when(F.col("is_common"), "common")))
    return counts.select("src", "term", F.explode(mark).alias("mark"))
