"""Loading of CSV records with the faulty ones set apart.

Structure is judged on whole Arrow batches: the running parity of quotes tells
which commas part fields, so neither a regular expression nor a loop over
characters is needed and the length of a record does not matter. Values are
judged once for each distinct value of a column; the invalid ones with their
reasons form a dictionary that is joined back.

Defined results
- quoting (RFC 4180): a quote is never closed, something other than a comma
  follows a closing quote, or a quote stands in an unquoted field.
- column_count: the record has not the expected number of fields. An empty
  record has one field; a null record has none.
- value: a field holds no valid value.
A byte-order mark at the start, one line end behind the record and line feeds
inside quotes are no fault. A fault found earlier in this list hides later ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakloom.session import settle

_QUOTE, _COMMA, _CR, _LF = 34, 44, 13, 10
BLANKS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
QUEUE_FIELDS = ("wak", "syllables", "flag", "guess", "a", "b", "c")


def split_records(col: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
    """For each record: 0 sound or 1 quoting, and its fields without their quotes."""
    n = len(col)
    col = col.cast(pa.large_string())
    null = np.asarray(col.is_null())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    lo, hi = off[:-1].copy(), off[1:].copy()
    hi[null] = lo[null]
    pad = np.append(raw, [0, 0, 0]).astype(np.uint8)
    bom = (hi - lo >= 3) & (pad[lo] == 0xEF) & (pad[np.minimum(lo + 1, len(raw))] == 0xBB) & (pad[np.minimum(lo + 2, len(raw))] == 0xBF)
    lo[bom] += 3
    for end in (_LF, _CR):
        hi -= (hi > lo) & (pad[np.maximum(hi - 1, 0)] == end)
    q = raw == _QUOTE
    before = np.concatenate(([0], np.cumsum(q)))  # quotes before each byte
    row = np.repeat(np.arange(n), np.diff(off))
    inner = np.zeros(len(raw) + 1, np.int64)
    np.add.at(inner, lo, 1)
    np.add.at(inner, hi, -1)
    inner = np.cumsum(inner)[:-1] > 0
    odd = ((before[:-1] - before[lo][row]) & 1).astype(bool)
    comma = (raw == _COMMA) & ~odd & inner
    opens, closes = q & ~odd & inner, q & odd & inner
    first = np.zeros(len(raw) + 1, bool)  # where a field begins
    first[lo] = True
    first[1:][comma] = True
    last = np.zeros(len(raw) + 1, bool)  # one behind the end of a field
    last[hi] = True
    last[:-1][comma] = True
    again = np.zeros(len(raw), bool)  # the second of two quotes that stand for one
    again[1:] = opens[1:] & closes[:-1]
    bad = opens & ~first[:-1] & ~again
    follows = np.append(again[1:], False)
    bad |= closes & ~follows & ~last[1:]
    fault = np.zeros(n, np.int8)
    fault[row[bad]] = 1
    fault[((before[hi] - before[lo]) & 1).astype(bool)] = 1
    # Field texts: all bytes but parting commas, outer quotes and the first of each doubled pair.
    keep = inner & ~comma & ~(opens & first[:-1]) & ~closes
    kept = np.concatenate(([0], np.cumsum(keep)))
    n_fields = np.where(null, 0, 1 + np.bincount(row[comma], minlength=n)[:n] if n else 0)
    live = np.flatnonzero(~null)
    ends = np.sort(np.concatenate((np.flatnonzero(comma), hi[live])), kind="stable")
    texts = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate(([0], kept[ends])).astype(np.int64)), pa.py_buffer(raw[keep].tobytes()))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_fields))), pa.int32()), texts.cast(pa.string()))
    return fault, lists


def parsed(df: DataFrame, line: str, n_fields: int, keep: list[str]) -> DataFrame:
    """keep columns, _fault (null, quoting or column_count) and _fields."""
    kept = [df.schema[k] for k in keep]
    schema = T.StructType([*kept, T.StructField("_fault", T.StringType()), T.StructField("_fields", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                fault, fields = split_records(part.column(len(keep)))
                count = np.diff(np.asarray(fields.offsets))
                why = np.where(fault == 1, "quoting", np.where(count != n_fields, "column_count", ""))
                why = pa.array(np.where(why == "", None, why).tolist(), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], why, fields], names=[*keep, "_fault", "_fields"])

    return df.select(*keep, F.col(line).alias("_line")).mapInArrow(run, schema)


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, BLANKS, "")


def _queue_fault() -> Column:
    """Why the values of a review row (kind, v0..v3) are invalid; null if they are not."""
    wak, blank = F.col("v0"), [_bare(F.col(f"v{i}")) == "" for i in (1, 2, 3)]
    none = blank[0] & blank[1] & blank[2]
    crossed = F.col("v1").isin("x", "X") & blank[1] & blank[2]
    cut = ~blank[0] & ~blank[1] & ~blank[2] & (_bare(F.concat("v1", "v2", "v3")) == _bare(wak))
    return (
        F.when((F.col("kind") == "wak") & ~wak.rlike("[ก-ฮ]"), "wak: no Thai consonant")
        .when((F.col("kind") == "wak") & wak.contains("�"), "wak: replacement character")
        .when((F.col("kind") == "syllables") & ~wak.rlike("^0*([1-9]|1[0-9]|20)$"), "syllables: no number from 1 to 20")
        .when((F.col("kind") == "cut") & ~(none | crossed | cut), "a, b, c: no cut of wak")
    )


def load_review(df: DataFrame, key: str = "raw_id", line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(valid rows: key, wak, syllables, flag, guess, a, b, c; faulty rows: key, reason, detail, line).

    key must tell records apart. Every record comes out in exactly one of the two.
    """
    rows = settle(parsed(df, line, len(QUEUE_FIELDS), [key]), "parsed")  # parsed once, read by what follows
    named = rows.where("_fault is null").select(key, *[F.col("_fields")[i].alias(f) for i, f in enumerate(QUEUE_FIELDS)])
    names, empty = ["kind", "v0", "v1", "v2", "v3"], F.lit("")
    cell = lambda *parts: F.struct(*[p.alias(n) for n, p in zip(names, parts, strict=True)])
    cut_of = F.when(_bare(F.concat("a", "b", "c")) != "", F.col("wak")).otherwise("")
    cells = named.select(key, F.inline(F.array(
        cell(F.lit("wak"), F.col("wak"), empty, empty, empty),
        cell(F.lit("syllables"), F.col("syllables"), empty, empty, empty),
        cell(F.lit("cut"), cut_of, F.col("a"), F.col("b"), F.col("c")),
    )))
    invalid = cells.select(*names).distinct().withColumn("detail", _queue_fault()).where("detail is not null")
    wrong = cells.join(invalid, names).groupBy(key).agg(F.max("detail").alias("detail")).withColumn("reason", F.lit("value"))
    faulty = rows.where("_fault is not null").select(key, F.col("_fault").alias("reason"), F.col("_fault").alias("detail")).unionByName(wrong)
    good = named.join(wrong.select(key), key, "left_anti").withColumn("syllables", F.col("syllables").cast("int"))
    return good, faulty
