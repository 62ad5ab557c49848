"""Words to known parts: longest match, and the fewest syllables a word is made of.

A segmenter is a function from a list of texts to a list of part lists. It runs
once for each distinct text, in Arrow batches. The dictionary goes to the tasks
as a broadcast; larger ones than MOST_ENTRIES are refused rather than sent.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakloom.operators.memo import once_per_value

MOST_ENTRIES = 2_000_000

Segmenter = Callable[[str], list[str]]


def refuse_larger(entries: DataFrame) -> None:
    """Only so many entries as every worker can hold."""
    if entries.count() > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} entries")


def dictionary_of(entries: DataFrame, word: str = "word", syllables: str = "syllables") -> dict[str, list[str]]:
    """A small dictionary on the driver; of a repeated word the entry of the least syllable text."""
    one = entries.where(F.col(word).isNotNull() & (F.size(syllables) > 0)).groupBy(word).agg(F.min(syllables).alias(syllables))
    refuse_larger(one)
    t = one.toArrow()
    return dict(zip(t.column(word).to_pylist(), t.column(syllables).to_pylist(), strict=True))


def longest_match(known: dict[str, list[str]], single: frozenset[str] = frozenset()) -> Segmenter:
    """From the left, the longest known word gives its syllables; what is unknown stays together.

    A word of one letter counts only if it is in single or stands alone, so
    that it is not torn out of an unknown word.
    """
    longest = max(map(len, known), default=0)

    def cut(text: str) -> list[str]:
        out, rest, at = [], "", 0
        while at < len(text):
            for n in range(min(longest, len(text) - at), 0, -1):
                part = text[at : at + n]
                if part in known and (n > 1 or part in single or len(text) == 1):
                    if rest:
                        out.append(rest)
                    out.extend(known[part])
                    rest, at = "", at + n
                    break
            else:
                rest += text[at]
                at += 1
        return [*out, rest] if rest else out

    return cut


def fewest_syllables(known: dict[str, list[str]]) -> Segmenter:
    """The known words that make up a text with the fewest syllables; none if it can't be made.

    Of equal counts the one whose first word is shorter is taken.
    """
    sizes: dict[str, list[int]] = {}  # of the words that begin with a character
    for first, n in sorted({(w[0], len(w)) for w in known if w}):
        sizes.setdefault(first, []).append(n)

    def compose(text: str) -> list[str]:
        best: list[list[str] | None] = [None] * len(text) + [[]]
        for at in range(len(text) - 1, -1, -1):
            for n in sizes.get(text[at], ()):
                if n > len(text) - at:
                    break
                tail = best[at + n]
                head = known.get(text[at : at + n]) if tail is not None else None
                if head is not None and (best[at] is None or len(head) + len(tail) < len(best[at])):
                    best[at] = head + tail
        return best[0] or []

    return compose


def composed(known: dict[str, list[str]]) -> Segmenter:
    """The fewest syllables; what can't be made whole is cut by longest match."""
    make, cut = fewest_syllables(known), longest_match(known)
    return lambda text: make(text) or cut(text)


MERGED, LENT = 6, 3  # tokens joined to a known word at most, letters a token takes from the next at most


def spoken_by(pronounce: Callable[[str], str | None], split: Segmenter) -> Segmenter:
    """Syllables of a word as a pronouncer spells it. Words up to two letters, and those it has nothing for, are split as written."""

    def cut(word: str) -> list[str]:
        said = pronounce(word) if len(word) > 2 else None
        if not said:
            return split(word)
        return [s for s in split(said.replace("ฺ", "").replace("-", "")) if s != "ห" or word == "ห"]

    return cut


def with_overrides(known: dict[str, list[str]], tokens: Segmenter, split: Segmenter, spoken: Segmenter | None = None) -> Callable[[str], list[tuple[str, str]]]:
    """(syllable, source) of a text's tokens; source is override or spoken.

    In turn: the longest run of up to MERGED tokens that makes a known word; a
    token that does with up to LENT letters of the next, which keeps its rest; a
    token of several syllables of which one is known, syllable by syllable; else
    the token as spoken (without a pronouncer as split).
    """
    say = spoken or split

    def cut(text: str) -> list[tuple[str, str]]:
        rest, out = deque(tokens(text)), []

        def put(parts: list[str], source: str) -> None:
            out.extend((p, source) for p in parts)

        while rest:
            joined = list(accumulate(islice(rest, MERGED)))
            n = max((i + 1 for i, w in enumerate(joined) if w in known), default=0)
            if n:
                put(known[joined[n - 1]], "override")
                for _ in range(n):
                    rest.popleft()
                continue
            head = rest.popleft()
            lent = next((k for k in range(1, LENT + 1) if rest and k <= len(rest[0]) and head + rest[0][:k] in known), 0)
            if lent:
                after = rest.popleft()
                put(known[head + after[:lent]], "override")
                if after[lent:]:
                    rest.appendleft(after[lent:])
                continue
            parts = split(head)
            for p in parts if len(parts) > 1 and any(p in known for p in parts) else [head]:
                put(*((known[p], "override") if p in known else (say(p), "spoken")))
        return out

    return cut


def sourced_parts(spark: SparkSession, known: dict[str, list[str]], how: Callable[[dict[str, list[str]]], Callable[[str], list[tuple[str, str]]]]) -> Callable[[Column], Column]:
    """As parts_of, for segmenters that tell the source: an array of struct(syllable, source)."""
    sent = spark.sparkContext.broadcast(known)
    kind = pa.list_(pa.struct([("syllable", pa.string()), ("source", pa.string())]))

    @F.arrow_udf("array<struct<syllable:string,source:string>>")
    def parts(col: pa.Array) -> pa.Array:
        cut, coded = how(sent.value), col.dictionary_encode()
        values = pa.array([[{"syllable": a, "source": b} for a, b in cut(x)] for x in coded.dictionary.to_pylist()], kind)
        return values.take(coded.indices)

    return parts


def parts_of(spark: SparkSession, known: dict[str, list[str]], how: Callable[[dict[str, list[str]]], Segmenter] = longest_match) -> Callable[[Column], Column]:
    """A function from a text column to an array of its parts; each distinct text of a batch is cut once."""
    sent = spark.sparkContext.broadcast(known)

    @F.arrow_udf("array<string>")
    def parts(col: pa.Array) -> pa.Array:
        cut, coded = how(sent.value), col.dictionary_encode()
        values = pa.array([cut(x) for x in coded.dictionary.to_pylist()], pa.list_(pa.string()))
        return values.take(coded.indices)

    return parts


def segmented(df: DataFrame, text: str, known: dict[str, list[str]], how: Callable[[dict[str, list[str]]], Segmenter] = longest_match, name: str = "parts") -> DataFrame:
    """df with an array of parts of each text; null for null, empty for empty."""
    sent = df.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf("array<string>")
    def parts(col: pa.Array) -> pa.Array:
        cut = how(sent.value)
        return pa.array([None if x is None else cut(x) for x in col.to_pylist()], pa.list_(pa.string()))

    return once_per_value(df, text, lambda d, c: d.withColumn(name, parts(c)))
