"""Rhyme verdicts of stanzas over rhyme keys: equality and membership, no UDF.

A stanza has, for each line, the rhyme keys of its syllables in order. Rules
that do not apply are null; a stanza is sound when at least one rule applies
and all that apply hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("r1", "r2", "r3", "rx")


def last(keys: Column) -> Column:
    return F.try_element_at(keys, F.lit(-1))


def among_first(key: Column, keys: Column, first: int, skip: int = 0) -> Column:
    return F.array_contains(F.slice(keys, 1 + skip, first - skip), key)


def verdicts(df: DataFrame, k1: str, k2: str, k3: str, k4: str, before: str, first: int = 5, skip: int = 0, third: bool = True) -> DataFrame:
    """df with r1, r2, r3, rx and sound. k1..k4: arrays of keys; before: the last key of the stanza before, or null.

    r1: the last of line 1 among the first syllables of line 2. r2: the last of
    lines 2 and 3. r3: the last of line 3 among the first of line 4 (null if
    third is off). rx: the key before and the last of line 2. A missing key
    rhymes with nothing.
    """
    a, b, c, d = (F.col(x) for x in (k1, k2, k3, k4))
    no = lambda x: F.coalesce(x, F.lit(False))
    out = df.withColumns({
        "r1": no(among_first(last(a), b, first, skip)), "r2": no(last(b) == last(c)),
        "r3": no(among_first(last(c), d, first, skip)) if third else F.lit(None).cast("boolean"),
        "rx": F.when(F.col(before).isNotNull(), no(F.col(before) == last(b))),
    })
    rules = F.array_compact(F.array(*RULES))
    return out.withColumn("sound", (F.size(rules) > 0) & F.forall(rules, lambda r: r))


def matched_positions(key: Column, keys: Column, first: int = 5) -> Column:
    """The places, from 1, of the first syllables that rhyme with key."""
    return F.filter(F.transform(F.slice(keys, 1, first), lambda k, i: F.when(k == key, i + 1)), lambda x: x.isNotNull())


def by_rule(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each stanza and rule that applies: keep, rule, ok."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("ok")) for r in RULES])).alias("v")).select(*keep, "v.rule", "v.ok").where("ok is not null")
